"""Boxes, matrices, rotations and polygons as Columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

XYZ = ("X", "Y", "Z")
#: Edges or triangles that are written out as an expression; more go to numpy, behind the same test of a box.
MOST_TERMS = 200


def distance2(a: str, b: str, dims: Sequence[str] = XYZ) -> Column:
    """Squared distance between the dimensions of two aliases, or of prefixes ending in an underscore."""
    name = lambda p, d: F.col(f"{p}.{d}" if not p.endswith("_") else p + d)
    return reduce(lambda x, y: x + y, [(name(a, d) - name(b, d)) * (name(a, d) - name(b, d)) for d in dims])


def box_contains(low: Sequence[float], high: Sequence[float], dims: Sequence[str] = XYZ) -> Column:
    return reduce(lambda a, b: a & b, [F.col(d).between(float(lo), float(hi)) for d, lo, hi in zip(dims, low, high, strict=False)])


def boxes_overlap(a: str, b: str, dims: Sequence[str] = XYZ) -> Column:
    """Whether the boxes min/max of two prefixes share a point."""
    return reduce(lambda x, y: x & y, [(F.col(f"{a}max{d}") >= F.col(f"{b}min{d}")) & (F.col(f"{b}max{d}") >= F.col(f"{a}min{d}")) for d in dims])


def box_wkt(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    corner = lambda x, y: F.concat_ws(" ", x.cast("string"), y.cast("string"))
    ring = F.concat_ws(", ", corner(minx, miny), corner(minx, maxy), corner(maxx, maxy), corner(maxx, miny), corner(minx, miny))
    return F.concat(F.lit("POLYGON (("), ring, F.lit("))"))


def box_grown(low: Sequence[float], high: Sequence[float], by: float) -> tuple[list[float], list[float]]:
    return [v - by for v in low], [v + by for v in high]


def box_clipped(low: Sequence[float], high: Sequence[float], to_low: Sequence[float], to_high: Sequence[float]) -> tuple[list[float], list[float]] | None:
    """The common part of two boxes, None where they have none."""
    a, b = [max(p) for p in zip(low, to_low, strict=True)], [min(p) for p in zip(high, to_high, strict=True)]
    return (a, b) if all(p <= q for p, q in zip(a, b, strict=True)) else None


def box_geojson(low: Sequence[float], high: Sequence[float]) -> dict:
    """The box in the plane as a GeoJSON polygon."""
    (x0, y0), (x1, y1) = low[:2], high[:2]
    return {"type": "Polygon", "coordinates": [[[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]]}


def apply_matrix(m: Sequence[float], xyz: Sequence[Column]) -> list[Column]:
    """A row-major 4x4 matrix on a point; divided by w only where the last row asks for it."""
    m = [float(v) for v in m]
    x, y, z = xyz
    rows = [x * m[4 * r] + y * m[4 * r + 1] + z * m[4 * r + 2] + m[4 * r + 3] for r in range(4)]
    if m[12:] == [0, 0, 0, 1]:
        return rows[:3]
    w = F.when(rows[3] != 0, rows[3])
    return [r / w for r in rows[:3]]


def inverse(m: Sequence[float]) -> list[float]:
    return np.linalg.inv(np.array(m, float).reshape(4, 4)).ravel().tolist()


def rotation(qw: Column, qx: Column, qy: Column, qz: Column) -> list[list[Column]]:
    """The matrix of a quaternion scaled to length one."""
    n = qw * qw + qx * qx + qy * qy + qz * qz
    s = F.when(n > 0, F.lit(2.0) / n).otherwise(F.lit(0.0))
    one = F.lit(1.0)
    return [
        [one - s * (qy * qy + qz * qz), s * (qx * qy - qz * qw), s * (qx * qz + qy * qw)],
        [s * (qx * qy + qz * qw), one - s * (qx * qx + qz * qz), s * (qy * qz - qx * qw)],
        [s * (qx * qz - qy * qw), s * (qy * qz + qx * qw), one - s * (qx * qx + qy * qy)],
    ]


def rotated(matrix: list[list[Column]], v: Sequence[Column]) -> list[Column]:
    return [row[0] * v[0] + row[1] * v[1] + row[2] * v[2] for row in matrix]


def polygon_contains(ring: Sequence[Sequence[float]], x: Column, y: Column) -> Column:
    """Even-odd rule over the ring's edges, behind a test of its box."""
    pts = [(float(a), float(b)) for a, b in ring]
    if pts[0] == pts[-1]:
        pts = pts[:-1]
    xs, ys = [p[0] for p in pts], [p[1] for p in pts]
    box = x.between(min(xs), max(xs)) & y.between(min(ys), max(ys))
    if len(pts) > MOST_TERMS:
        return box & F.coalesce(F.when(box, _polygon_udf(pts)(x.cast("double"), y.cast("double"))), F.lit(False))
    crossings = []
    for (x1, y1), (x2, y2) in zip(pts, pts[1:] + pts[:1], strict=True):
        if y1 != y2:
            crossings.append((((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)).cast("int"))
    inside = reduce(lambda a, b: a + b, crossings) % 2 == 1
    return box & inside


def _polygon_udf(pts: list[tuple[float, float]]):
    """The same rule in numpy, an edge at a time over a batch."""

    def inside(x: pa.Array, y: pa.Array) -> pa.Array:
        px, py = (np.nan_to_num(c.to_numpy(zero_copy_only=False).astype(float), nan=np.inf) for c in (x, y))
        odd = np.zeros(len(px), bool)
        for (x1, y1), (x2, y2) in zip(pts, pts[1:] + pts[:1], strict=True):
            if y1 != y2:
                odd ^= ((y1 > py) != (y2 > py)) & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)
        return pa.array(odd)

    inside.__annotations__ = {"x": pa.Array, "y": pa.Array, "return": pa.Array}
    return F.arrow_udf(inside, "boolean")


def segment_distance(x: Column, y: Column, ax: float, ay: float, bx: float, by: float) -> Column:
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.lit(0.0) if not length else F.least(F.greatest(((x - ax) * dx + (y - ay) * dy) / length, F.lit(0.0)), F.lit(1.0))
    ex, ey = x - (t * dx + ax), y - (t * dy + ay)
    return F.sqrt(ex * ex + ey * ey)


# Polygons on the driver: rings of at most some thousand corners.


def area(ring: Sequence[Sequence[float]]) -> float:
    p = np.asarray(ring, float)
    q = np.roll(p, -1, 0)
    return abs(float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum())) / 2


def contains_point(ring: Sequence[Sequence[float]], x: float, y: float) -> bool:
    p = np.asarray(ring, float)
    q = np.roll(p, -1, 0)
    up = (p[:, 1] > y) != (q[:, 1] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = (q[:, 0] - p[:, 0]) * (y - p[:, 1]) / (q[:, 1] - p[:, 1]) + p[:, 0]
    return bool((up & (x < at)).sum() % 2)


def _cross(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> float:
    return float((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))


def edges_meet(one: Sequence[Sequence[float]], other: Sequence[Sequence[float]]) -> bool:
    p, q = np.asarray(one, float), np.asarray(other, float)
    for a, b in zip(p, np.roll(p, -1, 0), strict=True):
        for c, d in zip(q, np.roll(q, -1, 0), strict=True):
            if _cross(a, b, c) * _cross(a, b, d) <= 0 and _cross(c, d, a) * _cross(c, d, b) <= 0 and min(a[0], b[0]) <= max(c[0], d[0]) and min(c[0], d[0]) <= max(a[0], b[0]) and min(a[1], b[1]) <= max(c[1], d[1]) and min(c[1], d[1]) <= max(a[1], b[1]):
                return True
    return False


def intersects(one: Sequence[Sequence[float]], other: Sequence[Sequence[float]]) -> bool:
    return edges_meet(one, other) or contains_point(one, *other[0]) or contains_point(other, *one[0])


def disjoint(one: Sequence[Sequence[float]], other: Sequence[Sequence[float]]) -> bool:
    return not intersects(one, other)


def within(one: Sequence[Sequence[float]], other: Sequence[Sequence[float]]) -> bool:
    """Whether ``one`` lies in ``other`` without crossing its edges."""
    return all(contains_point(other, *p) for p in one) and not edges_meet(one, other)


def simplify(ring: Sequence[Sequence[float]], tolerance: float) -> list[tuple[float, float]]:
    """Corners that stand out of the line between kept ones by more than the tolerance (Douglas and Peucker 1973)."""
    p = np.asarray(ring, float)
    keep, todo = {0, len(p) - 1}, [(0, len(p) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        line = p[b] - p[a]
        length = np.hypot(*line)
        off = p[a + 1 : b] - p[a]
        d = np.abs(line[0] * off[:, 1] - line[1] * off[:, 0]) / length if length else np.hypot(off[:, 0], off[:, 1])
        if d.max() > tolerance:
            k = a + 1 + int(d.argmax())
            keep.add(k)
            todo += [(a, k), (k, b)]
    return [tuple(p[k]) for k in sorted(keep)]
