"""Rasters, ground, meshes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import geometry
from plumbline.functions.geometry import XYZ

from plumbline.operators.materialise import stored
from plumbline.operators.neighbours import radius_pairs
from plumbline.operators.order import PID, with_one
from plumbline.plans.registry import stage

# --- rasters ----------------------------------------------------------------


def raster(df: DataFrame, resolution: float, radius: float | None = None, power: float = 1.0, bin_mode: bool = False, window: int = 0, dimension: str = "Z", x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """(i, j, count, min, max, mean, stdev, idw) of square cells.

    In ``bin_mode`` a point counts in its own cell; else in each cell whose
    middle is within the radius (by default the resolution times the root of
    two), and idw weighs by one over the distance to the middle to the power;
    a point at a middle decides alone.  ``window``: empty cells between others
    take an idw of cells at most that many away.
    """
    v = F.col(dimension).cast("double")
    if bin_mode:
        cells = df.select(F.floor((F.col("X") - x0) / resolution).cast("long").alias("i"), F.floor((F.col("Y") - y0) / resolution).cast("long").alias("j"), v.alias("v"), F.lit(1.0).alias("d"))
    else:
        r = radius if radius is not None else resolution * 2**0.5
        span = lambda d, o: F.sequence(F.ceil((F.col(d) - o - r) / resolution - 0.5).cast("long"), F.floor((F.col(d) - o + r) / resolution - 0.5).cast("long"))
        spread = df.select("X", "Y", v.alias("v"), F.explode(span("X", x0)).alias("i"), F.col("Y").alias("__y")).withColumn("j", F.explode(span("Y", y0)))
        dx, dy = F.col("X") - x0 - (F.col("i") + 0.5) * resolution, F.col("Y") - y0 - (F.col("j") + 0.5) * resolution
        cells = spread.withColumn("d", F.sqrt(dx * dx + dy * dy)).where(F.col("d") <= r)
    w = F.pow(F.when(F.col("d") > 0, F.col("d")), F.lit(float(power)))
    idw = F.coalesce(F.avg(F.when(F.col("d") == 0, F.col("v"))), F.sum(F.col("v") / w) / F.sum(1 / w))
    out = cells.groupBy("i", "j").agg(F.count("v").alias("count"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("stdev"), idw.alias("idw"))
    if not window:
        return out
    offsets = F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a in range(-window, window + 1) for b in range(-window, window + 1) if a or b])
    near = out.select("i", "j", "idw", F.explode(offsets).alias("o")).select((F.col("i") + F.col("o.di")).alias("i"), (F.col("j") + F.col("o.dj")).alias("j"), "idw", F.sqrt(F.col("o.di") * F.col("o.di") + F.col("o.dj") * F.col("o.dj").cast("double")).alias("d"))
    box = out.agg(F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("j").alias("j0"), F.max("j").alias("j1"))
    filled = near.join(out.select("i", "j"), ["i", "j"], "left_anti").groupBy("i", "j").agg((F.sum(F.col("idw") / F.col("d")) / F.sum(1 / F.col("d"))).alias("idw"))
    filled = with_one(filled, box).where(F.col("i").between(F.col("i0"), F.col("i1")) & F.col("j").between(F.col("j0"), F.col("j1"))).select("i", "j", F.lit(0).cast("long").alias("count"), *[F.lit(None).cast("double").alias(c) for c in ("min", "max", "mean", "stdev")], "idw")
    return out.unionByName(filled)


def around(cells: DataFrame, radius: int, value: str, how, round_: bool = False) -> DataFrame:
    """(i, j, value): ``how`` (least or largest) over the cells at most ``radius`` away, for cells that exist.

    A square goes axis by axis, so a cell is copied twice its width, not its
    area; a disc is a run of cells in every row of it.
    """

    def along(df: DataFrame, axis: str, reach: int) -> DataFrame:
        moved = df.withColumn(axis, F.explode(F.sequence(F.col(axis) - reach, F.col(axis) + reach)))
        return moved.groupBy("i", "j").agg(how(value).alias(value))

    own = cells.select("i", "j", value)
    if not round_:
        spread = along(along(own, "i", radius), "j", radius)
    else:
        steps = [(a, int((radius * radius - a * a) ** 0.5)) for a in range(-radius, radius + 1)]
        runs = F.array(*[F.struct(F.lit(a).alias("di"), F.lit(w).alias("w")) for a, w in steps])
        rows = own.withColumn("o", F.explode(runs)).groupBy((F.col("i") + F.col("o.di")).alias("i"), "j", F.col("o.w").alias("w")).agg(how(value).alias(value))
        spread = rows.withColumn("j", F.explode(F.sequence(F.col("j") - F.col("w"), F.col("j") + F.col("w")))).groupBy("i", "j").agg(how(value).alias(value))
    return spread.join(cells.select("i", "j"), ["i", "j"], "left_semi")


def opened(cells: DataFrame, radius: int, value: str, round_: bool = False) -> DataFrame:
    """Least, then largest value around each cell."""
    return around(around(cells, radius, value, F.min, round_), radius, value, F.max, round_)


# --- ground -----------------------------------------------------------------


def _gridded(df: DataFrame, cell: float) -> DataFrame:
    return df.withColumns({"i": F.floor(F.col("X") / cell).cast("long"), "j": F.floor(F.col("Y") / cell).cast("long")})


@stage("filters.pmf")
def pmf(df: DataFrame, cell_size: float = 1.0, max_window_size: int = 33, slope: float = 1.0, initial_distance: float = 0.15, max_distance: float = 2.5, exponential: bool = True) -> DataFrame:
    """Classification 2 for ground, 1 for the rest: a surface of lowest points is opened with growing windows (Zhang et al. 2003), and points that stand out go."""
    placed = _gridded(df, cell_size)
    surface = stored(placed.groupBy("i", "j").agg(F.min("Z").alias("h")), "pmf")
    above = placed.select(PID, "Z", "i", "j").withColumn("ground", F.lit(True))
    size, last, k = 1, 1, 0
    while size <= max_window_size:
        low = stored(opened(surface, size // 2 if size > 1 else 1, "h"), "pmf")
        limit = initial_distance if k == 0 else min(max_distance, slope * (size - last) * cell_size + initial_distance)
        above = above.join(low.withColumnRenamed("h", "__h"), ["i", "j"]).withColumn("ground", F.col("ground") & (F.col("Z") - F.col("__h") < limit)).drop("__h")
        surface, last, k = low, size, k + 1
        size = 2 * 2**k + 1 if exponential else 2 * (k + 1) + 1
        above = stored(above, "pmf")
    return df.join(above.select(PID, "ground"), PID).withColumn("Classification", F.when(F.col("ground"), 2).otherwise(1)).drop("ground")


@stage("filters.smrf")
def smrf(df: DataFrame, cell: float = 1.0, slope: float = 0.15, window: float = 18.0, threshold: float = 0.5, scalar: float = 1.25) -> DataFrame:
    """Classification by a simple morphological filter (Pingel et al. 2013): cells that an opening lowers by more than the slope allows are objects; points near the rest's surface are ground."""
    placed = _gridded(df, cell)
    surface = stored(placed.groupBy("i", "j").agg(F.min("Z").alias("h")), "smrf")
    objects = surface.select("i", "j", F.lit(False).alias("object"))
    last = surface
    for radius in range(1, max(2, int(np.ceil(window / cell)) + 1)):
        low = stored(opened(last, radius, "h", round_=True), "smrf")
        fell = last.join(low.withColumnRenamed("h", "l"), ["i", "j"]).select("i", "j", ((F.col("h") - F.col("l")) > slope * radius * cell).alias("f"))
        objects = stored(objects.join(fell, ["i", "j"]).select("i", "j", (F.col("object") | F.col("f")).alias("object")), "smrf")
        last = low
    bare = surface.join(objects.where(~F.col("object")).select("i", "j"), ["i", "j"])
    radius = 1
    while True:  # holes take the mean of known cells around, from the rim inwards
        holes = surface.select("i", "j").join(bare, ["i", "j"], "left_anti")
        if holes.isEmpty() or bare.isEmpty():
            break
        offsets = F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a or b])
        spread = bare.select("h", F.explode(offsets).alias("o"), "i", "j").select((F.col("i") + F.col("o.di")).alias("i"), (F.col("j") + F.col("o.dj")).alias("j"), "h").groupBy("i", "j").agg(F.avg("h").alias("h"))
        new = spread.join(holes, ["i", "j"], "left_semi")
        grown = stored(bare.unionByName(new), "smrf")
        radius = radius + 1 if grown.count() == bare.count() else 1
        bare = grown
    steep = bare.join(around(bare, 1, "h", F.max).withColumnRenamed("h", "hi"), ["i", "j"]).join(around(bare, 1, "h", F.min).withColumnRenamed("h", "lo"), ["i", "j"]).select("i", "j", "h", ((F.col("hi") - F.col("lo")) / (2 * cell)).alias("s"))
    limit = F.lit(threshold) + F.col("s") * scalar * cell
    out = placed.join(steep, ["i", "j"], "left").withColumn("Classification", F.when(F.abs(F.col("Z") - F.col("h")) <= limit, 2).otherwise(1))
    return out.drop("i", "j", "h", "s")


@stage("filters.csf")
def csf(df: DataFrame, resolution: float = 1.0, threshold: float = 0.5, rigidness: int = 3, iterations: int = 500, step: float = 0.65) -> DataFrame:
    """Classification by a cloth laid on the turned-over points (W. Zhang et al. 2016).

    The cloth's grid of highest turned-over points is simulated in one task, as
    its knots depend on each other; the points themselves stay distributed.
    """
    placed = _gridded(df, resolution)
    grid = placed.groupBy("i", "j").agg((-F.min("Z")).alias("h"))

    def run(table: pa.Table) -> pa.Table:
        i, j, h = (table[c].to_numpy() for c in ("i", "j", "h"))
        a, b = i - i.min(), j - j.min()
        floor = np.full((a.max() + 1, b.max() + 1), -np.inf)
        floor[a, b] = h
        cloth = np.full(floor.shape, h.max() + 1.0)
        before, moving = cloth.copy(), np.ones(floor.shape, bool)
        for _ in range(iterations):
            new = np.where(moving, cloth + 0.99 * (cloth - before) - 0.2 * step * step * 0.1, cloth)
            before, cloth = cloth, new
            for _ in range(rigidness):
                for axis in (0, 1):
                    gap = np.diff(cloth, axis=axis) / 2
                    lo = [slice(None)] * 2
                    hi = [slice(None)] * 2
                    lo[axis], hi[axis] = slice(None, -1), slice(1, None)
                    lo, hi = tuple(lo), tuple(hi)
                    share = moving[lo].astype(int) + moving[hi]
                    pull = np.where(share == 2, gap / 2, np.where(share == 1, gap, 0)) * 0.5
                    cloth[lo] += pull * moving[lo]
                    cloth[hi] -= pull * moving[hi]
            hit = cloth <= floor
            cloth[hit] = floor[hit]
            moving &= ~hit
            if np.abs(cloth - before)[moving].max(initial=0) < 0.005:
                break
        return pa.table({"i": i, "j": j, "cloth": -cloth[a, b]})

    cloth = stored(grid.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(run, "i long, j long, cloth double"), "csf")
    joined = placed.join(cloth, ["i", "j"])
    return joined.withColumn("Classification", F.when(F.abs(F.col("Z") - F.col("cloth")) <= threshold, 2).otherwise(1)).drop("i", "j", "cloth")


@stage("filters.elm")
def low_noise(df: DataFrame, cell: float = 10.0, threshold: float = 1.0, class_: int = 7) -> DataFrame:
    """Classification of the lowest points of a cell that are followed by a step of more than the threshold, as long as every point before steps too."""
    w = Window.partitionBy("__i", "__j").orderBy("Z", PID)
    placed = df.withColumns({"__i": F.floor(F.col("X") / cell), "__j": F.floor(F.col("Y") / cell)})
    stepped = placed.withColumn("__no", F.when(F.coalesce(F.lead("Z").over(w) - F.col("Z"), F.lit(0.0)) > threshold, 0).otherwise(1))
    marked = stepped.withColumn("__low", F.sum("__no").over(w.rowsBetween(Window.unboundedPreceding, 0)) == 0)
    return marked.withColumn("Classification", F.when(F.col("__low"), class_).otherwise(F.col("Classification"))).drop("__i", "__j", "__no", "__low")


@stage("filters.skewnessbalancing")
def skewness_balancing(df: DataFrame, buckets: int = 4096) -> DataFrame:
    """Ground (2) is what is left when the highest points go one by one until Z isn't skewed to the right (Bartels and Wei 2010).

    Points are numbered from low to high in buckets of Z; running sums of the
    first three powers, a bucket at a time, give the skewness of every prefix.
    """
    box = df.agg(F.min("Z").alias("__lo"), F.max("Z").alias("__hi"))
    width = F.when(F.col("__hi") > F.col("__lo"), (F.col("__hi") - F.col("__lo")) / buckets).otherwise(1.0)
    z = F.col("Z") - F.col("__lo")
    placed = with_one(df, box).withColumns({"__b": F.floor(z / width), "__z": z})
    powers = [F.lit(1.0), F.col("__z"), F.col("__z") * F.col("__z"), F.col("__z") * F.col("__z") * F.col("__z")]
    sums = placed.groupBy("__b").agg(*[F.sum(p).alias(f"__t{k}") for k, p in enumerate(powers)])
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    offsets = sums.select(F.col("__b").alias("__bb"), *[F.coalesce(F.sum(f"__t{k}").over(before), F.lit(0.0)).alias(f"__u{k}") for k in range(4)])
    w = Window.partitionBy("__b").orderBy("Z", PID).rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.withColumns({f"__s{k}": F.sum(p).over(w) for k, p in enumerate(powers)}).join(offsets, F.col("__b") == F.col("__bb"))
    n, s1, s2, s3 = (F.col(f"__s{k}") + F.col(f"__u{k}") for k in range(4))
    mean = s1 / n
    third = s3 / n - 3 * mean * s2 / n + 2 * mean * mean * mean
    scored = joined.withColumns({"__n": n, "__skew": third})
    last = scored.agg(F.max(F.when(F.col("__skew") <= 1e-12, F.col("__n"))).alias("__keep"))
    out = with_one(scored, last).withColumn("Classification", F.when(F.col("__n") <= F.coalesce("__keep", F.lit(0.0)), 2).otherwise(1))
    return out.select(*df.columns) if "Classification" in df.columns else out.select(*df.columns, "Classification")


@stage("filters.sparsesurface")
def sparse_surface(df: DataFrame, radius: float = 1.0) -> DataFrame:
    """A thin ground: from low to high, a ground point not within the radius of a kept one is kept (2), else it's low noise (7 below no one) or plain (1)."""
    ground = df.where("Classification = 2")
    pairs = stored(radius_pairs(ground, ground, radius, XYZ[:2], extra=["Z"]).where("a_pid <> b_pid").select("a_pid", "a_Z", "b_pid", "b_Z"), "sparse")
    state = stored(ground.select(PID, "Z", F.lit(0).alias("state")), "sparse")
    while not state.where("state = 0").isEmpty():
        open_ = state.where("state = 0").select(PID, "Z")
        edges = pairs.join(open_.select(F.col(PID).alias("a_pid")), "a_pid").join(open_.select(F.col(PID).alias("b_pid")), "b_pid")
        beaten = edges.where(F.struct("b_Z", "b_pid") < F.struct("a_Z", "a_pid")).select(F.col("a_pid").alias(PID)).distinct()
        kept = open_.join(beaten, PID, "left_anti").select(PID)
        gone = edges.join(kept.select(F.col(PID).alias("b_pid")), "b_pid", "left_semi").select(F.col("a_pid").alias(PID)).distinct()
        marks = kept.withColumn("__new", F.lit(1)).union(gone.withColumn("__new", F.lit(-1)))
        state = stored(state.join(marks, PID, "left").select(PID, "Z", F.coalesce("__new", "state").alias("state")), "sparse")
    out = df.join(state.select(PID, "state"), PID, "left")
    return out.withColumn("Classification", F.when(F.col("state") == -1, 1).otherwise(F.col("Classification"))).drop("state")


# --- meshes -----------------------------------------------------------------


def triangles(points: np.ndarray) -> list[tuple[int, int, int]]:
    """Delaunay triangulation in the plane, point by point (Bowyer 1981, Watson 1981), each found by a walk from a near one; of equal points the first takes part."""
    points = np.asarray(points, float)
    first = {}
    for k, p in enumerate(map(tuple, points)):
        first.setdefault(p, k)
    chosen = sorted(first.values())
    if len(chosen) < 3:
        return []
    low, high = points[chosen].min(0), points[chosen].max(0)
    span = max(float((high - low).max()), 1e-9)
    middle = (low + high) / 2
    scaled = np.vstack([(points - middle) / span, [[-60, -40], [60, -40], [0, 60]]])
    n = len(points)

    def circle(t: tuple[int, int, int]) -> tuple[float, float, float]:
        (ax, ay), (bx, by), (cx, cy) = scaled[list(t)]
        d = 2 * ((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))
        if abs(d) < 1e-15:
            return 0.0, 0.0, np.inf
        b2, c2 = (bx - ax) ** 2 + (by - ay) ** 2, (cx - ax) ** 2 + (cy - ay) ** 2
        ux, uy = ((cy - ay) * b2 - (by - ay) * c2) / d, ((bx - ax) * c2 - (cx - ax) * b2) / d
        return ax + ux, ay + uy, ux * ux + uy * uy

    # a directed edge has the corner on its left and the face's circle; cells remember a near edge, from where a walk finds the face of a point
    left: dict[tuple[int, int], tuple[int, tuple[float, float, float]]] = {}
    xs, ys = scaled[:, 0].tolist(), scaled[:, 1].tolist()

    def add(a: int, b: int, c: int) -> None:
        round_ = circle((a, b, c))
        left[a, b], left[b, c], left[c, a] = (c, round_), (a, round_), (b, round_)

    add(n, n + 1, n + 2)
    side = max(1, int(len(chosen) ** 0.5 / 2))
    hints: dict[tuple[int, int], tuple[int, int]] = {}
    last = (n, n + 1)
    for k in chosen:
        x, y = xs[k], ys[k]
        cell = (int((x + 0.5) * side), int((y + 0.5) * side))
        edge = hints.get(cell, last)
        if edge not in left:
            edge = last
        for _ in range(len(left)):
            a, b = edge
            c = left[edge][0]
            for u, v in ((a, b), (b, c), (c, a)):
                if (xs[v] - xs[u]) * (y - ys[u]) - (ys[v] - ys[u]) * (x - xs[u]) < 0 and (v, u) in left:
                    edge = (v, u)
                    break
            else:
                break
        holds = lambda r: (x - r[0]) ** 2 + (y - r[1]) ** 2 < r[2] * (1 + 1e-12)
        if not holds(left[edge][1]):
            edge = next(e for e, (_, r) in left.items() if holds(r))
        bad, todo, rim = set(), [(*edge, left[edge][0])], []
        bad.update(((edge[0], edge[1]), (edge[1], todo[0][2]), (todo[0][2], edge[0])))
        while todo:
            a, b, c = todo.pop()
            for u, v in ((a, b), (b, c), (c, a)):
                if (v, u) in bad:
                    continue
                beyond = left.get((v, u))
                if beyond is not None and holds(beyond[1]):
                    w = beyond[0]
                    bad.update(((v, u), (u, w), (w, v)))
                    todo.append((v, u, w))
                else:
                    rim.append((u, v))
        for e in bad:
            del left[e]
        for u, v in rim:
            if (v, u) not in bad:
                add(u, v, k)
                last = (v, k)
        hints[cell] = last
    mesh = [(a, b, c) for (a, b), (c, _) in left.items() if a < b and a < c]
    out = []
    for a, b, c in mesh:
        if max(a, b, c) < n:
            p = scaled[[a, b, c]]
            turn = (p[1, 0] - p[0, 0]) * (p[2, 1] - p[0, 1]) - (p[1, 1] - p[0, 1]) * (p[2, 0] - p[0, 0])
            if abs(turn) > 1e-14:
                out.append((a, b, c) if turn > 0 else (a, c, b))
    return sorted(out)


#: Points of unsettled stars that one task triangulates; more go to larger tiles.
REST_POINTS = 5000


@stage("filters.delaunay")
def delaunay(df: DataFrame, tile: float | None = None) -> DataFrame:
    """Faces (a, b, c) of pids, counterclockwise from the smallest; of equal points the one of the smallest pid takes part.

    With ``tile`` each square is triangulated with a tile's width around it.  A
    face is certain if no other point is in or on its circle and the circle is
    in view.  Points whose faces aren't all certain (at the hull, in gaps, on
    circles of four) are triangulated together; of these faces, those stay
    whose circles are empty of all points.
    """
    flat = df.select(PID, *[F.col(d).cast("double").alias(d) for d in XYZ[:2]])
    if tile is None:
        return _meshed(flat)
    return _tiled_mesh(stored(flat.groupBy("X", "Y").agg(F.min(PID).alias(PID)), "delaunay_points"), tile)


def _meshed(flat: DataFrame) -> DataFrame:
    """Faces of all points, in one task."""

    def run(table: pa.Table) -> pa.Table:
        pid, _, faces = _faces(table)
        return pa.table({n: pid[faces[:, k]] for k, n in enumerate("abc")})

    return flat.withColumn("__i", F.lit(0)).groupBy("__i").applyInArrow(run, "a long, b long, c long")


def _faces(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pids in ascending order, their rows in the table, and faces as places in that order."""
    pid = table[PID].to_numpy()
    order = np.argsort(pid)
    p = np.column_stack([table["X"].to_numpy(), table["Y"].to_numpy()])[order]
    return pid[order], order, np.array(triangles(p), np.int64).reshape(-1, 3)


def _tiled_mesh(flat: DataFrame, tile: float) -> DataFrame:
    """The same in tiles; ``flat`` is stored and has no equal points."""
    from plumbline.operators.clusters import tiled

    box = flat.agg(*[f(d).alias(n + d) for d in XYZ[:2] for n, f in (("low", F.min), ("high", F.max))]).first()
    if box.lowX is None or max(box.highX - box.lowX, box.highY - box.lowY) <= tile:
        return _meshed(flat)
    bounds = np.array([[box.lowX, box.lowY], [box.highX, box.highY]])

    def run(table: pa.Table) -> pa.Table:
        pid, order, faces = _faces(table)
        inner = table["inner"].to_numpy(zero_copy_only=False).astype(bool)[order]
        corner = np.array([table["__tx"][0].as_py(), table["__ty"][0].as_py()]) * tile
        p = np.column_stack([table["X"].to_numpy(), table["Y"].to_numpy()])[order] - corner
        low, high = np.full(2, -tile * (1 - 1e-9)), np.full(2, 2 * tile * (1 - 1e-9))
        low[bounds[0] - corner >= low], high[bounds[1] - corner <= high] = -np.inf, np.inf
        u, v = p[faces[:, 1]] - p[faces[:, 0]], p[faces[:, 2]] - p[faces[:, 0]]
        det = 2 * (u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0])
        uu, vv = (u * u).sum(1), (v * v).sum(1)
        centre = p[faces[:, 0]] + np.column_stack([v[:, 1] * uu - u[:, 1] * vv, u[:, 0] * vv - v[:, 0] * uu]) / det[:, None]
        r2 = ((centre - p[faces[:, 0]]) ** 2).sum(1)
        r = np.sqrt(r2)[:, None] * (1 + 1e-9)
        sure = ((centre - r >= low) & (centre + r <= high)).all(1)
        if len(faces):  # the mesh leaves no point within a circle; one on it is in a face beside
            start, end, corner_ = (np.concatenate([faces[:, (k + j) % 3] for k in range(3)]) for j in range(3))
            key, back = start * len(pid) + end, end * len(pid) + start
            order_ = np.argsort(key)
            place = np.minimum(np.searchsorted(key[order_], back), len(key) - 1)
            beside = order_[place]
            near = ((p[corner_[beside]] - np.tile(centre, (3, 1))) ** 2).sum(1) <= np.tile(r2, 3) * (1 + 1e-9)
            sure &= ~((key[beside] == back) & near).reshape(3, -1).any(0)
        # a star is closed if it has as many faces as neighbours
        spokes = np.concatenate([faces[:, [i, j]] for i in range(3) for j in range(3) if i != j])
        around = np.bincount(np.unique(spokes, axis=0)[:, 0], minlength=len(pid)) if len(faces) else np.zeros(len(pid), int)
        settled = (np.bincount(faces[sure].ravel(), minlength=len(pid)) == around) & (around > 0)
        mine = faces[sure & inner[faces].any(1)]
        rest = pid[inner & ~settled]
        none = lambda n: pa.nulls(n, pa.int64())
        return pa.table({n: pa.chunked_array([pa.array(pid[mine[:, k]], pa.int64()), pa.array(rest, pa.int64()) if k == 0 else none(len(rest))]) for k, n in enumerate("abc")})

    found = stored(tiled(flat, tile, tile, run, "a long, b long, c long"), "delaunay_tiles")
    known = found.where("b IS NOT NULL").distinct()
    rest = stored(flat.join(found.where("b IS NULL").select(F.col("a").alias(PID)), PID), "delaunay_rest")
    n = rest.count()
    if not n:
        return known
    more = (_meshed(rest) if n <= REST_POINTS else _tiled_mesh(rest, 4 * tile)).join(known, ["a", "b", "c"], "left_anti")
    for k in "abc":
        more = more.join(rest.select(F.col(PID).alias(k), F.col("X").alias(f"{k}X"), F.col("Y").alias(f"{k}Y")), k)
    more = stored(more, "delaunay_more")
    # inside a circle: the sign of the determinant of the corners as seen from the point (Guibas and Stolfi 1985)
    at = {(k, d): F.col(f"{k}{d}") - F.col(d) for k in "abc" for d in XYZ[:2]}
    terms = []
    for k, m, o in ("abc", "bca", "cab"):
        square = at[k, "X"] * at[k, "X"] + at[k, "Y"] * at[k, "Y"]
        terms += [square * at[m, "X"] * at[o, "Y"], -square * at[o, "X"] * at[m, "Y"]]
    within = reduce(lambda x, y: x + y, terms) > 1e-12 * reduce(lambda x, y: x + y, map(F.abs, terms))
    empty = F.broadcast(more).join(flat, (F.col(PID) != F.col("a")) & (F.col(PID) != F.col("b")) & (F.col(PID) != F.col("c")) & within, "left_anti")
    return known.unionByName(empty.select("a", "b", "c"))


@stage("filters.faceraster")
def face_raster(faces: DataFrame, points: DataFrame, resolution: float, max_triangle_edge_length: float | None = None) -> DataFrame:
    """(i, j, z): height of the mesh at the middles of the cells that its faces cover."""
    corner = lambda n: points.select(F.col(PID).alias(n), *[F.col(d).alias(f"{n}{d}") for d in XYZ])
    full = faces.join(corner("a"), "a").join(corner("b"), "b").join(corner("c"), "c")
    if max_triangle_edge_length is not None:
        for p, q in ("ab", "bc", "ca"):
            full = full.where(sum(((F.col(p + d) - F.col(q + d)) * (F.col(p + d) - F.col(q + d)) for d in "Y"), (F.col(p + "X") - F.col(q + "X")) * (F.col(p + "X") - F.col(q + "X"))) <= max_triangle_edge_length**2)
    span = lambda d: F.sequence(F.ceil(F.least(*[F.col(n + d) for n in "abc"]) / resolution - 0.5).cast("long"), F.floor(F.greatest(*[F.col(n + d) for n in "abc"]) / resolution - 0.5).cast("long"))
    safe = lambda d: F.when(F.ceil(F.least(*[F.col(n + d) for n in "abc"]) / resolution - 0.5) <= F.floor(F.greatest(*[F.col(n + d) for n in "abc"]) / resolution - 0.5), span(d))
    cells = full.withColumn("i", F.explode(safe("X"))).withColumn("j", F.explode(safe("Y")))
    x, y = (F.col("i") + 0.5) * resolution, (F.col("j") + 0.5) * resolution
    det = (F.col("bY") - F.col("cY")) * (F.col("aX") - F.col("cX")) + (F.col("cX") - F.col("bX")) * (F.col("aY") - F.col("cY"))
    u = ((F.col("bY") - F.col("cY")) * (x - F.col("cX")) + (F.col("cX") - F.col("bX")) * (y - F.col("cY"))) / det
    v = ((F.col("cY") - F.col("aY")) * (x - F.col("cX")) + (F.col("aX") - F.col("cX")) * (y - F.col("cY"))) / det
    inside = (u >= -1e-12) & (v >= -1e-12) & (u + v <= 1 + 1e-12)
    return cells.where(det != 0).where(inside).groupBy("i", "j").agg(F.max(u * F.col("aZ") + v * F.col("bZ") + (1 - u - v) * F.col("cZ")).alias("z"))


def mesh_triangles(mesh: dict) -> list[list[list[float]]]:
    """Triangles of {verts, faces}; larger faces as fans."""
    out = []
    for face in mesh["faces"]:
        for k in range(1, len(face) - 1):
            out.append([mesh["verts"][face[0]], mesh["verts"][face[k]], mesh["verts"][face[k + 1]]])
    return out


def _crossing(p: np.ndarray, q: np.ndarray, y: Column, z: Column) -> Column | None:
    """Whether a way in +Y crosses the edge as seen along X; both triangles of an edge compute the same, so none takes a point of it twice."""
    (y1, z1), (y2, z2) = sorted([tuple(map(float, p[1:])), tuple(map(float, q[1:]))])
    return None if z1 == z2 else ((F.lit(z1) > z) != (F.lit(z2) > z)) & (y < (y2 - y1) * (z - z1) / (z2 - z1) + y1)


def inside_mesh(mesh: dict, origin: Sequence[float] = (0.0, 0.0, 0.0)) -> Column:
    """Whether a point is in a closed mesh: within its box, an odd number of triangles on its way in +X; a side of the box parallel to X isn't inside."""
    verts = np.array(mesh["verts"], float) + np.array(origin, float)
    low, high = verts.min(0).tolist(), verts.max(0).tolist()
    box = F.col("X").between(low[0], high[0]) & reduce(lambda a, b: a & b, [(F.col(d) > low[k]) & (F.col(d) < high[k]) for k, d in enumerate(XYZ) if k])
    if len(mesh_triangles(mesh)) > geometry.MOST_TERMS:
        tri = np.array(mesh_triangles(mesh), float) + np.array(origin, float)
        return box & F.coalesce(F.when(box, _mesh_udf(tri)(*[F.col(d).cast("double") for d in XYZ])), F.lit(False))
    hits = []
    for a, b, c in (np.array(t, float) + np.array(origin, float) for t in mesh_triangles(mesh)):
        n = np.cross(b - a, c - a)
        if abs(n[0]) < 1e-9:
            continue
        crossed = [t.cast("int") for t in (_crossing(p, q, F.col("Y"), F.col("Z")) for p, q in ((a, b), (b, c), (c, a))) if t is not None]
        ahead = float(a[0]) - ((F.col("Y") - float(a[1])) * float(n[1]) + (F.col("Z") - float(a[2])) * float(n[2])) / float(n[0]) - F.col("X")
        hits.append(((reduce(lambda x, y: x + y, crossed) % 2 == 1) & (ahead > 1e-9)).cast("int"))
    return box & (reduce(lambda x, y: x + y, hits, F.lit(0)) % 2 == 1)


def carve(df: DataFrame, meshes: Sequence[dict], origin: Sequence[float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Points in any ``intersect`` mesh (all, if there's none) and in no other mesh; any other operation subtracts."""
    keep = [inside_mesh(m, origin) for m in meshes if m.get("op") == "intersect"]
    drop = [inside_mesh(m, origin) for m in meshes if m.get("op") != "intersect"]
    test = reduce(lambda a, b: a | b, keep) if keep else F.lit(True)
    return df.where(test & ~reduce(lambda a, b: a | b, drop, F.lit(False)))


def _mesh_udf(tri: np.ndarray):
    """The same test in numpy, a triangle at a time over a batch."""

    def inside(x: pa.Array, y: pa.Array, z: pa.Array) -> pa.Array:
        p = np.column_stack([np.nan_to_num(c.to_numpy(zero_copy_only=False).astype(float), nan=1e300) for c in (x, y, z)])
        odd = np.zeros(len(p), bool)
        for a, b, c in tri:
            n = np.cross(b - a, c - a)
            if abs(n[0]) < 1e-9:
                continue
            crossed = np.zeros(len(p), bool)
            for q, r in ((a, b), (b, c), (c, a)):
                (y1, z1), (y2, z2) = sorted([tuple(map(float, q[1:])), tuple(map(float, r[1:]))])
                if z1 != z2:
                    crossed ^= ((z1 > p[:, 2]) != (z2 > p[:, 2])) & (p[:, 1] < (y2 - y1) * (p[:, 2] - z1) / (z2 - z1) + y1)
            odd ^= crossed & (a[0] - ((p[:, 1] - a[1]) * n[1] + (p[:, 2] - a[2]) * n[2]) / n[0] - p[:, 0] > 1e-9)
        return pa.array(odd)

    inside.__annotations__ = {"x": pa.Array, "y": pa.Array, "z": pa.Array, "return": pa.Array}
    return F.arrow_udf(inside, "boolean")
