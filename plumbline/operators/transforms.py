"""Per-point transforms: new and changed dimensions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import bits
from plumbline.functions import expression as ex
from plumbline.functions import geometry as geo
from plumbline.operators.order import PID, previous, running, with_one
from plumbline.plans.registry import stage


def map_dimensions(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """``names``: source to standard dimension, in any case; another source for Z is copied, others are renamed."""
    by_lower = {c.lower(): c for c in df.columns}
    for source, standard in names.items():
        have = by_lower.get(source.lower())
        if have is None:
            continue
        if standard.upper() == "Z" and have.upper() != "Z":
            df = df.withColumn("Z", F.col(have))
        elif have != standard:
            df = df.withColumnRenamed(have, standard)
    return df


@stage("filters.assign")
def assign(df: DataFrame, value: str | Sequence[str]) -> DataFrame:
    """Statements ``Dim = expression [WHERE condition]``, each on the results of those before."""
    for statement in [value] if isinstance(value, str) else value:
        name, new, where = ex.assignment(statement)
        old = F.col(name) if name.lower() in [c.lower() for c in df.columns] else F.lit(0.0)
        df = df.withColumn(name, new if where is None else F.when(where, new).otherwise(old))
    return df


@stage("filters.ferry")
def ferry(df: DataFrame, dimensions: str) -> DataFrame:
    """``From=>To`` pairs; a missing source gives 0."""
    for pair in dimensions.split(","):
        source, _, target = (p.strip() for p in pair.partition("=>"))
        df = df.withColumn(target, F.col(source) if source else F.lit(0.0))
    return df


@stage("filters.transformation")
def transform(df: DataFrame, matrix: str | Sequence[float], invert: bool = False) -> DataFrame:
    m = [float(v) for v in matrix.split()] if isinstance(matrix, str) else list(map(float, matrix))
    x, y, z = geo.apply_matrix(geo.inverse(m) if invert else m, [F.col(d) for d in geo.XYZ])
    return df.withColumns({"X": x, "Y": y, "Z": z})


EARTH = 6378137.0


# The ellipsoid of EPSG:4326, and scale, false easting and northing of its zones of six degrees.
FLATTENING, UTM_SCALE, UTM_EAST, UTM_SOUTH = 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0


def _third(f: float) -> tuple[float, float, list[float], list[float], list[float]]:
    """Excentricity, radius of the rectifying sphere, and the series of the transverse Mercator projection to the fourth order (Karney 2011)."""
    n = f / (2 - f)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]
    return 2 * math.sqrt(n) / (1 + n), EARTH / (1 + n) * (1 + n**2 / 4 + n**4 / 64), alpha, beta, delta


def _to_utm(x: Column, y: Column, zone: int, south: bool) -> tuple[Column, Column]:
    e, radius, alpha, _, _ = _third(FLATTENING)
    sine, turn = F.sin(F.radians(y)), F.radians(x) - math.radians(zone * 6 - 183)
    t = F.sinh(F.atanh(sine) - F.atanh(sine * e) * e)
    north, east = F.atan2(t, F.cos(turn)), F.atanh(F.sin(turn) / F.sqrt(1 + t * t))
    n = sum((F.sin(north * (2 * k)) * F.cosh(east * (2 * k)) * a for k, a in enumerate(alpha, 1)), north)
    m = sum((F.cos(north * (2 * k)) * F.sinh(east * (2 * k)) * a for k, a in enumerate(alpha, 1)), east)
    return m * (radius * UTM_SCALE) + UTM_EAST, n * (radius * UTM_SCALE) + (UTM_SOUTH if south else 0.0)


def _from_utm(x: Column, y: Column, zone: int, south: bool) -> tuple[Column, Column]:
    _, radius, _, beta, delta = _third(FLATTENING)
    north, east = (y - (UTM_SOUTH if south else 0.0)) / (radius * UTM_SCALE), (x - UTM_EAST) / (radius * UTM_SCALE)
    n = north - sum((F.sin(north * (2 * k)) * F.cosh(east * (2 * k)) * b for k, b in enumerate(beta, 1)), F.lit(0.0))
    m = east - sum((F.cos(north * (2 * k)) * F.sinh(east * (2 * k)) * b for k, b in enumerate(beta, 1)), F.lit(0.0))
    chi = F.asin(F.sin(n) / F.cosh(m))
    latitude = sum((F.sin(chi * (2 * k)) * d for k, d in enumerate(delta, 1)), chi)
    return F.degrees(F.atan2(F.sinh(m), F.cos(n))) + float(zone * 6 - 183), F.degrees(latitude)


@stage("filters.reprojection")
def reproject(df: DataFrame, in_srs: str, out_srs: str) -> DataFrame:
    """Between EPSG:4326 (degrees), EPSG:3857 (spherical Mercator) and the zones EPSG:32601 to 32660 (north), 32701 to 32760 (south)."""
    source, target = in_srs.upper(), out_srs.upper()
    if source == target:
        return df
    for srs, steps in ((source, (_degrees_of,)), (target, (_of_degrees,))):
        if srs == "EPSG:4326":
            continue
        code = int(srs.removeprefix("EPSG:")) if srs.removeprefix("EPSG:").isdigit() else 0
        if code != 3857 and not 32601 <= code <= 32660 and not 32701 <= code <= 32760:
            raise ValueError(f"no closed form from {in_srs} to {out_srs}")
        for step in steps:
            x, y = step(code)
            df = df.withColumns({"X": x, "Y": y})
    return df


def _degrees_of(code: int) -> tuple[Column, Column]:
    x, y = F.col("X"), F.col("Y")
    if code == 3857:
        return F.degrees(x / EARTH), F.degrees(F.atan(F.exp(y / EARTH)) * 2 - math.pi / 2)
    return _from_utm(x, y, code % 100, code >= 32700)


def _of_degrees(code: int) -> tuple[Column, Column]:
    x, y = F.col("X"), F.col("Y")
    if code == 3857:
        return F.radians(x) * EARTH, F.ln(F.tan(F.radians(y) / 2 + math.pi / 4)) * EARTH
    return _to_utm(x, y, code % 100, code >= 32700)


def reprojects(out_srs: str, extension: str, source_srs: str | None) -> bool:
    """Whether reading asks for a reprojection: with a target, a source that knows its own, and a format that carries one."""
    return bool(out_srs) and bool(source_srs) and extension.lower() not in {"xyz", "ply", "las", "txt", "text"}


def soa(df: DataFrame, dims: Sequence[str] | None = None) -> DataFrame:
    """Every dimension as a float, with ``position`` (centred) and ``color`` (0 to 1, opaque)."""
    dims = list(dims or [c for c in df.columns if c != PID])
    keep = [PID] if PID in df.columns else []
    out = colour_normalised(centred(df))
    return out.select(*keep, *[F.col(d).cast("float").alias(d) for d in dims], "position", "color")


def _names(df: DataFrame, wanted: str) -> list[str] | None:
    by_lower = {c.lower(): c for c in df.columns}
    found = [by_lower.get(n.lower()) for n in wanted.split()]
    return found if all(found) else None


def centred(df: DataFrame) -> DataFrame:
    """``position``: the point less the middle of the bounds; zeros without coordinates."""
    xyz = _names(df, "X Y Z")
    if not xyz:
        return df.withColumn("position", F.array(*[F.lit(0.0).cast("float")] * 3))
    middle = df.agg(*[((F.min(d) + F.max(d)) / 2).alias(f"__c{d}") for d in xyz])
    out = with_one(df, middle).withColumn("position", F.array(*[(F.col(d) - F.col(f"__c{d}")).cast("float") for d in xyz]))
    return out.drop(*[f"__c{d}" for d in xyz])


def colour_scale(largest: Column) -> Column:
    return F.when(largest > 255, F.lit(1 / 65535)).when(largest > 1, F.lit(1 / 255)).otherwise(F.lit(1.0))


def colour_normalised(df: DataFrame) -> DataFrame:
    """``color``: red, green, blue and alpha from 0 to 1 by the largest value of all channels; opaque white without colours."""
    rgb = _names(df, "Red Green Blue")
    if not rgb:
        return df.withColumn("color", F.array(*[F.lit(1.0).cast("float")] * 4))
    largest = df.agg(F.max(F.greatest(*rgb)).alias("__most"))
    scale = colour_scale(F.col("__most"))
    return with_one(df, largest).withColumn("color", F.array(*[(F.col(c) * scale).cast("float") for c in rgb], F.lit(1.0).cast("float"))).drop("__most")


def packed_colour(df: DataFrame, root: Column | None = None) -> DataFrame:
    """``rgba``: 8 bits a channel, red lowest, opaque; 16-bit sources (by the rows of ``root``) are shifted."""
    rgb = _names(df, "Red Green Blue")
    if not rgb:
        return df.withColumn("rgba", F.lit(0xFFFFFFFF))
    most = F.greatest(*rgb)
    decided = df.agg(F.max(most if root is None else F.when(root, most)).alias("__most"))
    part = lambda c, at: F.shiftleft(F.when(F.col("__most") > 255, F.shiftright(F.col(c).cast("long"), 8)).otherwise(F.col(c).cast("long")).bitwiseAND(F.lit(255)), at)
    value = part(rgb[0], 0).bitwiseOR(part(rgb[1], 8)).bitwiseOR(part(rgb[2], 16)).bitwiseOR(F.lit(255 << 24))
    return with_one(df, decided).withColumn("rgba", value).drop("__most")


def transform_bounds(df: DataFrame, matrix: Sequence[float]) -> DataFrame:
    """The box around the eight moved corners of the points' bounds."""
    box = df.agg(*[f(d).alias(f"{n}{d}") for d in geo.XYZ for n, f in (("min", F.min), ("max", F.max))])
    corners = F.array(*[F.struct(*[F.col(f"{n}{d}").alias(d) for n, d in zip(side, geo.XYZ, strict=True)]) for side in [(a, b, c) for a in ("min", "max") for b in ("min", "max") for c in ("min", "max")]])
    moved = geo.apply_matrix(matrix, [F.col(f"c.{d}") for d in geo.XYZ])
    out = box.select(F.explode(corners).alias("c")).select(*[m.alias(d) for m, d in zip(moved, geo.XYZ, strict=True)])
    return out.agg(*[f(d).alias(f"{n}{d.lower()}") for n, f in (("min", F.min), ("max", F.max)) for d in geo.XYZ])


def scan_points(raw: DataFrame, scans: DataFrame) -> DataFrame:
    """Raw scanner points in world coordinates: spherical made cartesian, turned and moved by the scan's pose.

    Points marked invalid go; intensity is clamped to 0..1 and scaled to 16 bits.
    """
    joined = raw.join(scans, "scan_id").where(F.coalesce(F.col("invalid"), F.lit(0)) == 0)
    r, az, el = F.col("range"), F.col("azimuth"), F.col("elevation")
    ball = [r * F.cos(el) * F.cos(az), r * F.cos(el) * F.sin(az), r * F.sin(el)]
    own = [F.when(F.col("has_cartesian"), F.col(d)).otherwise(s) for d, s in zip("xyz", ball, strict=True)]
    turned = geo.rotated(geo.rotation(*[F.col(q) for q in ("qw", "qx", "qy", "qz")]), own)
    out = joined.withColumns({d: t + F.col(f"t{d.lower()}") for d, t in zip(geo.XYZ, turned, strict=True)})
    return out.withColumn("Intensity", F.floor(F.least(F.greatest(F.col("intensity"), F.lit(0.0)), F.lit(1.0)) * 65535 + 0.5).cast("int"))


@stage("filters.georeference")
def georeference(df: DataFrame, trajectory: DataFrame, bucket: float = 60.0) -> DataFrame:
    """Sensor-frame points in the world, by the last pose at or before their GPS time.

    ``trajectory`` has time, x, y, z, roll, pitch, azimuth (radians).  Points and poses
    are merged by time within buckets; a bucket starts with the last pose before it.
    """
    pose = F.struct(*[F.col(c).cast("double").alias(c) for c in ("time", "x", "y", "z", "roll", "pitch", "azimuth")])
    poses = trajectory.select(F.col("time").alias("__t"), F.floor(F.col("time") / bucket).alias("__b"), pose.alias("__pose"))
    last = poses.groupBy("__b").agg(F.max_by("__pose", "__t").alias("__last"))
    times = df.select(F.floor(F.col("GpsTime") / bucket).alias("__b")).distinct()
    every = times.join(last, "__b", "full")
    before = every.select(F.col("__b").alias("__bb"), F.last("__last", True).over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)).alias("__carry"))
    points = df.select(F.col("GpsTime").alias("__t"), F.floor(F.col("GpsTime") / bucket).alias("__b"), F.struct("*").alias("__row"))
    merged = points.unionByName(poses, allowMissingColumns=True)
    here = F.last("__pose", True).over(Window.partitionBy("__b").orderBy("__t", F.col("__row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    with_pose = merged.withColumn("__here", here).where("__row is not null").join(before, F.col("__b").eqNullSafe(F.col("__bb"))).select("__row.*", F.coalesce("__here", "__carry").alias("__p"))
    cr, sr, cp, sp, ca, sa = (f(F.col(f"__p.{a}")) for a in ("roll", "pitch", "azimuth") for f in (F.cos, F.sin))
    turn = [[ca * cp, ca * sp * sr - sa * cr, ca * sp * cr + sa * sr], [sa * cp, sa * sp * sr + ca * cr, sa * sp * cr - ca * sr], [-sp, cp * sr, cp * cr]]
    moved = geo.rotated(turn, [F.col(d) for d in geo.XYZ])
    return with_pose.where("__p is not null").withColumns({d: m + F.col(f"__p.{d.lower()}") for d, m in zip(geo.XYZ, moved, strict=True)}).drop("__p")


@stage("filters.straighten")
def straighten(df: DataFrame, polyline: Sequence[Sequence[float]], offset: float = 0.0, reverse: bool = False) -> DataFrame:
    """X as station along a polyline, Y as distance to its left, Z above it; or back."""
    stations, segments = offset, []
    for (ax, ay, az), (bx, by, bz) in zip(polyline, polyline[1:]):
        length = math.hypot(bx - ax, by - ay)
        segments.append((ax, ay, az, (bx - ax) / length, (by - ay) / length, bz - az, length, stations))
        stations += length
    x, y, z = (F.col(d) for d in geo.XYZ)
    options = []
    for k, (ax, ay, az, ux, uy, dz, length, station) in enumerate(segments):
        if reverse:
            t = x - station
            inside = F.lit(True) if len(segments) == 1 else t < length if k == 0 else t >= 0 if k == len(segments) - 1 else (t >= 0) & (t < length)
            options.append(F.when(inside, F.struct(F.lit(0.0).alias("d"), F.lit(k).alias("k"), (t * ux - y * uy + ax).alias("X"), (t * uy + y * ux + ay).alias("Y"), (z + t / length * dz + az).alias("Z"))))
        else:
            t = F.least(F.greatest((x - ax) * ux + (y - ay) * uy, F.lit(0.0)), F.lit(length))
            d = F.round(F.pow(x - ax - t * ux, 2) + F.pow(y - ay - t * uy, 2), 9)  # at a corner both segments are as near: the first one counts
            options.append(F.struct(d.alias("d"), F.lit(k).alias("k"), (t + station).alias("X"), ((y - ay) * ux - (x - ax) * uy).alias("Y"), (z - az - t / length * dz).alias("Z")))
    best = F.array_min(F.array(*options))
    return df.withColumn("__s", best).withColumns({d: F.col(f"__s.{d}") for d in geo.XYZ}).drop("__s")


WEEK, GPS_EPOCH, ADJUSTED = 604800.0, 315964800.0, 1e9


@stage("filters.gpstimeconvert")
def convert_gps_time(df: DataFrame, conversion: str, start: float = 0.0, wrapped_tolerance: float = 1.0) -> DataFrame:
    """Among ``ws`` (seconds of the week), ``gt`` (GPS seconds) and ``gst`` (those less 1e9), as ``from2to``.

    From week seconds ``start`` is the first week's begin in GPS seconds, and a
    fall by more than the tolerance begins a new week.
    """
    source, target = conversion.lower().split("2")
    time = F.col("GpsTime")
    if source == "ws":
        marked = previous(df, "GpsTime", "__prev")
        fell = F.when(F.col("__prev") - time > wrapped_tolerance, 1).otherwise(0)
        df = running(marked.withColumn("__fell", fell).drop("__prev"), F.col("__fell"), "__weeks")
        gps = time + F.col("__weeks") * WEEK + start
    else:
        gps = time + (ADJUSTED if source == "gst" else 0.0)
    out = {"gt": gps, "gst": gps - ADJUSTED, "ws": gps - F.floor(gps / WEEK) * WEEK}[target]
    return df.withColumn("GpsTime", out).drop("__fell", "__weeks")


def ramp(name: str = "pestel_shades", steps: int = 256) -> list[tuple[int, int, int]]:
    """A colour ramp of the given length between a few stops."""
    stops = {
        "pestel_shades": [(110, 160, 220), (160, 220, 160), (245, 235, 150), (230, 140, 110)], "awesome_green": [(10, 60, 20), (180, 240, 120)], "black_orange": [(0, 0, 0), (255, 140, 0)],
        "blue_orange": [(20, 60, 200), (240, 240, 240), (255, 140, 0)], "blue_red": [(20, 60, 200), (240, 240, 240), (210, 30, 30)], "heat_map": [(0, 0, 128), (0, 255, 255), (255, 255, 0), (255, 0, 0)], "blue_hue": [(8, 20, 90), (190, 220, 255)],
    }[name]
    out = []
    for k in range(steps):
        at = k / max(1, steps - 1) * (len(stops) - 1)
        i = min(int(at), len(stops) - 2)
        out.append(tuple(round(a + (b - a) * (at - i)) for a, b in zip(stops[i], stops[i + 1], strict=True)))
    return out


@stage("filters.colorinterp")
def colour_ramp(df: DataFrame, dimension: str = "Z", minimum: float | None = None, maximum: float | None = None, ramp_name: str = "pestel_shades", clamp: bool = False, invert: bool = False, k: float = 0.0, mad: bool = False, steps: int = 256) -> DataFrame:
    """Red, Green and Blue from a dimension's place in its range; points outside keep theirs unless clamped.

    The range: given, or the extremes, or k standard deviations around the mean
    (with ``mad`` k scaled median absolute deviations around the median).
    """
    v = F.col(dimension)
    if k and mad:
        mid = with_one(df, df.agg(F.median(dimension).alias("__mid")))
        one = with_one(mid, mid.agg(F.median(F.abs(v - F.col("__mid"))).alias("__mad"))).withColumns({"__lo": F.col("__mid") - F.col("__mad") * (k * 1.4826), "__hi": F.col("__mid") + F.col("__mad") * (k * 1.4826)}).drop("__mid", "__mad")
    elif k:
        one = with_one(df, df.agg((F.avg(dimension) - F.stddev(dimension) * k).alias("__lo"), (F.avg(dimension) + F.stddev(dimension) * k).alias("__hi")))
    else:
        one = with_one(df, df.agg((F.lit(minimum).cast("double") if minimum is not None else F.min(dimension)).alias("__lo"), (F.lit(maximum).cast("double") if maximum is not None else F.max(dimension)).alias("__hi")))
    share = (v - F.col("__lo")) / F.when(F.col("__hi") > F.col("__lo"), F.col("__hi") - F.col("__lo"))
    inside = (share >= 0) & (share <= 1)
    share = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    at = F.floor((1 - share if invert else share) * (steps - 1) + 0.5).cast("int") + 1
    colours = ramp(ramp_name, steps)
    new = {}
    for c, name in enumerate(("Red", "Green", "Blue")):
        value = F.element_at(F.array(*[F.lit(x[c]) for x in colours]), at)
        new[name] = value if clamp else F.when(inside, value).otherwise(F.col(name) if name in df.columns else F.lit(0))
    return one.withColumns(new).drop("__lo", "__hi")


def cell_of(px: float, py: float, x0: float, y0: float) -> tuple[Column, Column]:
    """Column and row of a raster whose upper left corner is (x0, y0)."""
    return F.floor((F.col("X") - x0) / px).cast("long"), F.floor((y0 - F.col("Y")) / py).cast("long")


@stage("filters.colorization")
def colorize(df: DataFrame, raster: DataFrame, bands: Sequence[str], x0: float = 0.0, y0: float = 0.0, px: float = 1.0, py: float = 1.0) -> DataFrame:
    """Raster bands (cells ``col``, ``row``, a column a band) sampled at X and Y: ``Dimension:band:scale``.  Points without a cell are kept as they are."""
    i, j = cell_of(px, py, x0, y0)
    cells = raster.select(F.col("col").alias("__i"), F.col("row").alias("__j"), F.struct(*[c for c in raster.columns if c not in ("col", "row")]).alias("__cell"))
    out = df.withColumns({"__pi": i, "__pj": j}).join(cells, (F.col("__pi") == F.col("__i")) & (F.col("__pj") == F.col("__j")), "left")
    for spec in bands:
        name, band, scale = (spec.split(":") + ["1.0"])[:3]
        old = F.col(name) if name in df.columns else F.lit(0.0)
        out = out.withColumn(name, F.coalesce(F.col(f"__cell.{band}") * float(scale), old))
    return out.drop("__pi", "__pj", "__i", "__j", "__cell")


def hex_cell(edge: float, x: Column | None = None, y: Column | None = None) -> tuple[Column, Column]:
    """Axial coordinates of the flat-topped hexagon of the given edge around X and Y."""
    x, y = F.col("X") if x is None else x, F.col("Y") if y is None else y
    q = x * (2 / 3) / edge
    r = (y * math.sqrt(3) / 3 - x / 3) / edge
    s = -q - r
    half = lambda v: F.floor(v + 0.5)
    rq, rr, rs = half(q), half(r), half(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    fq = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    fr = F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr)
    return fq.cast("long"), fr.cast("long")


@stage("filters.hexbin")
def hexbin(df: DataFrame, edge_length: float, threshold: int = 1) -> DataFrame:
    """(q, r, n): hexagons with at least ``threshold`` points."""
    q, r = hex_cell(edge_length)
    return df.select(q.alias("q"), r.alias("r")).groupBy("q", "r").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= threshold)


def hex_boundary(cells: list[tuple[int, int]], edge: float) -> list[list[tuple[float, float]]]:
    """Rings around the given hexagons: edges that only one of them has, put end to end."""
    have, sides = set(cells), {}
    corner = lambda q, r, k: (round(edge * (1.5 * q + math.cos(math.pi / 3 * k)), 9), round(edge * (math.sqrt(3) * (r + q / 2) + math.sin(math.pi / 3 * k)), 9))
    for q, r in have:
        for k, (dq, dr) in enumerate(((1, 0), (0, 1), (-1, 1), (-1, 0), (0, -1), (1, -1))):
            if (q + dq, r + dr) not in have:
                sides.setdefault(corner(q, r, k), []).append(corner(q, r, k + 1))
    rings = []
    while sides:
        at = start = next(iter(sides))
        ring = [at]
        while True:
            to = sides[at].pop()
            if not sides[at]:
                del sides[at]
            ring.append(to)
            at = to
            if at == start:
                break
        rings.append(ring)
    return rings


@stage("filters.h3")
def h3_cells(df: DataFrame, resolution: int = 9) -> DataFrame:
    """The ``H3`` cell of X, Y in degrees; needs the optional h3 library."""
    import h3  # optional
    import pandas as pd

    @F.pandas_udf("long")
    def cell(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([int(h3.latlng_to_cell(b, a, resolution), 16) for a, b in zip(x, y, strict=True)])

    return df.withColumn("H3", cell("X", "Y"))


def with_morton(df: DataFrame, dims: Sequence[str] = geo.XYZ) -> DataFrame:
    """``morton``: the key of each point within the bounds of all."""
    box = df.agg(*[f(d).alias(f"__{n}{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))])
    keys = [bits.grid10(F.col(d), F.col(f"__lo{d}"), F.col(f"__hi{d}")) for d in dims]
    keys += [F.lit(0)] * (3 - len(keys))
    return with_one(df, box).withColumn("morton", bits.morton(*keys)).drop(*[f"__{n}{d}" for d in dims for n in ("lo", "hi")])


@stage("filters.mortonorder")
def morton_order(df: DataFrame, reverse: bool = False) -> DataFrame:
    """Points in Z order; with ``reverse`` by the key's bits read backwards, which scatters them."""
    keyed = with_morton(df)
    key = F.col("morton")
    if reverse:
        key = reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(F.shiftright(key, k).bitwiseAND(F.lit(1)), 29 - k) for k in range(30)])
    return keyed.withColumn("morton", key).orderBy("morton", PID)


def quantised(df: DataFrame, scale: float = 0.001, offset: str | Sequence[float] = "auto") -> DataFrame:
    """Coordinates as 32-bit numbers ``Xq``, ``Yq``, ``Zq`` and the values they stand for; an overflow is an error."""
    if offset == "auto":
        box = df.agg(*[F.min(d).alias(f"__o{d}") for d in geo.XYZ])
        df = with_one(df, box)
    else:
        df = df.withColumns({f"__o{d}": F.lit(float(o)) for d, o in zip(geo.XYZ, offset, strict=True)})
    for d in geo.XYZ:
        q = F.floor((F.col(d) - F.col(f"__o{d}")) / scale + 0.5)
        df = df.withColumn(f"{d}q", F.when(F.abs(q) < 2**31, q.cast("int")).otherwise(F.raise_error(F.lit(f"{d} doesn't fit 32 bits at this scale")).cast("int")))
        df = df.withColumn(d, F.col(f"{d}q") * scale + F.col(f"__o{d}"))
    return df.drop(*[f"__o{d}" for d in geo.XYZ])
