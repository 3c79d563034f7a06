"""Filters that keep, drop or pick points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import expression as ex
from plumbline.functions.geometry import box_contains, polygon_contains
from plumbline.operators.order import PID, ordinal, quantiles, with_one
from plumbline.plans.registry import stage


@stage("filters.range")
def keep_ranges(df: DataFrame, limits: str) -> DataFrame:
    return df.where(ex.ranges(limits))


@stage("filters.expression")
def keep_expression(df: DataFrame, expression: str) -> DataFrame:
    return df.where(ex.condition(expression))


@stage("filters.mongoexpression")
def keep_mongo(df: DataFrame, expression: str | dict) -> DataFrame:
    return df.where(ex.mongo(expression))


def drop_nodata(df: DataFrame, value: float = -9999.0, dimension: str = "Z") -> DataFrame:
    return df.where(F.col(dimension) != value)


@stage("filters.crop")
def crop(df: DataFrame, bounds: Sequence[Sequence[float]] | None = None, polygon: Sequence[Sequence[float]] | None = None, point: Sequence[float] | None = None, distance: float = 0.0, outside: bool = False) -> DataFrame:
    """Points in any of: a box (rows low, high; two or three axes), a polygon in X and Y, a ball around a point."""
    tests: list[Column] = []
    if bounds is not None:
        tests.append(box_contains(*bounds))
    if polygon is not None:
        tests.append(polygon_contains(polygon, F.col("X"), F.col("Y")))
    if point is not None:
        near = [(F.col(d) - float(c)) * (F.col(d) - float(c)) for d, c in zip("XYZ", point, strict=False)]
        box = box_contains([c - distance for c in point], [c + distance for c in point])
        tests.append(box & (sum(near[1:], near[0]) <= distance * distance))
    inside = F.lit(False)
    for t in tests:
        inside = inside | t
    return df.where(~inside if outside else inside)


def return_class() -> Column:
    n, r = F.col("NumberOfReturns"), F.col("ReturnNumber")
    return F.when(n == 1, "only").when(r == 1, "first").when(r == n, "last").otherwise("intermediate")


@stage("filters.returns")
def split_returns(df: DataFrame, groups: Sequence[str] = ("first", "last", "intermediate", "only")) -> DataFrame:
    """Points of the asked return classes, named in ``view``."""
    return df.withColumn("view", return_class()).where(F.col("view").isin(*groups))


@stage("filters.iqr")
def keep_iqr(df: DataFrame, dimension: str, k: float = 1.5) -> DataFrame:
    """Points within k interquartile ranges of the quartiles (linear interpolation)."""
    q1, q3 = quantiles(df, dimension, [0.25, 0.75])
    if q1 is None:
        return df.where("false")
    return df.where(F.col(dimension).between(q1 - k * (q3 - q1), q3 + k * (q3 - q1)))


@stage("filters.mad")
def keep_mad(df: DataFrame, dimension: str, k: float = 2.0, mad_multiplier: float = 1.4826) -> DataFrame:
    """Points within k scaled median absolute deviations of the median."""
    middle = quantiles(df, dimension, [0.5])[0]
    if middle is None:
        return df.where("false")
    off = F.abs(F.col(dimension) - middle)
    return df.where(off <= k * mad_multiplier * quantiles(df.select(off.alias("off")), "off", [0.5])[0])


@stage("filters.locate")
def locate(df: DataFrame, dimension: str, minmax: str = "max") -> DataFrame:
    order = F.desc(dimension) if minmax == "max" else F.asc(dimension)
    return df.orderBy(order, PID).limit(1)


@stage("filters.head")
def head(df: DataFrame, count: int = 10, invert: bool = False) -> DataFrame:
    if not invert:
        return df.orderBy(PID).limit(count)
    return ordinal(df, name="__rn").where(F.col("__rn") >= count).drop("__rn")


@stage("filters.tail")
def tail(df: DataFrame, count: int = 10, invert: bool = False) -> DataFrame:
    if not invert:
        return df.orderBy(F.desc(PID)).limit(count)
    total = df.agg(F.count(F.lit(1)).alias("__total"))
    return with_one(ordinal(df, name="__rn"), total).where(F.col("__rn") < F.col("__total") - count).drop("__rn", "__total")


@stage("filters.decimation")
def decimate(df: DataFrame, step: float = 1.0, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Every ``step``-th point from ``offset`` to before ``limit``; a broken step keeps the first point of each."""
    place = F.col("__rn") - offset
    kept = F.col("__rn") >= offset
    if limit is not None:
        kept = kept & (F.col("__rn") < limit)
    step = float(step)
    own = place % int(step) == 0 if step == int(step) else F.ceil(F.ceil(place / step) * step) == place
    return ordinal(df, name="__rn").where(kept & own).drop("__rn")


@stage("filters.info")
def nearest_to(df: DataFrame, x: float, y: float, z: float | None = None, count: int = 10) -> DataFrame:
    """The points nearest to a place, in two dimensions without z, with their ``distance``."""
    parts = [(F.col(d) - float(c)) * (F.col(d) - float(c)) for d, c in zip("XYZ", (x, y, z), strict=True) if c is not None]
    return df.withColumn("distance", F.sqrt(sum(parts[1:], parts[0]))).orderBy("distance", PID).limit(count)


def frustum(matrix: Sequence[float]) -> Column:
    """Whether a point lies in the view volume of a row-major matrix, with depth from 0 to w."""
    m = [list(map(float, matrix[4 * r : 4 * r + 4])) for r in range(4)]
    planes = [[m[3][k] + s * m[r][k] for k in range(4)] for r in (0, 1) for s in (1, -1)] + [m[2], [m[3][k] - m[2][k] for k in range(4)]]
    inside = F.lit(True)
    for a, b, c, d in planes:
        inside = inside & (F.col("X") * a + F.col("Y") * b + F.col("Z") * c + d >= 0)
    return inside


def frustum_boxes(matrix: Sequence[float]) -> Column:
    """Whether a box min/max XYZ may touch the view volume: its corner farthest along each plane is inside."""
    m = [list(map(float, matrix[4 * r : 4 * r + 4])) for r in range(4)]
    planes = [[m[3][k] + s * m[r][k] for k in range(4)] for r in (0, 1) for s in (1, -1)] + [m[2], [m[3][k] - m[2][k] for k in range(4)]]
    inside = F.lit(True)
    for *normal, d in planes:
        corner = [F.col(("max" if v >= 0 else "min") + axis) * v for v, axis in zip(normal, "XYZ", strict=True)]
        inside = inside & (corner[0] + corner[1] + corner[2] + d >= 0)
    return inside
