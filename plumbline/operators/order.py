"""Ordinals: the place of each row in a total order, without a sort in one task.

Rows are put in buckets that follow the order's first column; a window numbers
each bucket, and the buckets' counts, a small table, give its offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Input order, a number that no two rows share.
PID = "pid"
#: Values of the first column in one bucket.
BUCKET = 1 << 16


def bucket(column: str, width: int) -> Column:
    """The bucket of a value; of null, one before all others."""
    return F.coalesce(F.floor(F.col(column) / F.lit(width)), F.lit(-(1 << 62)))


def ordinal(df: DataFrame, *order: str, name: str = "rn", width: int = BUCKET, keep: bool = False) -> DataFrame:
    """``df`` with ``name``, from 0: the row's place by the columns of ``order`` (by pid without any).

    With ``keep`` the column ``__bucket`` stays, by which the rows are partitioned.
    """
    order = order or (PID,)
    bucketed = df.withColumn("__bucket", bucket(order[0], width))
    counts = bucketed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col("__bucket").alias("__b"), F.coalesce(before, F.lit(0)).alias("__before"))  # a row a bucket
    place = F.row_number().over(Window.partitionBy("__bucket").orderBy(*order)) - 1
    numbered = bucketed.withColumn("__place", place).join(offsets, F.col("__bucket") == F.col("__b"))
    return numbered.withColumn(name, F.col("__place") + F.col("__before")).drop("__b", "__place", "__before", *([] if keep else ["__bucket"]))


def with_pid(df: DataFrame, *order: str, width: int = BUCKET, keep: bool = False) -> DataFrame:
    """``df`` with ``pid``, from 1, by a total order."""
    return ordinal(df, *order, name="__rn", width=width, keep=keep).withColumn(PID, (F.col("__rn") + 1).cast("long")).drop("__rn")


def running(df: DataFrame, value: Column, name: str, width: int = BUCKET, order: str = PID) -> DataFrame:
    """``df`` with the running sum of ``value`` in input order, by the same two passes."""
    bucketed = df.withColumns({"__bucket": bucket(order, width), "__v": value})
    sums = bucketed.groupBy("__bucket").agg(F.sum("__v").alias("__s"))
    before = F.sum("__s").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(F.col("__bucket").alias("__b"), F.coalesce(before, F.lit(0)).alias("__before"))
    here = F.sum("__v").over(Window.partitionBy("__bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    joined = bucketed.withColumn("__here", here).join(offsets, F.col("__bucket") == F.col("__b"))
    return joined.withColumn(name, F.col("__here") + F.col("__before")).drop("__bucket", "__b", "__v", "__here", "__before")


def previous(df: DataFrame, column: str, name: str, width: int = BUCKET, order: str = PID) -> DataFrame:
    """``df`` with the value of ``column`` in the row before, null in the first.

    A bucket's first row takes it from the last row of the bucket before that has rows.
    """
    bucketed = df.withColumn("__bucket", bucket(order, width))
    last = bucketed.groupBy("__bucket").agg(F.max_by(column, order).alias("__last"))
    ends = last.select(F.col("__bucket").alias("__b"), F.lag("__last").over(Window.orderBy("__bucket")).alias("__end"))
    w = Window.partitionBy("__bucket").orderBy(order)
    joined = bucketed.withColumns({"__lag": F.lag(column).over(w), "__n": F.row_number().over(w)}).join(ends, F.col("__bucket") == F.col("__b"))
    return joined.withColumn(name, F.when(F.col("__n") == 1, F.col("__end")).otherwise(F.col("__lag"))).drop("__bucket", "__b", "__end", "__lag", "__n")


def with_one(df: DataFrame, one: DataFrame) -> DataFrame:
    """``df`` with the columns of a table of exactly one row."""
    return df.join(F.broadcast(one.withColumn("__one", F.lit(True))), F.lit(True)).drop("__one")


#: Rows of which one aggregate may hold all distinct values.
EXACT_ROWS = 5_000_000


def quantiles(df: DataFrame, column: str, shares: list[float], exact_rows: int = EXACT_ROWS) -> list[float | None]:
    """Exact quantiles with linear interpolation, NaN and null left out.

    Beyond ``exact_rows`` rows an approximate quantile gives an interval that
    holds the wanted order statistics; only its rows go on, until few are left.
    """
    v = F.col(column).cast("double")
    rows = df.select(v.alias("v")).where(v.isNotNull() & ~F.isnan(v))
    n = rows.count()
    if not n:
        return [None for _ in shares]
    if n <= exact_rows:
        return list(rows.agg(F.percentile("v", F.array(*map(F.lit, shares)))).first()[0])
    return [_refined(rows, n, s, exact_rows) for s in shares]


def medians(df: DataFrame, columns: list[str], exact_rows: int = EXACT_ROWS) -> list[float | None]:
    """Exact medians of several columns, NaN and null left out; one pass for all of them up to ``exact_rows`` rows."""
    if df.count() > exact_rows:
        return [quantiles(df, c, [0.5], exact_rows)[0] for c in columns]
    v = [F.col(c).cast("double") for c in columns]
    return list(df.agg(*[F.median(F.when(~F.isnan(x), x)) for x in v]).first())


def _refined(rows: DataFrame, n: int, share: float, exact_rows: int) -> float:
    place = share * (n - 1)
    low = int(place)
    below, size, inner, error = 0, n, rows, 0.001
    while size > max(exact_rows, 1000):
        at = (low - below) / max(size - 1, 1)
        a, b = inner.approxQuantile("v", [max(0.0, at - 2 * error), min(1.0, at + 2 * error)], error)
        counts = inner.agg(F.count_if(F.col("v") < a), F.count_if(F.col("v") <= b)).first()
        if counts[0] > low - below or counts[1] <= low - below or counts[1] - counts[0] >= size:
            break  # equal values fill the interval
        below, size, inner = below + counts[0], counts[1] - counts[0], inner.where(F.col("v").between(a, b))
    ranked = inner.groupBy("v").agg(F.count(F.lit(1)).alias("n")).orderBy("v")
    need, seen, found = [low - below, low - below + 1], 0, []
    for r in ranked.toLocalIterator():  # distinct values, from the smallest on
        seen += r.n
        while len(found) < 2 and seen > need[len(found)]:
            found.append(r.v)
        if len(found) == 2:
            break
    if len(found) < 2:
        above = rows.where(F.col("v") > found[0]).agg(F.min("v")).first()[0] if found and low + 1 < n else None
        found.append(found[0] if above is None else above)
    part = place - low
    return found[0] * (1 - part) + found[1] * part
