"""Mixing sources to target weights by Poisson replication, in DataFrame functions alone.

A source with ``c`` rows and the share ``w`` of the target gets the repetition
rate ``w * total / c``.  Each document's count is the inverse of the Poisson
distribution with that mean at a uniform number hashed from seed, id, text and
the row's number among equal rows, so that it doesn't depend on partitions,
retries or other documents.  Rows are repeated by their counts and dealt out
by a hash of row, number and copy.

Equal rows are found by counts of 128-bit hashes, summed before the shuffle;
each set of them is then held as one row with its count and unfolded again in
steps of ``STEP`` numbers that are dealt to all tasks, so a row that is there
a billion times takes no task of its own.

A rate above ``PART`` is made up of several independent draws of smaller rates
(sums of Poisson numbers are Poisson), so a source's table of the distribution
function stays short at any rate.

Defined cases: a null source is a source of its own; a source without a weight
in ``weights`` gets none and its rows go; rows that share an id, or have none,
and equal rows too, are drawn independently; a null id or text hashes as an
empty one; an empty table gives an empty one; a column of the input named as
``copy`` is replaced, others keep their names and values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import stored

#: Equal rows that are drawn in one place.
STEP = 1000
PART = 64.0
#: A table of so many sources at most, each of under 2 kB, is sent to all tasks; a longer one is joined by shuffle.
BROADCAST_SOURCES = 4096


def uniform(*parts: Column) -> Column:
    """A number within (0, 1) from the first 52 bits of the parts' MD5."""
    text = F.concat_ws(":", *parts)
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def distribution(mean: Column) -> Column:
    """P(N <= k) for k from 0 until it's 1 but for rounding; sums of exponentials of logarithms."""
    most = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    first = F.struct((-mean).alias("log"), F.exp(-mean).alias("sum"), F.array(F.exp(-mean)).alias("all"))

    def step(state: Column, k: Column) -> Column:
        log = state["log"] + F.ln(mean) - F.ln(k.cast("double"))
        total = state["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.concat(state["all"], F.array(total)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), most), first, step)["all"]


def rates(docs: DataFrame, source: str, weights: DataFrame | None, size: float) -> DataFrame:
    """Per source: ``source``, its ``parts`` and the ``cdf`` of one part; ``size``: rows of the result by rows of the input."""
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("rows"))
    if weights is None:
        weighed = counts.withColumn("weight", F.lit(1.0))
    else:
        w = weights.groupBy(F.col("source").alias("w_source")).agg(F.sum(F.col("weight").cast("double")).alias("weight"))
        weighed = counts.join(w, F.col("source").eqNullSafe(F.col("w_source"))).drop("w_source").where("weight > 0")
    sums = weighed.agg(F.sum("rows"), F.sum("weight"), F.count(F.lit(1))).first()
    rows, weight = float(sums[0] or 0), float(sums[1] or 1)
    rate = F.lit(rows * size) / F.lit(weight) * F.col("weight") / F.col("rows")
    parts = F.greatest(F.lit(1), F.ceil(rate / PART)).cast("int")
    table = weighed.select("source", parts.alias("parts"), (rate / parts).alias("mean")).select("source", "parts", distribution(F.col("mean")).alias("cdf"))
    return F.broadcast(table) if sums[2] <= BROADCAST_SOURCES else table


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``number``, from 1, among those of equal hashes h1, h2."""
    equal = stored(rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), name + "/equal")
    if equal.isEmpty():
        return rows.withColumn("number", F.lit(1).cast("long"))
    single = rows.join(equal, ["h1", "h2"], "left_anti").withColumn("number", F.lit(1).cast("long"))
    others = [c for c in rows.columns if c not in ("h1", "h2")]
    sets = rows.join(equal, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("times"), *[F.first(c).alias(c) for c in others])
    steps = sets.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("times") - 1) / STEP).cast("long")))).repartition("h1", "h2", "step")
    number = F.explode(F.sequence(F.col("step") * STEP + 1, F.least(F.col("times"), (F.col("step") + 1) * STEP)))
    return single.unionByName(steps.withColumn("number", number).select(*rows.columns, "number"))


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, source: str = "source", key: str = "doc_id", size: float = 1.0, seed: int = 2024, text: str = "text", name: str = "mixing", copy: str | None = "copy") -> DataFrame:
    """``docs`` with each row repeated, and its number ``copy`` (from 1), in a global random order.

    ``weights`` (source, weight) are targets by rows; without them all sources weigh the same.
    With no name for ``copy`` the columns stay those of ``docs``.
    """
    table = rates(docs, source, weights, size)
    columns = [docs[c] for c in docs.columns if copy is None or c.lower() != copy.lower()]
    whole = F.struct(*columns)
    id_text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(docs[key].cast("string"), F.lit("")), F.md5(F.coalesce(docs[text].cast("string"), F.lit(""))))
    rows = docs.select(whole.alias("row"), docs[source].alias("own"), id_text.alias("id_text"), F.xxhash64(F.lit(1), whole).alias("h1"), F.xxhash64(F.lit(2), whole).alias("h2"))
    joined = numbered(rows, name).join(table, F.col("own").eqNullSafe(F.col("source")))
    draws = F.transform(
        F.sequence(F.lit(1), F.col("parts")),
        lambda part: F.size(F.filter("cdf", lambda p: p < uniform(F.col("id_text"), F.col("number"), part))),
    )
    counted = joined.select("row", "h1", "h2", "number", F.aggregate(draws, F.lit(0), lambda a, b: a + b).alias("copies")).where("copies > 0")
    spread = counted.select("row", "h1", "h2", "number", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("nth"))
    order = F.xxhash64(F.lit(seed + 1), F.col("h1"), F.col("h2"), F.col("number"), F.col("nth"))
    out = spread.withColumn("order", order).repartition("order").sortWithinPartitions("order")
    return out.select("row.*", *([F.col("nth").alias(copy)] if copy else []))


ORACLE = """
WITH n AS (SELECT source, count(*) AS c FROM documents GROUP BY source),
r AS (SELECT source, (SELECT sum(c) FROM n)::DOUBLE / (SELECT count(*) FROM n) / c AS rate FROM n),
p AS (SELECT source, greatest(1, ceil(rate / 64)) AS parts, rate / greatest(1, ceil(rate / 64)) AS mean FROM r),
k AS (SELECT source, mean, unnest(range(0, (ceil(mean + 12 * sqrt(mean) + 30))::BIGINT + 1)) AS k FROM p),
l AS (SELECT source, k, sum(CASE WHEN k = 0 THEN -mean ELSE ln(mean) - ln(k) END) OVER (PARTITION BY source ORDER BY k) AS lp FROM k),
c AS (SELECT source, list(cdf ORDER BY k) AS cdf FROM (SELECT source, k, sum(exp(lp)) OVER (PARTITION BY source ORDER BY k) AS cdf FROM l) GROUP BY source),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text, lang, source, n_chars) AS number FROM documents),
d AS (SELECT o.*, unnest(range(1, parts::BIGINT + 1)) AS part, cdf FROM o JOIN p ON o.source IS NOT DISTINCT FROM p.source JOIN c ON o.source IS NOT DISTINCT FROM c.source),
u AS (SELECT doc_id, text, lang, source, n_chars, number, cdf, (('0x' || substr(md5('2024:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) || ':' || number || ':' || part), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u FROM d),
m AS (SELECT doc_id, text, lang, source, n_chars, number, sum(len(list_filter(cdf, lambda x: x < u))) AS copies FROM u GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, copies::BIGINT + 1))::INTEGER AS copy FROM m WHERE copies > 0
"""
