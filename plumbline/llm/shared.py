"""The shared folder, tables written there, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one is made only where none is set and all tasks run in this process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Bytes of a batch that goes to Python.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session sends Python batches of at most ``BATCH_BYTES`` from now on: rows are whole texts here."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = str(df.sparkSession.conf.get(name)).rstrip("bB")
    if not given.isdigit() or int(given) > BATCH_BYTES:
        df.sparkSession.conf.set(name, str(BATCH_BYTES))
    return spread(df)


def spread(df: DataFrame) -> DataFrame:
    """``df``; rows read from fewer files and splits than there are cores are dealt to all of them, as Python is what takes time here.

    A table of many splits, as any large one has, stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if not 0 < len(df._jdf.inputFiles()) < cores or "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    if df.rdd.getNumPartitions() > cores:
        return df
    return df.repartition(cores, F.xxhash64(*[F.col(c) for c in df.columns]))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there, and lost executors don't cost it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_parts(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """Frames of one schema, one at least, written one after another to one folder, and read back as one."""
    path = None
    for df in parts:
        path = path or f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
        df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that are made and written inside leave no shuffle files behind; else these stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    given = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if given is None else spark.conf.set(name, given)


#: Up to so many links one task finishes the components; more are first contracted by rounds of joins.
ONE_TASK_LINKS = 500_000


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links and the smallest node of its component."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch's links (a, b) a star by component: as connected, at most one link a node."""
    for batch in batches:
        nodes, roots = _forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        links = nodes != roots
        yield pa.RecordBatch.from_arrays([pa.array(nodes[links]), pa.array(roots[links])], ["a", "b"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if parts:
        nodes, roots = _forest(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["node", "root"])


def components(links: DataFrame, name: str, one_task: int = ONE_TASK_LINKS) -> DataFrame:
    """(node, root) for every node of the links (a, b: long); root is the component's smallest node.

    Rounds of hooking to the smallest neighbour and of pointer jumping, each
    written to the shared folder, until no label changes.  When the links that
    still join different labels are few, one task finishes them; that changes
    the time, not the result.
    """
    star = stored(links.select("a", "b").where("a <> b").mapInArrow(spanning, "a bigint, b bigint"), name + "/links")
    if star.count() <= one_task:
        return stored(star.coalesce(1).mapInArrow(_finish, "node bigint, root bigint"), name + "/components")
    both = stored(star.union(star.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), name + "/both")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), name + "/labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        hooked = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("new"))
        onto = hooked.groupBy(F.col("root").alias("at")).agg(F.min("new").alias("to"))  # a root hooks as its lowest member does
        jumped = hooked.join(onto, F.col("new") == F.col("at"), "left").select("node", "root", F.least("new", F.coalesce("to", "new")).alias("new"))
        step = stored(jumped, name + "/labels")
        if step.where("new <> root").isEmpty():
            return step.select("node", F.col("new").alias("root"))
        labels = step.select("node", F.col("new").alias("root"))


def block_pairs(rows: DataFrame, group: list[str], member: str, size: int, blocks: DataFrame | None = None) -> DataFrame:
    """``rows`` with (blocks, block, other, low): every two rows of a group meet under one pair (block, other); in a pair of two blocks ``low`` tells them apart.

    A group of n rows has ceil(n / size) blocks, or as many as ``blocks`` says,
    so that even a huge one is never in one task; each row goes to as many
    pairs as there are blocks.  The numbers of groups with several blocks, few
    and small, are written first: the join with them can then be a broadcast or,
    where they are many, be split at large groups.
    """
    counts = rows.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("blocks")) if blocks is None else blocks
    counts = stored(counts.where("blocks > 1").select(*[F.col(g).alias(f"__{g}") for g in group], F.col("blocks").alias("__n")), "blocks")
    same = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group]
    joined = rows.join(counts, same, "left").withColumn("__blocks", F.coalesce("__n", F.lit(1))).drop("__n", *[f"__{g}" for g in group])
    mine = F.pmod(F.xxhash64(F.lit(5), F.col(member)), F.col("__blocks")).cast("int")
    every = joined.withColumn("__mine", mine).withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    return every.withColumns({"block": F.least("__mine", "__other"), "other": F.greatest("__mine", "__other"), "low": F.col("__mine") <= F.col("__other"), "blocks": F.col("__blocks")}).drop("__blocks", "__mine", "__other")


#: 64-bit words of the largest Bloom filter, a row of 16 bytes each; it has 16 bits a key or more, or isn't used.
BLOOM_WORDS = 1 << 20


def _spots(key: Column, words: int) -> list[Column]:
    return [F.pmod(k, F.lit(words * 64)) for k in (key, F.shiftrightunsigned(key, 32))]


def only_in(df: DataFrame, key: Column, keys: DataFrame, count: int) -> DataFrame:
    """Rows of ``df`` whose hash may be among the ``count`` hashes ``k``: none of those is lost, and few others stay.

    The filter's size follows ``count``; where it would be too large to be sent
    to all tasks the rows come back as they are.
    """
    words = 1 << max(4, (max(count, 1) // 4 - 1).bit_length())
    if words > BLOOM_WORDS:
        return df
    spots = keys.select(F.explode(F.array(*_spots(F.col("k"), words))).alias("spot"))
    table = spots.groupBy(F.shiftright("spot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("bits"))
    out = df
    for n, spot in enumerate(_spots(key, words)):
        own = F.broadcast(table.select(F.col("word").alias(f"__w{n}"), F.col("bits").alias(f"__b{n}")))
        out = out.withColumn(f"__s{n}", spot).join(own, F.shiftright(F.col(f"__s{n}"), 6) == F.col(f"__w{n}"))
        out = out.where(F.expr(f"shiftrightunsigned(__b{n}, cast(__s{n} & 63 as int)) & 1") == 1)
    return out.select(*df.columns)
