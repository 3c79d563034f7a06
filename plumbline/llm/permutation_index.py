"""Approximate nearest neighbours by a permutation index.

Pivots are a bounded, hashed sample of the vectors, scaled to length one.
Every vector is stood for by its ``PREFIX`` nearest pivots in order.  In a
block of the index each pivot has an inverted file of (row, place).  For
prefixes of length m the induced footrule distance of two vectors is a constant
less twice the sum of m - max(place, place') over the pivots they share, so
walking the files of the queries' pivots ranks a block's rows.  A footrule
stands for an angle; where lengths differ, a straight line fitted to some
exact cosines of the block turns it into one, and rows are ranked by that times
their length.  The first ``SHARE`` of a block (``LEAST`` times the wanted
neighbours, if that's more), with all ties at the border, are reranked by the
inner product.

Queries are a stated set of rows; blocks of queries meet blocks of the index,
and a block gives ``k`` rows a query at most.

Defined cases: vectors that are null, zero or hold null or non-finite
components take no part, nor do those of another length than most; rows that
share an id are all in the index, but as queries they count once (the one with
the smallest vector) and never as their own neighbours; a null id is no query
and no candidate; ties go to the smaller id; an empty table gives an empty one;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.embedding_dedup import dense, usable
from plumbline.llm.shared import stored

PIVOTS, PREFIX, SHARE = 512, 64, 0.2
INDEX_BLOCK, QUERY_BLOCK = 4096, 1024
#: Rows of a block that are reranked at least, by wanted neighbours.
LEAST = 10
#: Queries and rows from whose products the line is fitted.
FITTED = (32, 256)


def footrule_scores(queries: np.ndarray, rows: np.ndarray, pivots: int) -> np.ndarray:
    """Sums of m - max(place, place') over shared pivots, of queries by rows; both are prefixes of pivot numbers."""
    m = rows.shape[1]
    out = np.zeros((len(queries), len(rows)), np.float32)
    postings = []
    for prefixes in (queries, rows):
        order = np.argsort(prefixes, axis=None, kind="stable")
        postings.append((order // m, (order % m).astype(np.float32), np.searchsorted(prefixes.ravel()[order], np.arange(pivots + 1))))
    (qi, qplace, qcut), (xi, xplace, xcut) = postings
    for p in range(pivots):
        a, b = slice(qcut[p], qcut[p + 1]), slice(xcut[p], xcut[p + 1])
        if a.stop > a.start and b.stop > b.start:
            out[np.ix_(qi[a], xi[b])] += m - np.maximum(qplace[a][:, None], xplace[b][None, :])
    return out


def by_length(scores: np.ndarray, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Estimates of the inner products by the scores, up to a factor for each query; the scores where all rows have one length."""
    lengths = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    if lengths.max() <= lengths.min() * (1 + 1e-5):
        return scores
    a, b = FITTED
    some = rows[:b] / lengths[:b, None]
    asked = queries[:a] / np.sqrt(np.einsum("ij,ij->i", queries[:a], queries[:a]))[:, None]
    slope, base = np.polyfit(scores[:a, :b].ravel().astype(np.float64), (asked @ some.T).ravel(), 1)
    return ((base + max(slope, 1e-9) * scores) * lengths[None, :]).astype(np.float32)


def search(queries: DataFrame, index: DataFrame, pivots: np.ndarray, k: int, share: float = SHARE, prefix: int = PREFIX, name: str = "permutation_index") -> DataFrame:
    """(query_id, vec_id, score): ``k`` rows a query and block at most; both inputs have (id, vec: array of doubles)."""
    shared = index.sparkSession.sparkContext.broadcast(pivots)
    m = min(prefix, len(pivots))

    def prefixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            flat, offsets = dense(batch.column(1))
            like = np.diff(offsets) == p.shape[1]
            part = batch.filter(pa.array(like))
            x = flat[np.repeat(like, np.diff(offsets))].reshape(-1, p.shape[1])
            near = np.argsort(-(x @ p.T), 1, kind="stable")[:, :m].astype(np.int16)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([v.tobytes() for v in x], pa.binary()), pa.array([v.tobytes() for v in near], pa.binary())], ["id", "vec", "prefix"])

    kind = index.schema["id"].dataType.simpleString()
    posted = stored(index.select("id", "vec").mapInArrow(prefixed, f"id {kind}, vec binary, prefix binary"), name + "/index")
    asked = stored(queries.select("id", "vec").mapInArrow(prefixed, f"id {kind}, vec binary, prefix binary"), name + "/queries")
    blocks = max(1, -(-posted.count() // INDEX_BLOCK))
    groups = max(1, -(-asked.count() // QUERY_BLOCK))
    block = lambda n: F.pmod(F.xxhash64(F.lit(7), "id", "vec"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(F.lit(True).alias("ask"), "id", "vec", "prefix", block(groups).alias("q"), every(blocks).alias("x"))
    right = posted.select(F.lit(False).alias("ask"), "id", "vec", "prefix", every(groups).alias("q"), block(blocks).alias("x"))

    def ranked(table: pa.Table) -> pa.Table:
        ask = table["ask"].to_numpy()
        sides = []
        for side in (ask, ~ask):
            part = table.filter(pa.array(side)).combine_chunks()
            n = part.num_rows
            sides.append((part["id"].to_pylist(), np.frombuffer(b"".join(part["vec"].to_pylist()), np.float64).reshape(n, -1) if n else None, np.frombuffer(b"".join(part["prefix"].to_pylist()), np.int16).reshape(n, m) if n else None))
        (qid, q, qp), (xid, x, xp) = sides
        out: list[list] = [[], [], []]
        if qid and xid:
            ids = np.array(xid)
            keep = min(len(ids), max(LEAST * k, int(np.ceil(share * len(ids)))))
            scores = by_length(footrule_scores(qp, xp, len(shared.value)), q, x)
            for i, own in enumerate(qid):
                least = np.partition(scores[i], len(ids) - keep)[len(ids) - keep]
                c = np.flatnonzero((scores[i] >= least) & (ids != own))
                value = np.einsum("ij,j->i", x[c], q[i])
                best = np.lexsort((ids[c], -value))[:k]
                out[0] += [own] * len(best)
                out[1] += ids[c[best]].tolist()
                out[2] += value[best].tolist()
        return pa.table({"query_id": pa.array(out[0], table.schema.field("id").type), "vec_id": pa.array(out[1], table.schema.field("id").type), "score": pa.array(out[2], pa.float64())})

    return left.union(right).groupBy("q", "x").applyInArrow(ranked, f"query_id {kind}, vec_id {kind}, score double")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, vector: str = "embedding", key: str = "vec_id", pivots: int = PIVOTS, share: float = SHARE, name: str = "permutation_index") -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where ``is_query`` holds, against all rows."""
    rows = vectors.where(F.col(key).isNotNull()).select("*", F.col(vector).cast("array<double>").alias("__vec"))
    rows = rows.where(usable(rows, "__vec"))
    index = rows.select(F.col(key).alias("id"), F.col("__vec").alias("vec"))
    queries = rows.where(is_query).groupBy(F.col(key).alias("id")).agg(F.min("__vec").alias("vec"))
    picked = index.orderBy(F.xxhash64(F.lit(13), "id", "vec"), "id", "vec").limit(4 * pivots).collect()  # a bounded sample
    sizes = [len(r.vec) for r in picked]
    usual = max(set(sizes), key=sizes.count) if sizes else 0
    sample = np.unique(np.array([r.vec for r in picked if len(r.vec) == usual], np.float64).reshape(-1, usual), axis=0) if usual else np.zeros((0, 0))
    if len(sample):
        sample = sample[np.random.default_rng(1).permutation(len(sample))[:pivots]]
        sample = sample / np.abs(sample).max(1)[:, None]
        sample /= np.sqrt(np.einsum("ij,ij->i", sample, sample))[:, None]
    if not len(sample):
        kind = index.schema["id"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    found = search(queries, index, sample, k, share, name=name)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
