"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Tokens are runs of letters, of digits or of one kind of other signs; features
are tokens and pairs of neighbours, hashed to ``2**bits`` slots, with the
weight of their logarithmic count, the whole scaled to length one.  Training
is FTRL-proximal (per-coordinate rates, L1 and L2) over a bounded sample of
labelled rows in one task; scoring is a sparse dot product in every task.

The sample: labelled training ids by a hash of the id, about ``sample_rows`` of
them, and of each id one row, that with the smallest hash of its text.  Below
that bound all are taken.

Defined cases: a null or empty text has only the bias and gets its score;
rows whose label is null are not learned from; a document labelled more than
once counts with its lower label; with no labelled row every score is 0.5;
repeated rows give repeated results; long texts are scored whole; an empty
table gives an empty one; other columns of both tables, whatever their names,
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import textbatch as tb
from plumbline.llm.shared import small_batches


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.002
    l2: float = 0.0005
    epochs: int = 3
    sample_rows: int = 12_000
    seed: int = 17


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots and values of all texts end to end, and len+1 offsets into them by text."""
    low = tb.lower_ascii(data)
    kind = np.full(256, 3, np.uint8)
    kind[128:], kind[97:123], kind[48:58], kind[[32, *range(9, 14)]] = 1, 1, 2, 0
    k = kind[low]
    n = len(low)
    other = k == 3
    starts_at = np.zeros(n + 1, bool)
    starts_at[offsets] = True
    starts_at[1:n] |= (k[1:] != k[:-1]) | (other[1:] & (low[1:] != low[:-1])) if n else False
    begin = np.flatnonzero(starts_at[:n])
    end = np.append(begin[1:], n)
    seen = k[begin] != 0 if n else np.zeros(0, bool)
    begin, end = begin[seen], end[seen]
    upper = np.concatenate([[0], np.cumsum(data != low)])
    caps = (upper[end] - upper[begin] > 1).astype(np.uint64)  # a word in capitals is another word
    token = tb.hash_ranges(low, begin, end) + caps
    by_text = np.searchsorted(begin, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(by_text))
    pair = tb.mix(token[:-1] * np.uint64(3) + token[1:]) if len(token) else token
    same = doc[1:] == doc[:-1]
    shift = np.uint64(64 - bits)
    slots = np.concatenate([tb.mix(token) >> shift, pair[same] >> shift]).astype(np.int64)
    keys = np.concatenate([doc, doc[1:][same]]) << bits | slots
    keys, counts = np.unique(keys, return_counts=True)
    doc, slots = keys >> bits, keys & ((1 << bits) - 1)
    values = 1 + np.log(counts)
    norms = np.sqrt(np.bincount(doc, values * values, len(offsets) - 1))
    return slots, values / norms[doc], np.searchsorted(doc, np.arange(len(offsets)))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], s: Settings) -> np.ndarray:
    """Weights by slot, the bias last."""
    size = (1 << s.bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        return np.where(np.abs(z[at]) <= s.l1, 0.0, (np.sign(z[at]) * s.l1 - z[at]) / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2))

    order = np.random.default_rng(s.seed)
    for _ in range(s.epochs):
        for i in order.permutation(len(rows)):
            slots, values, label = rows[i]
            at, x = np.append(slots, size - 1), np.append(values.astype(np.float64), 1.0)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha * w
            n[at] += g * g
    return weights(slice(None)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, text: str = "text", key: str = "doc_id", label: str = "quality", settings: Settings = Settings()) -> np.ndarray:
    """Learns from the rows of ``docs`` for which ``learn`` (on ``doc_id``) holds."""
    s = settings
    known = labels.select(F.col(key).alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & learn).groupBy("doc_id").agg(F.min("label").alias("label"))
    count = max(1, known.count())
    part = min(1.0, s.sample_rows / count)
    known = known.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(s.seed)), F.lit(1 << 20)) < int(part * (1 << 20)))
    every = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).join(known, "doc_id")
    rows = small_batches(every.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.min("label").alias("label")))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in tb.chunks(batch, "text"):
                slots, values, by_text = features(data, offsets, s.bits)
                bounds = pa.array(by_text, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.ListArray.from_arrays(bounds, pa.array(slots, pa.int32())), pa.ListArray.from_arrays(bounds, pa.array(values, pa.float32()))], ["doc_id", "label", "slots", "values"])

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for i, label, slots, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                rows.append((i, slots.values.to_numpy(), values.values.to_numpy(), label))
        rows.sort(key=lambda r: (str(r[0]), len(r[1]), r[1].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([train([r[1:] for r in rows], s).tobytes()], pa.binary())], ["weights"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    sample = rows.mapInArrow(hashed, f"doc_id {kind}, label int, slots array<int>, values array<float>")
    found = sample.repartition(1).mapInArrow(learned, "weights binary").collect() if settings.sample_rows else []
    return np.frombuffer(bytes(found[0][0]), np.float32) if found else np.zeros((1 << s.bits) + 1, np.float32)


def score_of(docs: DataFrame, weights: np.ndarray, text: str = "text", settings: Settings = Settings()) -> Column:
    """The score, 0 to 1, of each row of ``docs`` as a column; the text goes to Python and only the score comes back."""
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(weights)
    bits = settings.bits

    def scored(texts: pa.Array) -> pa.Array:
        w = shared.value.astype(np.float64)
        out = [np.zeros(0)]
        for part, data, offsets in tb.chunks(pa.RecordBatch.from_arrays([texts], ["text"]), "text"):
            slots, values, by_text = features(data, offsets, bits)
            doc = np.repeat(np.arange(part.num_rows), np.diff(by_text))
            out.append(np.bincount(doc, values * w[slots], part.num_rows) + w[-1])
        return pa.array(1 / (1 + np.exp(-np.clip(np.concatenate(out), -35, 35))), pa.float64())

    scored.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(scored, "double")(docs[text])
