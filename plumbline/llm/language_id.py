"""Language identification by cross-parsing against suffix automata.

For each language one suffix automaton is built over a bounded sample of its
text.  A text is parsed against it into the fewest phrases that occur in the
sample: the longest match is taken again and again.  Phrases per byte, times
the logarithm of the sample's size, estimate the cross entropy, and the
language with the least wins.  The automaton with its failing transitions
turned into "new phrase" moves is a flat table, so many texts advance in step.

Texts are first brought to lower case, with every run of bytes that can't be
part of a letter as one space.  Segments of a text longer than ``SEGMENT`` bytes
are parsed side by side, each as if a phrase began with it; then each is run
again from the true state at its begin until both runs are in the same state,
so the phrases are those of one pass over the whole text.

Learning: per language about ``SAMPLE_ROWS`` training rows by a hash of their
id, of those with ``ROW_CHARS`` characters at most; their distinct texts are
taken whole, in the order of the hash, as long as they fit into
``SAMPLE_BYTES``.  A language that has only longer texts is learned from the
shortest of them.

Defined cases: a text that is null or has no letter gets ``und`` and score 0,
as do all texts where nothing could be learned; rows without a language are
not learned from; repeated rows give repeated results; very long texts are
parsed whole; ties go to the language that sorts first; an empty table gives an
empty one; other columns of the input, whatever their names, are ignored.  The
score is the winner's margin turned into a share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import textbatch as tb
from plumbline.llm.shared import small_batches

SEGMENT = 8192
#: Steps after which two runs from different states are compared.
SYNC = 256
#: Bounds of a language's sample: rows, characters of a row, bytes of all that are taken.
SAMPLE_ROWS, ROW_CHARS, SAMPLE_BYTES = 200, 2000, 48_000


def normal(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters with single spaces between, as bytes and offsets."""
    data, offsets = tb.text_bytes(pc.utf8_lower(column.cast(pa.large_string()).fill_null("")))
    letter = (data >= 128) | ((data >= 97) & (data <= 122))
    data = np.where(letter, data, np.uint8(32))
    keep = letter.copy()
    if len(data):
        keep[1:] |= letter[:-1]  # one space after each run of letters
        keep[offsets[:-1][offsets[:-1] < len(data)]] &= letter[offsets[:-1][offsets[:-1] < len(data)]]
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


class CrossParser:
    """A suffix automaton over ``sample``, as a table of moves."""

    def __init__(self, sample: bytes) -> None:
        nexts, link, length, last = [{}], [-1], [0], 0
        for c in sample:
            here = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nexts[p]:
                nexts[p][c] = here
                p = link[p]
            if p >= 0:
                q = nexts[p][c]
                if length[p] + 1 == length[q]:
                    link[here] = q
                else:
                    copy = len(nexts)
                    nexts.append(dict(nexts[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nexts[p].get(c) == q:
                        nexts[p][c] = copy
                        p = link[p]
                    link[q] = link[here] = copy
            last = here
        seen = sorted(set(sample))
        self.of_byte = np.zeros(256, np.int64)  # class 0: not in the sample
        self.of_byte[seen] = np.arange(1, len(seen) + 1)
        size = len(seen) + 1
        between = len(nexts)  # after a byte that never occurs, and before the text: whatever comes is a new phrase
        table = np.full((between + 1, size), -1, np.int64)
        for s, moves in enumerate(nexts):
            for c, t in moves.items():
                table[s, self.of_byte[c]] = t
        root = np.where(table[0] < 0, between, table[0])
        missing = table < 0
        moved = np.where(missing, root[None, :], table)
        #: Twice the next state's row, and 1 where a new phrase begins.
        self.table = (moved * size * 2 + missing).astype(np.int32).ravel()
        self.start = between * size
        self.cost = np.log2(max(2, len(sample)))

    def phrases(self, grid: np.ndarray, active: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each lane of ``grid`` (steps by lanes of bytes) from the rows ``start``, and the rows at the end; the first ``active[k]`` lanes go on at step k."""
        kinds = self.of_byte.astype(np.int32)
        row = np.full(grid.shape[1], self.start, np.int32) if start is None else start.copy()
        count = np.zeros(grid.shape[1], np.int64)
        for k, m in enumerate(active.tolist()):
            move = self.table[row[:m] + kinds[grid[k, :m]]]
            count[:m] += move & 1
            row[:m] = move >> 1
        return count, row


_parsers: dict[tuple, list] = {}


def parsers(samples: tuple[tuple[str, bytes], ...]) -> list[tuple[str, CrossParser]]:
    key = tuple((lang, hash(text)) for lang, text in samples)
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = [(lang, CrossParser(text)) for lang, text in samples]
    return _parsers[key]


def lanes(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(lanes, grid, active) for groups of byte ranges of like length, the longest first."""
    order = np.argsort(-size, kind="stable")
    at = 0
    while at < len(order):
        most = int(size[order[at]])
        own = order[at : at + max(64, (8 << 20) // max(most, 1))]
        grid = data[np.minimum(begin[own][None, :] + np.arange(most)[:, None], len(data) - 1)]
        yield own, grid, np.searchsorted(-size[own], -np.arange(1, most + 1), "right")
        at += len(own)


def parsed(parser: CrossParser, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases and last rows of byte ranges, each parsed by itself."""
    count, row = np.zeros(len(size), np.int64), np.zeros(len(size), np.int32)
    for own, grid, active in lanes(data, begin, size):
        count[own], row[own] = parser.phrases(grid, active)
    return count, row


def entropies(column: pa.Array, models: list[tuple[str, CrossParser]]) -> np.ndarray:
    """Bits a byte by text and language; texts without anything to parse have NaN."""
    data, offsets = normal(column)
    sizes = np.diff(offsets)
    parts = -(-sizes // SEGMENT)
    doc = np.repeat(np.arange(len(sizes)), parts)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = offsets[:-1][doc] + nth * SEGMENT
    size = np.minimum(SEGMENT, offsets[1:][doc] - begin)
    later = np.flatnonzero(nth > 0)  # segments that a phrase may run into
    head = np.minimum(size[later], SYNC)
    total = np.zeros((len(sizes), len(models)))
    for j, (_, parser) in enumerate(models):
        count, row = parsed(parser, data, begin, size)
        again = np.zeros(0, np.int64)
        for own, grid, active in lanes(data, begin[later], head):
            at = later[own]
            true, true_row = parser.phrases(grid, active, row[at - 1])
            assumed, assumed_row = parser.phrases(grid, active)
            count[at] += true - assumed
            apart = (true_row != assumed_row) & ((head[own] < size[at]) | (nth[at] < parts[doc[at]] - 1))
            again = np.append(again, doc[at[apart]])
        np.add.at(total[:, j], doc, count * parser.cost)
        again = np.unique(again)  # runs that stay apart for long, as in copies of the sample: in one pass
        if len(again):
            total[again, j] = parsed(parser, data, offsets[:-1][again], sizes[again])[0] * parser.cost
    with np.errstate(invalid="ignore", divide="ignore"):
        return total / np.where(sizes > 0, sizes, np.nan)[:, None]


def predict(column: pa.Array, models: list[tuple[str, CrossParser]]) -> tuple[list[str], np.ndarray]:
    n = len(column)
    if not models:
        return ["und"] * n, np.zeros(n)
    h = entropies(column, models)
    none = np.isnan(h[:, 0])
    h[none] = 1.0
    best = h.argmin(1)
    share = np.exp2(-(h - h.min(1, keepdims=True)) * 8)
    score = 1 / share.sum(1)
    low = pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))
    plain = np.asarray(pc.match_substring_regex(low, "[a-z]"))
    und = none | ~plain
    for i in np.flatnonzero(~plain & ~none):  # only letters beyond ASCII, if any
        und[i] = regex.search(r"\p{L}", low[i].as_py()) is None
    return ["und" if u else models[b][0] for u, b in zip(und.tolist(), best.tolist(), strict=True)], np.where(und, 0.0, score)


def learn(docs: DataFrame, training: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_bytes: int = SAMPLE_BYTES) -> tuple[tuple[str, bytes], ...]:
    """Each language's sample; ``training`` selects the rows to learn from.

    Rows are counted by language first; a hash bound by language then leaves
    about ``SAMPLE_ROWS`` of each, whatever the table's size.
    """
    mark = F.pmod(F.xxhash64(F.col(key), F.xxhash64(F.col(text)), F.lit(41)), F.lit(1 << 40))
    size = F.length(F.col(text))
    rows = docs.where(training & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), mark.alias("mark"), size.alias("size"), F.col(text).alias("text"))
    short = F.col("size") <= ROW_CHARS
    counts = rows.groupBy("lang").agg(F.count(F.when(short, 1)).alias("n"), F.min(F.when(~short, F.struct("size", "mark"))).alias("least")).collect()
    if not counts:
        return ()
    picked = []
    many = {r.lang: r.n for r in counts if r.n}
    if many:
        bound = F.coalesce(*[F.when(F.col("lang") == k, F.lit(int(min(1.0, SAMPLE_ROWS / n) * (1 << 40)))) for k, n in sorted(many.items())])
        picked += rows.where(short & (F.col("mark") < bound)).collect()
    for r in counts:
        if not r.n:
            picked += rows.where((F.col("lang") == r.lang) & (F.col("size") == r.least.size) & (F.col("mark") == r.least.mark)).limit(1).collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(picked, key=lambda r: (r.lang, r.mark, r.text)):
        samples.setdefault(r.lang, []).append(r.text)
    out = []
    for k, texts in sorted(samples.items()):
        data, offsets = normal(pa.array(texts))
        whole = data.tobytes()
        distinct = list(dict.fromkeys(t for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) if (t := whole[a:b].strip(b" "))))
        if sample := b" ".join(fitting(distinct, sample_bytes)):
            out.append((k, sample))
    return tuple(out)


def fitting(texts: list[bytes], total: int) -> list[bytes]:
    """Of the texts, in order, those that fit whole into ``total`` bytes; the first in any case."""
    taken, size = texts[:1], len(texts[0]) if texts else 0
    for t in texts[1:]:
        if size + 1 + len(t) <= total:
            taken.append(t)
            size += 1 + len(t)
    return taken


def language_id(docs: DataFrame, samples: tuple[tuple[str, bytes], ...], text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: ``key``, ``lang_pred`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(samples)
    source = small_batches(docs.select(docs[key].alias("key"), docs[text].alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = parsers(shared.value)
        for batch in batches:
            for rows, _, _ in tb.chunks(batch, "text", 16 << 20):
                langs, score = predict(rows.column(1), models)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64())], ["key", "lang_pred", "score"])

    return source.mapInArrow(run, f"key {source.schema['key'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("key", key)
