"""Language-model scoring with an interpolated modified Kneser-Ney model of order two or three.

Tokens are words (lower case in A-Z; runs without white space) and one end for
each text; marks of a begin stand before the first.  The model is counted in
Spark and kept in the shared folder as sorted arrays that workers map into
memory:

* the vocabulary: sorted 64-bit hashes of the words, in shards by their first
  bits, with counts and continuation counts; a word's id is its rank;
* each order's n-grams, in ranges of their contexts: sorted contexts with the
  places of their followers, sorted ids of followers, and counts of one byte
  (larger ones apart).  For contexts with many followers the sums are kept: all
  followers' counts, and how many were seen once, twice, or more often; the
  others' sums are made when they are asked for.

Trigrams are counted from the text.  A bigram's count is then the number of
words it follows, and a word's the number of bigrams it ends, so the lower
orders come from the distinct n-grams of the one above, one exchange each.
Ranges are cut at quantiles of the words' counts; a frequent word is cut
further by its followers, so no range depends on one word alone.  Words whose
bigrams lie in several ranges have their sums completed on the driver: two a
range at most.  Tasks send each range one row of packed arrays, summed before,
as differences in byte planes, which compress to about four bytes a trigram.

Files are written under fixed names and put in place by renaming, so a task
that is run again does no harm.  A file never
changes once it is there.  Workers keep ``OPEN_FILES`` files mapped at most.  Where the shared folder isn't a local path, a worker copies a file to
its temporary folder, maps it and unlinks it, so nothing stays behind.

Defined cases: a null or empty text has one token, the end; repeated rows count
as often as they occur; a row with a null id is not learned from; with nothing
to learn from every token has probability 1; very long texts are read whole; an
empty table gives an empty one; other columns of the input, whatever their
names, are ignored.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from plumbline.llm import textbatch as tb
from plumbline.llm.shared import shared_folder, small_batches, stored

END = np.uint64(0x5EED0FE27D0C0DE5)
ORDER = 3
#: Tokens to learn from that a range of n-grams is meant to hold; text bytes a task sums before it sends.
RANGE_TOKENS = 3_000_000
SUM_BYTES = 32 << 20
QUANTILES = 64
#: Files that a worker keeps mapped; followers up to which a context's sums aren't stored; contexts for which one place is stored.
OPEN_FILES, FEW, BLOCK = 512, 16, 4
#: Followers from which a context's are searched by themselves.
LONG = 1024
#: Text bytes that are scored at a time.
SCORE_BYTES = 2 << 20
#: Bits of a key that is sorted as one number; wider ones are sorted by their parts.
KEY_BITS = 64


# --- files ---------------------------------------------------------------


def local_path(uri: str) -> str | None:
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return None if "://" in uri else uri


def least_kind(x: np.ndarray) -> np.ndarray:
    """Numbers that aren't negative in the smallest type that holds them."""
    most = int(x.max()) if len(x) else 0
    return x.astype(next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(k).max))


def put(uri: str, name: str, *arrays: np.ndarray) -> None:
    """One file of all the arrays: their number, their item sizes and lengths, and the arrays at multiples of eight bytes."""
    arrays = tuple(least_kind(np.asarray(a)) for a in arrays)
    head = np.array([len(arrays), *(n for a in arrays for n in (a.itemsize, len(a)))], np.int64).tobytes()
    data = head + b"".join(a.tobytes() + bytes(-a.nbytes % 8) for a in arrays)
    own = f".{name}.{uuid.uuid4().hex}"
    if folder := local_path(uri):
        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/{own}", "wb") as f:
            f.write(data)
        os.replace(f"{folder}/{own}", f"{folder}/{name}")
        return
    from pyarrow import fs

    store, folder = fs.FileSystem.from_uri(uri)
    store.create_dir(folder, recursive=True)
    with store.open_output_stream(f"{folder}/{own}") as f:
        f.write(data)
    store.move(f"{folder}/{own}", f"{folder}/{name}")


def mapped(uri: str, name: str) -> list[np.ndarray]:
    """The arrays of a file, mapped read-only; none where there is no such file."""
    if folder := local_path(uri):
        path = f"{folder}/{name}"
        if not os.path.exists(path):
            return []
        data = np.memmap(path, np.uint8, "r")
    else:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(uri)
        if store.get_file_info(f"{folder}/{name}").type == fs.FileType.NotFound:
            return []
        with tempfile.NamedTemporaryFile() as copy:
            with store.open_input_stream(f"{folder}/{name}") as source:
                while piece := source.read(1 << 20):
                    copy.write(piece)
            copy.flush()
            data = np.memmap(copy.name, np.uint8, "r")
    data = np.asarray(data)  # a plain view, which is faster to index
    many = int(data[:8].view(np.int64)[0])
    head = data[8 : 8 + 16 * many].view(np.int64).tolist()
    out, at = [], 8 + 16 * many
    for item, n in zip(head[::2], head[1::2], strict=True):
        out.append(data[at : at + item * n].view({1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[item]))
        at += item * n + -item * n % 8
    return out


# --- the model -----------------------------------------------------------


@dataclass
class Model:
    """What is sent to the workers: some numbers; all that grows with the corpus is in files."""

    uri: str
    order: int = ORDER
    bits: int = 0  #: of a word's hash that name its shard
    words: int = 0
    tokens: int = 0
    discounts: tuple = ()  #: by order, from one on
    types: int = 0
    type_counts: tuple = (0, 0, 0)

    @property
    def width(self) -> int:
        """Bits of a word's id; ``words`` is the begin's, and all ones no word's."""
        return (self.words + 1).bit_length()


_open: OrderedDict[tuple[str, str], list[np.ndarray]] = OrderedDict()


def arrays(model: Model, name: str) -> list[np.ndarray]:
    key = (model.uri, name)
    if key not in _open:
        _open[key] = mapped(model.uri, name)
        while len(_open) > OPEN_FILES:
            _open.popitem(last=False)
    _open.move_to_end(key)
    return _open[key]


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an END after each text, and len+1 offsets by text."""
    flat, by_text = tb.words(tb.lower_ascii(data), offsets)
    return np.insert(flat, by_text[1:], END), by_text + np.arange(len(by_text))


def of_words(model: Model, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids (-1 for unknown words), counts and continuation counts of sorted hashes; the last are 0 before they are known."""
    ids, counts, continued = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
    bases = arrays(model, "bases")[0]
    edges = np.searchsorted(hashes >> np.uint64(64 - model.bits), np.arange((1 << model.bits) + 1).astype(np.uint64))
    for s in np.flatnonzero(np.diff(edges)):
        own, known = slice(edges[s], edges[s + 1]), arrays(model, f"vocab-{s}")
        if known and len(known[0]):
            at = np.minimum(np.searchsorted(known[0], hashes[own]), len(known[0]) - 1)
            hit = known[0][at] == hashes[own]
            ids[own] = np.where(hit, at + int(bases[s]), -1)
            counts[own] = np.where(hit, known[1][at], 0)
            if cont := arrays(model, f"cont-{s}") if model.types else []:
                continued[own] = np.where(hit, cont[0][at], 0)
    return ids, counts, continued


def runs_of(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal (k1, k2, ...) begins."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def summed(context: np.ndarray, word: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (context, word) in order and the sums of their counts."""
    if not len(context):
        return context, word, counts
    if int(context.max()).bit_length() + width <= KEY_BITS:
        order = np.argsort(context << np.uint64(width) | word, kind="stable")
    else:
        order = np.lexsort((word, context))
    context, word, counts = context[order], word[order], counts[order]
    first = runs_of(context, word)
    return context[first], word[first], np.add.reduceat(counts, first)


def counts_of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of items seen once to four times.

    Where these are too few for the formula a discount of half to three
    quarters a step is taken; none is below 0 or above the count it's for.
    """
    if not n[0] or not n[1]:
        return 0.5, 0.75, 1.0
    y = n[0] / (n[0] + 2 * n[1])
    raw = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.75 * k for k in (1, 2, 3)]
    return tuple(min(max(d, 0.0), float(k)) for k, d in enumerate(raw, 1))


# --- what tasks send ------------------------------------------------------


def squeezed(x: np.ndarray) -> bytes:
    """The array's length and its bytes in planes, compressed."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def expanded(data: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = pa.decompress(data[8:], n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, n).T).view(kind).ravel()


_PACKED = "part int, context binary, word binary, counts binary"


def packed(context: np.ndarray, word: np.ndarray, counts: np.ndarray, parts: list[tuple[int, int, int]]) -> pa.RecordBatch:
    """A row for each (part, begin, end) of sorted n-grams."""
    columns = [[], [], []]
    for _, a, b in parts:
        columns[0].append(squeezed(np.diff(context[a:b], prepend=np.uint64(0))))
        columns[1].append(squeezed(word[a:b].astype(np.uint32)))
        columns[2].append(squeezed(counts[a:b].astype(np.uint32)))
    return pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in parts], pa.int32()), *[pa.array(c, pa.binary()) for c in columns]], ["part", "context", "word", "counts"])


def unpacked(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sums of all rows' n-grams."""
    parts = [(np.cumsum(expanded(c, np.uint64), dtype=np.uint64), expanded(w, np.uint32).astype(np.uint64), expanded(n, np.uint32).astype(np.int64)) for c, w, n in zip(*(table[k].to_pylist() for k in ("context", "word", "counts")), strict=True)]
    return summed(*(np.concatenate(x) for x in zip(*parts, strict=True)), width)


def cut_at(keys: np.ndarray, cuts: np.ndarray) -> list[tuple[int, int, int]]:
    edges = np.concatenate([[0], np.searchsorted(keys, cuts), [len(keys)]])
    return [(p, int(edges[p]), int(edges[p + 1])) for p in np.flatnonzero(np.diff(edges)).tolist()]


def gathered(batches: Iterator[pa.RecordBatch], keyed, width: int, parts_of) -> Iterator[pa.RecordBatch]:
    """Counts what ``keyed`` gives for the chunks of a task, (context, word) a token, and sends it packed by part."""
    waiting, size = [], 0

    def sums() -> pa.RecordBatch:
        context, word = (np.concatenate(x) for x in zip(*waiting, strict=True))
        waiting.clear()
        if len(context) and int(context.max()).bit_length() + width <= KEY_BITS:
            keys = np.sort(context << np.uint64(width) | word)
            first = runs_of(keys)
            context, word, counts = keys[first] >> np.uint64(width) if width < 64 else keys[first], keys[first] & np.uint64((1 << width) - 1), np.diff(np.append(first, len(keys)))
        else:
            context, word, counts = summed(context, word, np.ones(len(context), np.int64), width)
        return packed(context, word, counts, parts_of(context, word))

    for batch in batches:
        for _, data, offsets in tb.chunks(batch, "text"):
            waiting.append(keyed(data, offsets))
            size += len(data)
            if size >= SUM_BYTES:
                yield sums()
                size = 0
    if waiting:
        yield sums()


# --- files of n-grams -----------------------------------------------------


def bytes_and_more(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of one byte, and places and values of those that are 255 or more."""
    more = np.flatnonzero(counts >= 255)
    return np.minimum(counts, 255).astype(np.uint8), more, counts[more]


def count_at(small: np.ndarray, more: np.ndarray, value: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = small[at].astype(np.int64)
    large = np.flatnonzero(out == 255)
    if len(large):
        out[large] = value[np.searchsorted(more, at[large])]
    return out


def sums_of(counts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """By run: all counts, and how many are one, two, more."""
    return np.array([np.add.reduceat(x.astype(np.int64), first) for x in (counts, counts == 1, counts == 2, counts > 2)]).reshape(4, -1)


def put_pairs(uri: str, part: int, first: np.ndarray, second: np.ndarray, counts: np.ndarray) -> list[list[int]]:
    """Writes a range's bigrams; returns the first and last context with their sums."""
    at = runs_of(first)
    sums = sums_of(counts, at)
    put(uri, f"pairs-{part}", first[at], np.append(at, len(first)), second, *bytes_and_more(counts), *sums)
    return [[int(first[at[k]]), *sums[:, k].tolist()] for k in sorted({0, len(at) - 1})]


def put_triples(uri: str, part: int, context: np.ndarray, word: np.ndarray, counts: np.ndarray, width: int) -> None:
    """Writes a range's trigrams: first words, second words with their numbers of followers, followers with counts."""
    at = runs_of(context)
    follow = np.diff(np.append(at, len(context)))
    first, second = context[at] >> np.uint64(width), context[at] & np.uint64((1 << width) - 1)
    by_first = runs_of(first)
    big = np.flatnonzero(follow > FEW)
    sums = sums_of(counts, at)[:, big]
    put(uri, f"triples-{part}", first[by_first], np.append(by_first, len(first)), second, *bytes_and_more(follow), at[::BLOCK], word, *bytes_and_more(counts), big, *sums)


def found_in(values: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in the sorted ``values[low:high]``, and whether they are there; rows of one slice stand together."""
    out, size = low.copy(), high - low
    all_wanted, wanted = wanted, np.minimum(wanted, np.uint64(np.iinfo(values.dtype).max)).astype(values.dtype)  # slices are searched in their own type
    long = np.flatnonzero(size > LONG)
    if len(long):  # slice by slice
        cuts = runs_of(low[long])
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(long)], strict=True):
            rows, begin = long[a:b], int(low[long[a]])
            out[rows] = begin + np.searchsorted(values[begin : int(high[long[a]])], wanted[rows])
    some = np.flatnonzero((size > 0) & (size <= LONG))
    at, left, want = low[some], size[some], wanted[some]
    for _ in range(int(left.max(initial=0)).bit_length()):  # all others together
        half = left >> 1
        less = (left > 0) & (values[np.minimum(at + half, len(values) - 1)] < want)
        at += np.where(less, half + 1, 0)
        left = np.where(less, left - half - 1, half)
    out[some] = at
    there = out < high
    there[there] = values[out[there]] == all_wanted[there]
    return out, there


def slice_of(starts: np.ndarray, i: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The followers' places of the contexts ``i``, none where the context isn't there."""
    low = starts[i].astype(np.int64)
    return low, np.where(hit, starts[i + 1].astype(np.int64), low)


def pairs_of(model: Model, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the bigrams, and the sums (4, n) of their first words; sorted by (first, second)."""
    count, sums = np.zeros(len(first), np.int64), np.zeros((4, len(first)), np.int64)
    split, *split_sums = arrays(model, "split")
    for p, a, b in cut_at(first << np.uint64(model.width) | second, arrays(model, "bases")[1]):
        if file := arrays(model, f"pairs-{p}"):
            contexts, starts, words, small, more, value, *own = file
            at = runs_of(first[a:b])  # each context once
            which = np.repeat(np.arange(len(at)), np.diff(np.append(at, b - a)))
            i = np.minimum(np.searchsorted(contexts, first[a:b][at]), len(contexts) - 1)
            hit = contexts[i] == first[a:b][at]
            low, high = slice_of(starts, i, hit)
            place, there = found_in(words, low[which], high[which], second[a:b])
            count[a:b][there] = count_at(small, more, value, place[there])
            sums[:, a:b] = np.where(hit, np.array([x[i] for x in own]).astype(np.int64), 0)[:, which]
    if len(split):
        i = np.minimum(np.searchsorted(split, first), len(split) - 1)
        hit = split[i] == first
        sums[:, hit] = np.array([x[i[hit]] for x in split_sums]).astype(np.int64)
    return count, sums


def triples_of(model: Model, context: np.ndarray, third: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the trigrams, and the sums (4, n) of their contexts; sorted by (context, third)."""
    count, sums = np.zeros(len(context), np.int64), np.zeros((4, len(context)), np.int64)
    width, mask = np.uint64(model.width), np.uint64((1 << model.width) - 1)
    for p, a, b in cut_at(context, arrays(model, "bases")[1]):
        if not (file := arrays(model, f"triples-{p}")):
            continue
        firsts, starts, seconds, small_f, more_f, value_f, blocks, words, small, more, value, big, *big_sums = file
        at = runs_of(context[a:b])  # each context once
        which = np.repeat(np.arange(len(at)), np.diff(np.append(at, b - a)))
        first, second = context[a:b][at] >> width, context[a:b][at] & mask
        i = np.minimum(np.searchsorted(firsts, first), len(firsts) - 1)
        j, hit = found_in(seconds, *slice_of(starts, i, firsts[i] == first), second)
        j = np.minimum(j, len(seconds) - 1)
        follow = np.where(hit, count_at(small_f, more_f, value_f, j), 0)
        block = (j & ~(BLOCK - 1))[:, None] + np.arange(BLOCK - 1)  # of the same block's contexts, those that come before
        ahead = count_at(small_f, more_f, value_f, np.minimum(block, len(seconds) - 1).ravel()).reshape(block.shape)
        low = blocks[j // BLOCK].astype(np.int64) + np.where(block < j[:, None], ahead, 0).sum(1)
        place, there = found_in(words, low[which], (low + follow)[which], third[a:b])
        count[a:b][there] = count_at(small, more, value, place[there])
        own = np.zeros((4, len(at)), np.int64)
        some = np.flatnonzero((follow > 0) & (follow <= FEW))
        if len(some):
            begin = np.cumsum(follow[some]) - follow[some]
            every = np.repeat(low[some] - begin, follow[some]) + np.arange(int(follow[some].sum()))
            own[:, some] = sums_of(count_at(small, more, value, every), begin)
        many = np.flatnonzero(follow > FEW)
        if len(many):
            k = np.searchsorted(big, j[many])
            own[:, many] = np.array([x[k] for x in big_sums]).astype(np.int64)
        sums[:, a:b] = own[:, which]
    return count, sums


# --- training --------------------------------------------------------------


def before(ids: np.ndarray, by_text: np.ndarray, steps: int, begin: int) -> np.ndarray:
    """The id so many tokens before each, ``begin`` before a text's first."""
    out = np.full(len(ids), begin, np.int64)
    out[steps:] = ids[: len(ids) - steps] if len(ids) > steps else out[steps:]
    for k in range(steps):
        at = by_text[:-1] + k
        out[at[at < by_text[1:]]] = begin
    return out


def train(docs: DataFrame, text: str = "text", name: str = "kneser_ney", order: int = ORDER) -> Model:
    """Counts the model over all rows of ``docs``."""
    if order not in (2, 3):
        raise ValueError("the order of the model is 2 or 3")
    spark = docs.sparkSession
    source = small_batches(docs.select(docs[text].alias("text")))
    model = Model(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", order)
    model.bits = min(16, max(3, int(np.ceil(np.log2(max(1, source.rdd.getNumPartitions()))))))
    uri, bits, shards = model.uri, model.bits, 1 << model.bits

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def keyed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            own = tokens(data, offsets)[0]
            return own, np.zeros(len(own), np.uint64)

        cuts = np.arange(1, shards).astype(np.uint64) << np.uint64(64 - bits)
        return gathered(batches, keyed, 0, lambda hashes, _: cut_at(hashes, cuts))

    def vocabulary(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        hashes, _, counts = unpacked(table, 0)
        put(uri, f"vocab-{part}", hashes.astype(np.uint64), counts)
        sums = np.cumsum(counts) - counts
        marks = np.unique(np.searchsorted(sums, np.arange(QUANTILES) * counts.sum() / QUANTILES, "right") - 1)
        return pa.table({"part": pa.array([part], pa.int32()), "words": [len(hashes)], "tokens": [int(counts.sum())], "texts": [int(counts[hashes == END].sum())], "marks": [marks.tolist()], "before": [sums[marks].tolist()], "counts": [counts[marks].tolist()]})

    found = source.mapInArrow(words, _PACKED).groupBy("part").applyInArrow(vocabulary, "part int, words bigint, tokens bigint, texts bigint, marks array<bigint>, before array<bigint>, counts array<bigint>").collect()  # a row a shard
    by_part = {r.part: r for r in found}
    marks, befores, sizes = [], [], []
    bases, total = [0], 0
    for s in range(shards):
        if r := by_part.get(s):
            marks += [bases[-1] + m for m in r.marks]
            befores += [total + b for b in r.before]
            sizes += r.counts
            total += r.tokens
        bases.append(bases[-1] + (r.words if r else 0))
    model.words, model.tokens = bases[-1], total
    if not total:
        return model

    # ranges of contexts with about as many tokens each
    width, texts = model.width, sum(r.texts for r in found)
    mark, ahead, size = np.array([*marks, model.words]), np.array([*befores, total], float), np.array([*sizes, texts], float)
    parts = max(1, round((total + texts) / RANGE_TOKENS))
    cuts = set()
    for c in np.arange(1, parts) * (total + texts) / parts:
        k = int(np.searchsorted(ahead, c, "right")) - 1
        if c < ahead[k] + size[k]:  # within one word: cut by its followers
            cuts.add(int(mark[k]) << width | int(mark[np.searchsorted(ahead, (c - ahead[k]) / size[k] * total, "right") - 1]))
        else:
            cuts.add(int(mark[k]) + 1 << width)
    put(uri, "bases", np.array(bases), np.array(sorted(cuts), np.uint64))
    shared = spark.sparkContext.broadcast(model)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        cuts = arrays(own, "bases")[1]

        def keyed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            flat, by_text = tokens(data, offsets)
            hashes, inverse = np.unique(flat, return_inverse=True)
            ids = of_words(own, hashes)[0][inverse]
            context = before(ids, by_text, 1, own.words).astype(np.uint64)
            if own.order == 3:
                context |= before(ids, by_text, 2, own.words).astype(np.uint64) << np.uint64(own.width)
            return context, ids.astype(np.uint64)

        by_context = own.order == 3
        return gathered(batches, keyed, own.width, lambda context, word: cut_at(context if by_context else context << np.uint64(own.width) | word, cuts))

    numbers = "numbers array<bigint>, edges array<array<bigint>>"

    def rows(batch: pa.RecordBatch, counted: list[int], edges: list) -> pa.Table:
        """A row of numbers, under part -1, and the n-grams for the order below."""
        n = batch.num_rows
        head = pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), *[pa.array([b""], pa.binary())] * 3], batch.schema.names)
        both = pa.Table.from_batches([head, batch])
        return both.append_column("numbers", pa.array([counted] + [None] * n, pa.list_(pa.int64()))).append_column("edges", pa.array([edges] + [None] * n, pa.list_(pa.list_(pa.int64()))))

    def triples(table: pa.Table) -> pa.Table:
        own, part = shared.value, table["part"][0].as_py()
        context, word, counts = unpacked(table, own.width)
        put_triples(uri, part, context, word, counts, own.width)
        mask = np.uint64((1 << own.width) - 1)
        first, second, times = summed(context & mask, word, np.ones(len(word), np.int64), own.width)  # words before each bigram
        below = packed(first, second, times, cut_at(first << np.uint64(own.width) | second, arrays(own, "bases")[1]))
        return rows(below, [3, len(counts), *counts_of_counts(counts)], [])

    def pairs(table: pa.Table) -> pa.Table:
        own, part = shared.value, table["part"][0].as_py()
        if part < 0:  # numbers of the order above
            every = np.array([x for x in table["numbers"].to_pylist()]).sum(0)
            return rows(packed(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), []), [3, *every[1:].tolist()], [])
        first, second, counts = unpacked(table, own.width)
        edges = put_pairs(uri, part, first, second, counts)
        word, times = np.unique(second, return_counts=True)
        below = packed(word, np.zeros(len(word), np.uint64), times, cut_at(word, arrays(own, "bases")[0][1:-1]))
        return rows(below, [2, len(counts), *counts_of_counts(counts)], edges)

    counted = source.mapInArrow(grams, _PACKED)
    if order == 3:
        counted = counted.groupBy("part").applyInArrow(triples, f"{_PACKED}, {numbers}")
    out = stored(counted.groupBy("part").applyInArrow(pairs, f"{_PACKED}, {numbers}"), name + "/pairs")
    totals = {2: np.zeros(5, np.int64), 3: np.zeros(5, np.int64)}
    partial: dict[int, np.ndarray] = {}
    for r in out.where("part = -1").select("numbers", "edges").toLocalIterator():  # one row a range
        totals[r.numbers[0]] += np.array(r.numbers[1:])
        for first, *sums in r.edges:
            partial[first] = partial.get(first, np.zeros(4, np.int64)) + np.array(sums)
    split = sorted(partial)
    put(uri, "split", np.array(split, np.uint64), *np.array([partial[k] for k in split]).reshape(-1, 4).T)

    def continued(table: pa.Table) -> pa.Table:
        own, part = shared.value, table["part"][0].as_py()
        word, _, counts = unpacked(table, 0)
        bases = arrays(own, "bases")[0].astype(np.int64)
        dense = np.zeros(bases[part + 1] - bases[part], np.int64)
        dense[word.astype(np.int64) - bases[part]] = counts
        put(uri, f"cont-{part}", dense)
        return pa.table({"part": pa.array([part], pa.int32()), "numbers": pa.array([[int((counts > 2).sum()), *counts_of_counts(counts)]], pa.list_(pa.int64()))})

    lower = np.zeros(5, np.int64)
    for r in out.where("part >= 0").select("part", "context", "word", "counts").groupBy("part").applyInArrow(continued, "part int, numbers array<bigint>").collect():  # a row a shard
        lower += np.array(r.numbers)
    model.types = int(totals[2][0])
    model.type_counts = (int(lower[1]), int(lower[2]), int(lower[0]))
    model.discounts = (discounts(lower[1:].tolist()), discounts(totals[2][1:].tolist()), *([discounts(totals[3][1:].tolist())] if order == 3 else []))
    return model


# --- scoring ---------------------------------------------------------------


def interpolated(count: np.ndarray, sums: np.ndarray, steps: tuple, below: np.ndarray) -> np.ndarray:
    """Discounted share of the count, and the rest of the context's mass on the order below; unseen contexts leave all to it."""
    d = np.array([0.0, *steps])
    seen, total = sums[0] > 0, np.maximum(sums[0], 1)
    return np.where(seen, np.maximum(count - d[np.minimum(count, 3)], 0) / total, 0.0) + np.where(seen, d[1:] @ sums[1:].astype(np.float64) / total, 1.0) * below


def log_probabilities(model: Model, flat: np.ndarray, by_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per token: its count in the training tokens, and log10 of its probability."""
    if not model.tokens:
        return np.zeros(len(flat), np.int64), np.zeros(len(flat))
    hashes, inverse = np.unique(flat, return_inverse=True)
    ids, counts, cont = of_words(model, hashes)
    low = np.array([0.0, *model.discounts[0]])
    left = sum(d * n for d, n in zip(low[1:], model.type_counts, strict=True)) / model.types
    chance = (np.maximum(cont - low[np.minimum(cont, 3)], 0) / model.types + left / (model.words + 1))[inverse]

    here = ids[inverse]
    word = np.where(here < 0, (1 << model.width) - 1, here).astype(np.uint64)
    one, two = before(here, by_text, 1, model.words), before(here, by_text, 2, model.words)
    for order, of, steps in ((2, pairs_of, model.discounts[1]), (3, triples_of, model.discounts[-1]))[: model.order - 1]:
        able = np.flatnonzero((one >= 0) & ((two >= 0) | (order < 3)))
        context = one[able].astype(np.uint64)
        if order == 3:
            context |= two[able].astype(np.uint64) << np.uint64(model.width)
        if int(context.max(initial=0)).bit_length() + model.width <= KEY_BITS:
            by_key = np.argsort(context << np.uint64(model.width) | word[able])
        else:
            by_key = np.lexsort((word[able], context))
        count, sums = of(model, context[by_key], word[able][by_key])
        at = able[by_key]
        chance[at] = interpolated(count, sums, steps, chance[at])
    return counts[inverse], np.log10(chance)


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: ``key``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = small_batches(docs.select(docs[key].alias("key"), docs[text].alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for rows, data, offsets in tb.chunks(batch, "text", SCORE_BYTES):
                flat, by_text = tokens(data, offsets)
                counts, logs = log_probabilities(own, flat, by_text)
                base = np.log10((counts + 0.5) / (own.tokens + 0.5 * (own.words + 1)))
                at = by_text[:-1]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(np.diff(by_text), pa.int64()), pa.array(np.add.reduceat((counts > 0).astype(np.int64), at)), pa.array(np.full(len(at), own.tokens), pa.int64()), pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(logs, at))],
                    ["key", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return source.mapInArrow(run, f"key {source.schema['key'].dataType.simpleString()}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double").withColumnRenamed("key", key)


def kneser_ney(docs: DataFrame, learn: Column, text: str = "text", key: str = "doc_id", name: str = "kneser_ney", order: int = ORDER) -> DataFrame:
    """``score`` of all rows by the model of those for which ``learn`` holds."""
    return score(docs, train(docs.where(learn), text, name, order), text, key)
