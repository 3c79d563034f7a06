"""Byte-level BPE by replaying merges over a corpus, and decoding.

A batch's texts are split by the vocabulary's pattern in numpy passes over
code points; equal pieces are encoded once.  The distinct pieces of a batch
form a small corpus: an inverted index from token pair (named by the rank the
pair merges to) to positions drives the replay.  Ranks are taken in order; all
positions of a rank merge, and only the pairs with the touched neighbours are
looked up and posted anew.  A piece in which a merge makes a pair of a lower
rank than the one at hand leaves the replay and is encoded by itself, always
the lowest rank first, as the replay's order wouldn't be that of the pieces'
own merges.

Defined cases: a null or empty text has no tokens and decodes to nothing;
repeated rows give repeated results; long texts are encoded whole, in memory
proportional to their length; an empty table gives an empty one; other columns
of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from plumbline.llm import textbatch as tb
from plumbline.llm.shared import small_batches

NONE = np.int32(2**31 - 1)
#: Distinct pieces that a task remembers between batches.
REMEMBERED = 300_000
#: Text bytes of one replay; more share the passes over the ranks, but take more memory.
CORPUS_BYTES = 4 << 20
#: Text bytes that are split into pieces at a time.
PIECE_BYTES = 1 << 20

#: Fixed value: the pattern that ``pieces`` follows.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3


class Ranks:
    """Tokens by rank, and the rank that each mergeable pair of tokens gives."""

    def __init__(self, lines: bytes) -> None:
        entries = [(base64.b64decode(a), int(b)) for a, b in (line.split() for line in lines.splitlines() if line)]
        self.of = dict(entries)
        size = max(self.of.values()) + 1
        tokens = [b""] * size
        for token, rank in entries:
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.of_byte = np.array([self.of[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in entries:
            for cut in range(1, len(token)):
                left, right = self.of.get(token[:cut]), self.of.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.slots = 1 << (4 * len(self.keys)).bit_length()
        self.table = np.full(self.slots, -1, np.int64)
        left = np.arange(len(self.keys))
        at = self._slot(self.keys)
        while len(left):  # open addressing, a probe for all keys at a time
            first = np.unique(at, return_index=True)[1]
            won = first[self.table[at[first]] < 0]
            self.table[at[won]] = left[won]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, at = left[rest], (at[rest] + 1) & (self.slots - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ (h >> np.uint64(29))) >> np.uint64(20)).astype(np.int64) & (self.slots - 1)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where it doesn't merge."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        out = np.full(len(keys), NONE, np.int32)
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            entry = self.table[at]
            there = entry >= 0
            todo, at, entry = todo[there], at[there], entry[there]
            equal = self.keys[entry] == keys[todo]
            out[todo[equal]] = self.values[entry[equal]]
            todo, at = todo[~equal], (at[~equal] + 1) & (self.slots - 1)
        return out

    def alone(self, piece: bytes) -> list[int]:
        """Tokens of one piece, merging the leftmost pair of the lowest rank until none merges."""
        parts = [bytes([b]) for b in piece]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(r, i) for i in range(len(parts) - 1) if (r := self.of.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j >= len(parts) or self.of.get(parts[i] + parts[j]) != rank:
                continue
            parts[i], parts[j], after[i] = parts[i] + parts[j], b"", after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(parts) and (r := self.of.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a))
        return [self.of[p] for p in parts if p]


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER by code point, as the pattern's \\p{L}, \\p{N} and \\s have it."""
    out = np.full(0x110000, OTHER, np.uint8)
    for block in range(0, 0x110000, 0x800):
        if 0xD800 <= block < 0xE000:  # surrogates aren't characters
            continue
        every = "".join(map(chr, range(block, block + 0x800)))
        for kind, found in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
            for m in regex.finditer(found, every):
                out[block + m.start() : block + m.end()] = kind
    return out


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the pattern's matches, and len+1 offsets into them by text.

    The pattern: an English clitic ('s 't 're 've 'm 'll 'd), or letters,
    numbers or other signs after at most one space, or white space, which
    leaves its last sign to what follows.
    """
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    n = len(lead)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kinds = char_classes()[points]
    ends_of_text = np.searchsorted(lead, offsets)
    fresh = np.zeros(n + 1, bool)  # a text begins here
    fresh[ends_of_text] = True
    change = np.ones(n + 1, bool)
    change[1:n] = kinds[1:] != kinds[:-1]
    start = change | fresh
    begin = np.flatnonzero(start[:n])
    end = np.append(begin[1:], n)
    kind = kinds[begin] if n else kinds
    cut = start.copy()
    space = np.flatnonzero(kind == SPACE)
    last = end[space] - 1
    inner = ~fresh[end[space]]  # something follows the white space
    blank = points[last] == 32
    cut[last[inner]] = True  # the last sign stands apart ...
    cut[end[space[inner & blank]]] = False  # ... or, a space, begins what follows
    cut[begin[space]] = True
    # clitics: a lone apostrophe that begins a match, before letters
    quote = np.flatnonzero((points[begin] == 39) & (end - begin == 1)) if n else begin
    at = begin[quote]
    at = at[cut[at] & ~fresh[at + 1]]
    follow = lambda k: np.where((at + k < n) & ~fresh[np.minimum(at + 1, n)] & ((k < 2) | ~fresh[np.minimum(at + 2, n)]), points[np.minimum(at + k, n - 1)], 0) if n else at
    one, two = follow(1), follow(2)
    single = np.isin(one, [ord(c) for c in "stmd"])
    double = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    for found, size in ((single, 2), (double, 3)):
        p = at[found]
        cut[p + 1] = False
        cut[np.minimum(p + size, n)] = True
    first = np.flatnonzero(cut[:n])
    bounds = np.append(lead, len(data))
    return bounds[first], bounds[np.append(first[1:], n)] if len(first) else bounds[:0], np.searchsorted(first, ends_of_text)


def replay(ranks: Ranks, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the pieces end to end, and len+1 offsets into them by piece."""
    sizes = ends - starts
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    total = int(bounds[-1])
    if not total:
        return np.zeros(0, np.int32), bounds
    piece = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    symbol = ranks.of_byte[data[np.arange(total) - bounds[:-1][piece] + starts[piece]]]
    after = np.arange(1, total + 1, dtype=np.int32)  # position of the next symbol, total at a piece's end
    after[bounds[1:] - 1] = total
    before = np.arange(-1, total - 1, dtype=np.int32)
    before[bounds[:-1]] = -1
    rank = np.full(total, NONE, np.int32)
    inner = np.flatnonzero(after < total)
    rank[inner] = ranks.merged(symbol[inner], symbol[inner + 1])
    alive = np.ones(total, bool)
    odd = np.zeros(len(sizes), bool)

    posted: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def post(where: np.ndarray, what: np.ndarray) -> None:
        order = np.argsort(what, kind="stable")
        where, what = where[order], what[order]
        cuts = np.flatnonzero(np.append(True, what[1:] != what[:-1]))
        for r, a, b in zip(what[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(what)], strict=True):
            if r in posted:
                posted[r].append(where[a:b])
            else:
                posted[r] = [where[a:b]]
                heapq.heappush(queue, r)

    have = np.flatnonzero(rank != NONE)
    if len(have):
        post(have, rank[have])
    while queue:
        r = heapq.heappop(queue)
        lists = posted.pop(r)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        at = at[(rank[at] == r) & alive[at]]
        if not len(at):
            continue
        if len(at) > 1 and (touch := after[at[:-1]] == at[1:]).any():  # of a run of adjoining pairs, every second one from the left
            edge = np.flatnonzero(np.append(True, ~touch))
            run = np.repeat(edge, np.diff(np.append(edge, len(at))))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
        gone = after[at]
        symbol[at] = r
        alive[gone] = False
        rank[gone] = NONE
        onward = after[gone]
        after[at] = onward
        has_next = onward < total
        before[onward[has_next]] = at[has_next]
        rank[at] = NONE
        rank[at[has_next]] = ranks.merged(symbol[at[has_next]], symbol[onward[has_next]])
        back = before[at]
        back = back[back >= 0]
        rank[back] = ranks.merged(symbol[back], symbol[after[back]]) if len(back) else NONE
        touched = np.unique(np.concatenate([at, back]))
        touched = touched[rank[touched] != NONE]
        late = rank[touched] < r
        if late.any():
            odd[piece[touched[late]]] = True
            touched = touched[~late]
        if len(touched):
            post(touched, rank[touched])
    tokens, owner = symbol[alive], piece[alive]
    counts = np.bincount(owner, minlength=len(sizes))
    if odd.any():
        again = {int(p): ranks.alone(data[starts[p] : ends[p]].tobytes()) for p in np.flatnonzero(odd)}
        cuts = np.concatenate([[0], np.cumsum(counts)])
        tokens = np.concatenate([np.asarray(again[p], np.int32) if p in again else tokens[cuts[p] : cuts[p + 1]] for p in range(len(sizes))])
        for p, ids in again.items():
            counts[p] = len(ids)
    return tokens, np.concatenate([[0], np.cumsum(counts)])


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The given ranges of ``flat`` end to end."""
    out = np.concatenate([[0], np.cumsum(sizes)])
    return flat[np.arange(out[-1]) + np.repeat(starts - out[:-1], sizes)]


def differ(a: np.ndarray, a_starts: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_starts: np.ndarray, b_sizes: np.ndarray) -> np.ndarray:
    """Whether each byte range of ``a`` is another text than that of ``b``."""
    out = a_sizes != b_sizes
    same = np.flatnonzero(~out)
    for k in range(0, len(same), 1 << 17):
        rows = same[k : k + (1 << 17)]
        sizes = a_sizes[rows]
        unlike = gather(a, a_starts[rows], sizes) != gather(b, b_starts[rows], sizes)
        if unlike.any():
            out[rows[np.unique(np.repeat(np.arange(len(rows)), sizes)[unlike])]] = True
    return out


class Encoder:
    """Encodes batches; remembers distinct pieces by hash up to a bound.

    A hash only finds a piece: its bytes are compared with the piece's own, and
    where they differ the piece is encoded alone.
    """

    def __init__(self, ranks: Ranks) -> None:
        self.ranks = ranks
        self.forget()

    def forget(self) -> None:
        self.hashes, self.tokens, self.starts, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.plain, self.plain_starts, self.plain_sizes = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def parts(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, their tokens end to end, offsets into these by text) for row ranges of some MB.

        All new pieces are replayed together before; only their bytes and
        every piece's number are kept meanwhile.
        """
        waiting, fresh, plain = [], [], []
        i, n = 0, len(offsets) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE_BYTES, "right")) - 1)
            own = data[offsets[i] : offsets[j]]
            starts, ends, by_text = pieces(own, offsets[i : j + 1] - offsets[i])
            sizes = ends - starts
            hashes, first, inverse = np.unique(tb.hash_ranges(own, starts, ends), return_index=True, return_inverse=True)
            other = np.flatnonzero(differ(own, starts, sizes, own, starts[first][inverse], sizes[first][inverse]))
            known = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
            new = first[self.hashes[known] != hashes] if len(self.hashes) else first
            fresh.append((tb.hash_ranges(own, starts[new], ends[new]), sizes[new]))
            plain.append(gather(own, starts[new], sizes[new]))
            waiting.append((i, j, hashes, inverse.astype(np.int32), by_text, offsets[i] + starts[first], sizes[first], [(int(k), own[starts[k] : ends[k]].tobytes()) for k in other]))
            i = j
        if not waiting:
            return
        hashes, sizes = (np.concatenate(x) for x in zip(*fresh, strict=True))
        flat = np.concatenate(plain)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        hashes, first = np.unique(hashes, return_index=True)
        tokens, cuts = replay(self.ranks, flat, bounds[:-1][first], bounds[1:][first])
        order = np.argsort(np.concatenate([self.hashes, hashes]), kind="stable")
        self.hashes = np.concatenate([self.hashes, hashes])[order]
        self.starts = np.concatenate([self.starts, cuts[:-1] + len(self.tokens)])[order]
        self.sizes = np.concatenate([self.sizes, np.diff(cuts)])[order]
        self.tokens = np.concatenate([self.tokens, tokens])
        self.plain_starts = np.concatenate([self.plain_starts, bounds[:-1][first] + len(self.plain)])[order]
        self.plain_sizes = np.concatenate([self.plain_sizes, sizes[first]])[order]
        self.plain = np.concatenate([self.plain, flat])
        del plain, fresh, flat
        for i, j, hashes, inverse, by_text, starts, sizes, other in waiting:
            at = np.searchsorted(self.hashes, hashes)
            wrong = differ(data, starts, sizes, self.plain, self.plain_starts[at], self.plain_sizes[at])
            if wrong.any():
                taken = {k for k, _ in other}
                other += [(int(k), data[starts[p] : starts[p] + sizes[p]].tobytes()) for p in np.flatnonzero(wrong) for k in np.flatnonzero(inverse == p) if k not in taken]
            counts = self.sizes[at][inverse]
            ids = gather(self.tokens, self.starts[at][inverse], counts)
            if other:
                cuts = np.cumsum(counts)[:-1]
                every = np.split(ids, cuts)
                for k, piece in other:
                    every[k] = np.array(self.ranks.alone(piece), np.int32)
                    counts[k] = len(every[k])
                ids = np.concatenate(every)
            yield i, j, ids, np.concatenate([[0], np.cumsum(counts)])[by_text]
        if len(self.hashes) > REMEMBERED:
            self.forget()

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts end to end, and len+1 offsets into them by text."""
        ids, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for _, _, own, by_text in self.parts(data, offsets):
            ids.append(own)
            sizes.append(np.diff(by_text))
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)

    def decode(self, ids: np.ndarray, by_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts end to end, and len+1 offsets into them by text."""
        sizes = self.ranks.lengths[ids]
        return gather(self.ranks.bytes, self.ranks.starts[ids], sizes), np.concatenate([[0], np.cumsum(sizes)])[by_text]


_loaded: dict[int, Encoder] = {}


def encoder(lines: bytes) -> Encoder:
    """This worker's encoder for a rank file's content."""
    key = hash(lines)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Encoder(Ranks(lines))
    return _loaded[key]


def byte_bpe(docs: DataFrame, ranks_path: str, text: str = "text", key: str = "doc_id", outputs: tuple[str, ...] = ("ids", "decoded"), pattern: str = PATTERN) -> DataFrame:
    """Per row: ``key``, ``n_tokens``, the digests of ids and of decoded bytes, and of ``ids`` and ``decoded`` (bytes) what ``outputs`` names.

    The rank file is read on the driver and broadcast; a vocabulary's size doesn't depend on the data.
    """
    import hashlib

    if pattern != PATTERN:
        raise ValueError("texts are split by one pattern only: " + PATTERN)
    with open(ranks_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    source = small_batches(docs.select(docs[key].alias("key"), docs[text].alias("text")))
    kinds = {"ids": "array<int>", "decoded": "binary"}
    schema = f"key {source.schema['key'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + "".join(f", {c} {kinds[c]}" for c in outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)
        for batch in tb.gathered(batches, CORPUS_BYTES):
            for chunk, data, offsets in tb.chunks(batch, "text", CORPUS_BYTES):
                for i, j, ids, by_text in own.parts(data, offsets):
                    rows, n = chunk.slice(i, j - i), j - i
                    decoded, ends = own.decode(ids, by_text)
                    raw, plain = ids.astype("<u4").tobytes(), decoded.tobytes()
                    out = [
                        rows.column(0), pa.array(np.diff(by_text), pa.int64()),
                        pa.array([hashlib.sha256(raw[4 * by_text[i] : 4 * by_text[i + 1]]).hexdigest() for i in range(n)], pa.string()),
                        pa.array([hashlib.sha256(plain[ends[i] : ends[i + 1]]).hexdigest() for i in range(n)], pa.string()),
                    ]
                    made = {
                        "ids": lambda: pa.ListArray.from_arrays(pa.array(by_text, pa.int32()), pa.array(ids, pa.int32())),  # noqa: B023
                        "decoded": lambda: pa.array([plain[ends[i] : ends[i + 1]] for i in range(n)], pa.binary()),  # noqa: B023
                    }
                    out += [made[c]() for c in outputs]
                    yield pa.RecordBatch.from_arrays(out, ["key", "n_tokens", "ids_sha256", "decoded_sha256", *outputs])

    return source.mapInArrow(run, schema).withColumnRenamed("key", key)
