"""Line dedup by a deletion-neighbourhood join.

A line is its words (lower case in A-Z, runs without white space) with single
spaces between.  Two lines are equal if these are; they are also near if one
character (code point) substituted, inserted or deleted makes them equal and
the longer one has at least ``EDIT_CHARS`` characters, so that at most a tenth
of a line differs.  A line goes if an equal or near line stands earlier, in
the order of (id, hash of the text, line number).

1. One pass reduces each line to two independent hashes, 128 bits that stand
   for the line, and to keys of its halves.  An edit leaves one half of a line
   as it was, so only lines that share a half key with a different line can
   have a neighbour.  Up to ``BLOOM_KEYS`` of those keys go into a Bloom filter
   whose size follows their number; more are joined with the lines instead.
2. A second pass over the lines that are left emits the deletion
   neighbourhood: for each character a key of the line without it, and a key
   of the whole line.  Keys that different lines share are joined.  Every key
   keeps just its earliest line for each role, so a group of any size costs one
   row a line, not a row a pair.
3. Each line's earliest candidate is checked: the characters' edit distance.
4. Lines to drop are joined to the documents by id and hash of the text.

Defined cases: null and empty texts stay as they are; rows with equal id and
text lose the same lines; a null id sorts first; white lines stay; very long
lines are compared whole; an empty table gives an empty one; columns
``n_lines`` and ``n_dropped`` of the input are replaced, others keep their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import textbatch as tb
from plumbline.llm.shared import small_batches, stored

#: Characters that the longer of two near lines has at least.
EDIT_CHARS = 10
#: Half keys that may go into a filter, of 2 bytes each; it is sent to all tasks.
BLOOM_KEYS = 1 << 24
#: Characters whose variants a task is meant to hold at a time.
BUCKET_CHARS = 400_000
#: Two primes, and a base for each, of the hashes from which one character can be taken out.
PRIMES, BASES = (2147483647, 2147483629), (1000003, 69069069)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of the given ranges end to end."""
    out = np.concatenate([[0], np.cumsum(sizes)])
    return np.arange(out[-1]) + np.repeat(starts - out[:-1], sizes)


class Lines:
    """The lines of a chunk that aren't white: text, number within it, normal form."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        low = tb.lower_ascii(data)
        starts, ends = tb.runs(~tb.is_space(data), offsets)
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        cut[1:] |= data == 10
        edges = np.flatnonzero(cut)  # where a line begins, and the chunk's end
        edges = edges if len(edges) > 1 else np.array([0, len(data)])
        words = np.searchsorted(starts, edges)
        sizes = np.diff(words)
        doc = np.searchsorted(offsets, edges[:-1], "right") - 1
        first = np.searchsorted(edges, offsets[:-1])[doc]
        keep = np.flatnonzero(sizes)
        self.doc, self.number = doc[keep], (np.arange(len(sizes)) - first)[keep]
        line = np.repeat(np.arange(len(sizes)), sizes)
        joined = np.zeros(len(starts), np.int64)  # one space more, where a word of the same line follows
        joined[:-1] = line[1:] == line[:-1]
        lengths = ends - starts + joined
        #: The lines' normal forms end to end, and len+1 offsets into them.
        self.norm = low[ranges(starts, lengths)]
        after = np.cumsum(lengths)
        self.norm[after[joined > 0] - 1] = 32
        self.bounds = np.concatenate([[0], after])[np.append(words[:-1][keep], len(starts))]
        self.leads = np.append(np.flatnonzero((self.norm & 0xC0) != 0x80), len(self.norm))  # where characters begin
        self.first = np.searchsorted(self.leads, self.bounds)
        self.size = np.diff(self.first)

    def hashes(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.bounds[:-1][lines], self.bounds[1:][lines]
        return tb.hash_ranges(self.norm, a, b, 1), tb.hash_ranges(self.norm, a, b, 2)

    def halves(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of first and last halves, with their lines; two sizes of half for an even number of characters."""
        able = np.flatnonzero(self.size >= EDIT_CHARS - 1)
        n, first = self.size[able], self.first[:-1][able]
        keys, lines = [np.zeros(0, np.uint64)], [able[:0]]
        for odd in (0, 1):
            some = np.ones(len(able), bool) if not odd else n % 2 == 0  # the other size of half, where it is another
            h = ((n - odd) // 2)[some]
            begin, end = self.leads[first[some]], self.leads[(first + n)[some]]
            for side, (a, b) in enumerate(((begin, self.leads[first[some] + h]), (self.leads[(first + n)[some] - h], end))):
                keys.append(tb.mix(tb.hash_ranges(self.norm, a, b, 3) + h.astype(np.uint64) * np.uint64(2) + np.uint64(side)))
                lines.append(able[some])
        return np.concatenate(keys), np.concatenate(lines)

    def text(self, line: int) -> str:
        return self.norm[self.bounds[line] : self.bounds[line + 1]].tobytes().decode()


def powers(n: int, base: int, prime: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)])
    return out[:n]


def variants(points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, place, line): of each line of code points the line without each character, and with place -1 the whole line."""
    size = np.diff(bounds)
    line = np.repeat(np.arange(len(size)), size)
    nth = np.arange(len(points)) - bounds[:-1][line]
    cut, full = np.zeros(len(points), np.uint64), np.zeros(len(size), np.uint64)
    for prime, base in zip(PRIMES, BASES, strict=True):
        p = np.uint64(prime)
        power = powers(int(size.max()) + 1 if len(size) else 1, base, prime)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power[nth] % p)])
        before = (sums[:-1] - sums[bounds[:-1]][line]) % p
        after = (sums[bounds[1:]][line] - sums[1:]) % p
        cut = cut << np.uint64(32) | (before + after * np.uint64(pow(base, -1, prime))) % p
        full = full << np.uint64(32) | (sums[bounds[1:]] - sums[bounds[:-1]]) % p
    cut = tb.mix(tb.mix(cut) + (size[line] - 1).astype(np.uint64))
    full = tb.mix(tb.mix(full) + size.astype(np.uint64))
    long = size >= EDIT_CHARS  # only the longer of two near lines has to be
    cut, nth, line = cut[long[line]], nth[long[line]], line[long[line]]
    return np.concatenate([cut, full]), np.concatenate([nth, np.full(len(size), -1)]), np.concatenate([line, np.arange(len(size))])


def meetings(keys: np.ndarray, places: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, role, line) of the variants that meet one of another line.

    Role 0: substitution, two lines without a character at the same place; 1 and
    2: a line without a character, and the whole other line.
    """
    order = np.lexsort((lines, places, keys))
    keys, places, lines = keys[order], places[order], lines[order]
    if not len(keys):
        return keys, places.astype(np.int8), lines
    new_key = np.append(True, keys[1:] != keys[:-1])
    new_both = new_key | np.append(True, places[1:] != places[:-1])
    group = np.flatnonzero(new_both)
    last = np.append(group[1:], len(keys)) - 1
    sub = np.repeat(lines[group] != lines[last], last - group + 1) & (places >= 0)
    of_key = np.cumsum(new_key) - 1
    whole = np.bincount(of_key, places < 0) > 0
    less = np.bincount(of_key, places >= 0) > 0
    both = (whole & less)[of_key]
    key = np.concatenate([tb.mix(keys[sub] + places[sub].astype(np.uint64) + np.uint64(1)) ^ np.uint64(1), keys[both]])
    role = np.concatenate([np.zeros(int(sub.sum()), np.int8), np.where(places[both] < 0, 2, 1).astype(np.int8)])
    return key, role, np.concatenate([lines[sub], lines[both]])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _spots(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each key in a filter of a power of two bits."""
    return (keys & np.uint64(bits - 1)).astype(np.int64), ((keys >> np.uint64(32)) * np.uint64(0x9E3779B1) >> np.uint64(8) & np.uint64(bits - 1)).astype(np.int64)


def filter_of(shared_keys: DataFrame, count: int) -> np.ndarray:
    """A Bloom filter of 16 to 32 bits a key: tasks send their keys' words, the driver joins them."""
    bits = max(1 << 10, 1 << (16 * max(count, 1) - 1).bit_length())

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots = np.concatenate(_spots(batch.column(0).to_numpy().view(np.uint64), bits))
            word, which = np.unique(spots >> 6, return_inverse=True)
            own = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(own, which, np.uint64(1) << (spots & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array([word.astype(np.int32).tobytes()], pa.binary()), pa.array([own.tobytes()], pa.binary())], ["word", "own"])

    out = np.zeros(bits >> 6, np.uint64)
    for r in shared_keys.select("half").mapInArrow(words, "word binary, own binary").toLocalIterator():
        np.bitwise_or.at(out, np.frombuffer(bytes(r.word), np.int32), np.frombuffer(bytes(r.own), np.uint64))
    return out


def dropped_lines(docs: DataFrame, text: str, key: str, name: str = "line_dedup") -> DataFrame:
    """(id, text_hash, drops): the numbers, from 0, of the lines that go, for rows that have such."""
    spark = docs.sparkSession
    source = small_batches(docs.select(docs[key].alias("id"), F.xxhash64(docs[text]).alias("text_hash"), docs[text].alias("text")))
    kind = source.schema["id"].dataType.simpleString()

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in tb.chunks(batch, "text"):
                own = Lines(data, offsets)
                keys, of = own.halves()
                order = np.argsort(of, kind="stable")
                bounds = np.searchsorted(of[order], np.arange(len(own.size) + 1))
                halves = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), _signed(keys[order]))
                take = pa.array(own.doc)
                h1, h2 = own.hashes(np.arange(len(own.size)))
                yield pa.RecordBatch.from_arrays([rows.column(0).take(take), rows.column(1).take(take), pa.array(own.number, pa.int32()), _signed(h1), _signed(h2), halves], ["id", "text_hash", "number", "h1", "h2", "halves"])

    lines = stored(source.mapInArrow(reduced, f"id {kind}, text_hash bigint, number int, h1 bigint, h2 bigint, halves array<bigint>"), name + "/lines")
    place = F.struct("id", "text_hash", "number")

    # 1. half keys that different lines share
    halves = lines.select("h1", F.explode("halves").alias("half"))
    shared_keys = stored(halves.groupBy("half").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("half"), name + "/halves")
    count = shared_keys.count()
    if count <= BLOOM_KEYS:
        shared = spark.sparkContext.broadcast(filter_of(shared_keys, count))
        candidates = source.withColumn("numbers", F.lit(None).cast("array<int>"))
    else:
        shared = None
        able = lines.select("id", "text_hash", "number", F.explode("halves").alias("half")).join(shared_keys, "half", "left_semi")
        numbers = stored(able.groupBy("id", "text_hash").agg(F.collect_set("number").alias("numbers")), name + "/numbers")
        here = numbers.select(F.col("id").alias("own"), F.col("text_hash").alias("own_hash"), "numbers")
        candidates = source.join(here, F.col("id").eqNullSafe(F.col("own")) & (F.col("text_hash") == F.col("own_hash"))).select("id", "text_hash", "text", "numbers")

    # 2. the deletion neighbourhood of what is left
    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value if shared else None
        for batch in batches:
            for rows, data, offsets in tb.chunks(batch, "text"):
                own = Lines(data, offsets)
                chosen = np.zeros(len(own.size), bool)
                if bits is None:
                    wanted = rows.column(3).combine_chunks() if isinstance(rows.column(3), pa.ChunkedArray) else rows.column(3)
                    listed = np.repeat(np.arange(rows.num_rows), wanted.value_lengths().to_numpy(zero_copy_only=False)) << 32 | wanted.flatten().to_numpy()
                    chosen = np.isin(own.doc << 32 | own.number, listed)
                else:
                    keys, of = own.halves()
                    hit = np.ones(len(keys), bool)
                    for spot in _spots(keys, len(bits) << 6):
                        hit &= bits[spot >> 6] >> (spot & 63).astype(np.uint64) & np.uint64(1) == 1
                    chosen[of[hit]] = True
                at = np.flatnonzero(chosen)
                h1, h2 = own.hashes(at)
                take = pa.array(own.doc[at])
                yield pa.RecordBatch.from_arrays([rows.column(0).take(take), rows.column(1).take(take), pa.array(own.number[at], pa.int32()), _signed(h1), _signed(h2), pa.array([own.text(k) for k in at.tolist()], pa.string())], ["id", "text_hash", "number", "h1", "h2", "line"])

    found = candidates.mapInArrow(neighbours, f"id {kind}, text_hash bigint, number int, h1 bigint, h2 bigint, line string")
    near = stored(found.groupBy("h1", "h2").agg(F.min(place).alias("place"), F.first("line").alias("line")), name + "/near")

    buckets = max(8, int(near.agg(F.sum(F.length("line"))).first()[0] or 0) // BUCKET_CHARS)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in tb.chunks(batch, "line"):
                points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
                leads = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
                keys, places, of = variants(points, np.searchsorted(leads, offsets))
                bucket = (keys % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((places, of, bucket))
                edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
                parts = [(p, order[edges[p] : edges[p + 1]]) for p in np.flatnonzero(np.diff(edges)).tolist()]
                names = rows.column(0).to_numpy()
                out = [[], [], [], []]
                for _, at in parts:  # a line's name once
                    mine, which = np.unique(of[at], return_inverse=True)
                    for k, x in enumerate((keys[at], places[at].astype(np.int32), which.astype(np.int32), names[mine])):
                        out[k].append(x.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in parts], pa.int32()), *[pa.array(x, pa.binary()) for x in out]], ["bucket", "keys", "places", "lines", "names"])

    def met(table: pa.Table) -> pa.Table:
        """Of a bucket's variants those that meet variants of other lines."""
        column = lambda c, k: [np.frombuffer(x, k) for x in table[c].to_pylist()]
        names = [n[i] for n, i in zip(column("names", np.int64), column("lines", np.int32), strict=True)]
        key, role, line = meetings(np.concatenate(column("keys", np.uint64)), np.concatenate(column("places", np.int32)), np.concatenate(names))
        return pa.table({"key": key.view(np.int64), "role": role, "h1": line})

    spread = near.select("h1", "line").mapInArrow(packed, "bucket int, keys binary, places binary, lines binary, names binary")
    entries = spread.groupBy("bucket").applyInArrow(met, "key bigint, role tinyint, h1 bigint").distinct()
    entries = stored(entries.join(near.select("h1", "h2", "place"), "h1"), name + "/variants")
    line = F.struct("place", "h1", "h2")
    earliest = entries.groupBy("key").agg(
        F.min("h1").alias("a"), F.max("h1").alias("b"),
        *[F.min(F.when(F.col("role") == r, line)).alias(f"e{r}") for r in (0, 1, 2)],
    ).where("a <> b").drop("a", "b")
    other = F.when(F.col("role") == 0, F.col("e0")).when(F.col("role") == 1, F.col("e2")).otherwise(F.col("e1"))
    pairs = entries.join(earliest, "key").select("h1", "h2", "place", other.alias("other")).where(F.col("other.place") < F.col("place"))
    best = pairs.groupBy("h1", "h2").agg(F.min("other").alias("other"))

    # 3. the edit distance itself
    left = near.select("h1", "h2", "line")
    right = near.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("line").alias("other_line"))
    both = best.select("h1", "h2", F.col("other.h1").alias("o1"), F.col("other.h2").alias("o2")).join(left, ["h1", "h2"]).join(right, ["o1", "o2"]).select("h1", "h2", "line", "other_line")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [one_edit(a, b) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["h1", "h2"]).filter(pa.array(ok, pa.bool_()))

    gone = both.mapInArrow(verified, "h1 bigint, h2 bigint").withColumn("gone", F.lit(True))

    # 4. places of lines that go
    repeated = lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    known = repeated.join(gone, ["h1", "h2"], "left").where("n > 1 or gone").select("h1", "h2", "first", F.coalesce("gone", F.lit(False)).alias("gone"))
    known = stored(known, name + "/known")  # by itself, so that the join can be split at frequent lines
    out = lines.join(known, ["h1", "h2"]).where(F.col("gone") | (place > F.col("first")))
    return out.groupBy("id", "text_hash").agg(F.collect_set("number").alias("drops"))


def one_edit(a: str, b: str) -> bool:
    """Whether at most one character substituted, inserted or deleted makes the texts equal."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def line_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", name: str = "line_dedup") -> DataFrame:
    """``docs`` with the lines that go left out of ``text``, and ``n_lines``, ``n_dropped`` (such columns of the input are replaced)."""
    drops = dropped_lines(docs, text, key, name)
    mine = {"n_lines", "n_dropped"}
    row = docs.select(F.struct(*[docs[c] for c in docs.columns if c.lower() not in mine]).alias("row"), docs[key].alias("own"), F.xxhash64(docs[text]).alias("own_hash"))
    joined = row.join(drops, F.col("own").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("text_hash")), "left")
    split = joined.select("row", "drops", F.split(F.col(f"row.{text}"), "\n").alias("lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drops")  # hashed, so it costs no more than the lines
    kept = F.when(F.col("drops").isNull(), F.col(f"row.{text}")).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    columns = [kept.alias(c) if c == text else F.col(f"row.{c}").alias(c) for c in docs.columns if c.lower() not in mine]
    n_lines = F.coalesce(F.when(F.col(f"row.{text}").isNotNull(), F.size("lines")), F.lit(0)).alias("n_lines")
    return split.select(*columns, n_lines, F.coalesce(F.size("drops"), F.lit(0)).alias("n_dropped"))


ORACLE = r"""
WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS num FROM a),
w AS (SELECT doc_id, num, list_filter(string_split_regex(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM l),
c AS (SELECT doc_id, num, array_to_string(ws, ' ') AS k, doc_id * 1000000 + num AS place FROM w WHERE len(ws) > 0),
d AS (SELECT k, length(k) AS n, hash(k) AS h, min(place) AS first FROM c GROUP BY k),
s AS (SELECT k, n, first, unnest(range(1, n + 1)) AS i FROM d WHERE n >= 10),
v AS (SELECT k, n, first, i, hash(substr(k, 1, i - 1) || substr(k, i + 1)) AS rest FROM s),
m AS (SELECT k, first, min(first) OVER (PARTITION BY n, i, rest) AS other FROM v),
x AS (SELECT v.k FROM v JOIN d ON d.h = v.rest AND d.n = v.n - 1 AND d.first < v.first
      UNION ALL SELECT d.k FROM v JOIN d ON d.h = v.rest AND d.n = v.n - 1 AND v.first < d.first
      UNION ALL SELECT k FROM m WHERE other < first),
g AS (SELECT DISTINCT k FROM x),
z AS (SELECT c.doc_id, c.num FROM c JOIN d USING (k) LEFT JOIN g USING (k) WHERE c.place > d.first OR g.k IS NOT NULL),
t AS (SELECT l.doc_id, count(*) AS n_lines, count(z.num) AS n_dropped, string_agg(CASE WHEN z.num IS NULL THEN line END, chr(10) ORDER BY l.num) AS text
      FROM l LEFT JOIN z ON z.doc_id = l.doc_id AND z.num = l.num GROUP BY l.doc_id)
SELECT doc_id, coalesce(text, '') AS text, n_lines::INTEGER AS n_lines, n_dropped::INTEGER AS n_dropped FROM t
"""
