"""N-gram Jaccard self-join by chosen paths.

A text is the set of its runs of five words (a shorter text with words: one
run of all of them).  Texts with equal sets become one node.  A node's set is
embedded into 128 coordinates, each holding a minimum hash, so that two sets
agree in each coordinate with a chance equal to their Jaccard similarity
(one permutation, densified).

A path starts at the root of a run.  At a path some coordinates are sampled,
``1 / similarity`` on average, and a node goes on to one path for each of
them, named by the path, the coordinate and its value: nodes that share a
sampled token stay together.  A path with few nodes is compared by brute force
on the embedded sets; one with more is split again, up to ``DEPTH`` times;
what is still large then is compared in pairs of blocks.  A pair at the
threshold survives one run to the last depth with a known chance, and runs are
repeated until the chance to miss it in all is below ``1 - RECALL``.

The comparison of embedded sets leaves out pairs that are clearly below the
threshold and keeps a spanning forest.  Within the components of that forest
all pairs are then verified exactly, by products of incidence matrices over
blocks: a link is a pair with Jaccard similarity of ``SIMILARITY`` or more.
Tasks return a count and one link of a spanning forest for each node, so groups
of any size cost no row a pair, and links within a found component are complete.

Defined cases: texts that are null or have no words link with nothing; rows
with equal sets link with each other, also with equal ids; a class is named by
its smallest id that isn't null; very long texts are taken whole, and blocks
are bounded by set sizes; an empty table gives an empty one; other columns of
the input, whatever their names, are ignored, and ``deduplicated`` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import textbatch as tb
from plumbline.llm.embedding_dedup import _tree
from plumbline.llm.shared import block_pairs, components, only_in, small_batches, stored

WIDTH, SIMILARITY = 5, 0.8
COORDINATES, RECALL, DEPTH = 128, 0.99, 3
#: Nodes of a path that are compared by brute force without splitting.
FEW = 256
#: Nodes of a block when embedded sets are compared; tokens of a block when sets are.
BLOCK, BLOCK_TOKENS = 1024, 600_000
#: Embedded sets that agree in a smaller share of coordinates aren't verified: four standard deviations below.
ESTIMATE = SIMILARITY - 4 * (SIMILARITY * (1 - SIMILARITY) / COORDINATES) ** 0.5


def survival(depth: int) -> float:
    """Chance that a pair at the threshold still shares a path at the depth: one shared child on average."""
    alive = 1.0
    for _ in range(depth):
        alive = 1 - float(np.exp(-alive))
    return alive


RUNS = int(np.ceil(np.log(1 - RECALL) / np.log(1 - survival(DEPTH))))


def text_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tb.unique_by_text(*tb.shingles(*tb.words(tb.lower_ascii(data), offsets), WIDTH))


def fingerprints(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each set, from two independent sums over its tokens and its size."""
    total = np.zeros(len(bounds) - 1, np.uint64)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        for salt in (0x1234567, 0x89ABCDEF):
            total[some] = tb.mix(total[some] + np.add.reduceat(tb.mix(sets ^ np.uint64(salt)), bounds[:-1][some]))
    return tb.mix(total + np.diff(bounds).astype(np.uint64))


def embedded(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Coordinates of each set: one permutation hashing, empty coordinates filled from others in hashed order."""
    docs = len(bounds) - 1
    hashed = tb.mix(sets ^ np.uint64(0xC0FFEE))
    doc = np.repeat(np.arange(docs), np.diff(bounds))
    out = np.full(docs * COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    place = doc * COORDINATES + (hashed >> np.uint64(57)).astype(np.int64)
    order = np.lexsort((hashed, place))
    first = order[np.append(True, place[order][1:] != place[order][:-1])] if len(order) else order
    out[place[first]] = hashed[first]
    out = out.reshape(docs, COORDINATES)
    full = out != np.iinfo(np.uint64).max
    able = full.any(1)
    filled = full.copy()
    for attempt in range(1, 100_000):
        rows, columns = np.nonzero(~filled & able[:, None])
        if not len(rows):
            break
        source = (tb.mix(columns.astype(np.uint64) * np.uint64(100_003) + np.uint64(attempt)) % np.uint64(COORDINATES)).astype(np.int64)
        good = full[rows, source]
        out[rows[good], columns[good]] = out[rows[good], source[good]]
        filled[rows[good], columns[good]] = True
    return tb.mix(out)


def root_paths(coordinates: np.ndarray) -> np.ndarray:
    """Each set's paths after one split of every run's root, by whole coordinates."""
    parts = []
    for run in range(RUNS):
        path = tb.mix(np.array([run + 1], np.uint64))
        spots = np.flatnonzero(_sampled(path)[0])
        parts.append(_child(path[0], spots[None, :], coordinates[:, spots]))
    return np.concatenate(parts, 1)


SPOTS = tb.mix(np.arange(COORDINATES).astype(np.uint64) + np.uint64(1))


def _sampled(paths: np.ndarray) -> np.ndarray:
    return tb.mix(paths[:, None] ^ SPOTS[None, :]) < np.uint64(int(2**64 / SIMILARITY / COORDINATES))


def _child(path: np.ndarray, spot: np.ndarray, value: np.ndarray) -> np.ndarray:
    return tb.mix(tb.mix(path + SPOTS[spot]) ^ (value.astype(np.uint64) + np.uint64(1)))


def split(paths: np.ndarray, coordinates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of each path by the low bits of the coordinates, enough among sets that share a path: (row, path)."""
    row, spot = np.nonzero(_sampled(paths))
    return row, _child(paths[row], spot, coordinates[row, spot])


def _coordinates(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, COORDINATES)


def _paths(node: np.ndarray, path: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(node)], ["path", "node"])


def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            row, path = split(part.column(0).to_numpy().view(np.uint64), _coordinates(part.column(2)))
            yield _paths(part.column(1).to_numpy()[row], path)


def brute_force(table: pa.Table) -> pa.Table:
    """Of the rows (path, node, coordinates, low) a forest of the pairs on one path whose coordinates agree enough."""
    path, node, low = (table[c].to_numpy() for c in ("path", "node", "low"))
    same_block = table["block"][0].as_py() == table["other"][0].as_py()
    order = np.argsort(path, kind="stable")
    path, node, low = path[order], node[order], low[order]
    own = _coordinates(table["coordinates"])[order]
    least = int(np.ceil(ESTIMATE * COORDINATES))
    found = [np.zeros((2, 0), np.int64)]
    left = np.arange(len(path))
    for step in range(1, len(path)):
        left = left[left + step < len(path)]
        left = left[path[left] == path[left + step]]
        if not len(left):
            break
        right = left + step
        both = left if same_block else left[low[left] != low[right]]
        for a in range(0, len(both), 8192):
            i = both[a : a + 8192]
            hit = i[(own[i] == own[i + step]).sum(1) >= least]
            found.append(np.array([node[hit], node[hit + step]]))
        if len(found) > 256:
            found = [_tree(np.concatenate(found, 1))]
    forest = _tree(np.concatenate(found, 1))
    return pa.table({"a": forest[0], "b": forest[1]})


def verified(table: pa.Table) -> pa.Table:
    """Links of the rows (cluster, node, copies, tokens, low), counted by node, and a forest of them."""
    same_block = table["block"][0].as_py() == table["other"][0].as_py()
    cluster, node, copies, low = (table[c].to_numpy() for c in ("cluster", "node", "copies", "low"))
    order = np.lexsort((node, cluster))
    order = order[np.append(True, (node[order][1:] != node[order][:-1]) | (cluster[order][1:] != cluster[order][:-1]))]
    sets = table["tokens"].to_pylist()
    edges = np.flatnonzero(np.append(True, cluster[order][1:] != cluster[order][:-1]))
    out_node, out_n, out_root = [], [], []
    for begin, end in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=True):
        own = order[begin:end]
        if len(own) < 2:
            continue
        parts = [np.frombuffer(sets[i], np.uint64) for i in own]
        sizes = np.array([len(p) for p in parts])
        row = np.repeat(np.arange(len(own)), sizes)
        _, token, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        more = times[token] > 1
        row, token = row[more], (np.cumsum(times > 1) - 1)[token[more]]
        by_token = np.argsort(token, kind="stable")
        row, token = row[by_token], token[by_token]
        common = np.zeros((len(own), len(own)), np.float32)
        shared = int(token[-1]) + 1 if len(token) else 0
        width = max(1, min(shared, (4 << 20) // len(own)))
        for a in range(0, shared, width):
            s = slice(*np.searchsorted(token, [a, a + width]))
            grid = np.zeros((len(own), width), np.float32)
            grid[row[s], token[s] - a] = 1
            common += grid @ grid.T
        hit = common >= SIMILARITY * (sizes[:, None] + sizes[None, :] - common) - 1e-6
        if not same_block:
            hit &= low[own][:, None] != low[own][None, :]
        np.fill_diagonal(hit, False)
        tree = _tree(np.array(np.nonzero(hit)))
        root = np.arange(len(own))
        root[tree[0]] = tree[1]
        some = hit.any(1)
        out_node.append(node[own][some])
        out_n.append((hit @ copies[own])[some])
        out_root.append(node[own][root][some])
    join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
    return pa.table({"node": join(out_node), "n": join(out_n), "root": join(out_root)})


def jaccard_join(docs: DataFrame, text: str = "text", key: str = "doc_id", name: str = "chosen_path") -> DataFrame:
    """Per row: ``key``, ``n_links`` (other rows linked directly), ``class_id`` (smallest id reachable by links), ``kept`` (is it that row), ``root`` (names the class, also where ids are null), ``text_hash``."""
    source = small_batches(docs.select(docs[key].alias("id"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("text_hash")))
    kind = source.schema["id"].dataType.simpleString()

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in tb.chunks(batch, "text"):
                sets, bounds = text_sets(data, offsets)
                none = np.diff(bounds) == 0
                own = embedded(sets, bounds)
                paths, low = root_paths(own).view(np.int64), (own & np.uint64(0xFFFF)).astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(2), pa.array(fingerprints(sets, bounds).view(np.int64), mask=none), pa.array(np.diff(bounds), pa.int64()), pa.array([None if n else x.tobytes() for x, n in zip(low, none, strict=True)], pa.binary()), pa.array(list(paths), pa.list_(pa.int64()))],
                    ["id", "text_hash", "node", "size", "coordinates", "paths"],
                )

    rows = stored(source.mapInArrow(reduced, f"id {kind}, text_hash bigint, node bigint, size bigint, coordinates binary, paths array<bigint>"), name + "/rows")
    grouped = rows.where("node is not null").groupBy("node").agg(F.min("id").alias("first"), F.min(F.struct("text_hash", "id")).alias("picked"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("coordinates").alias("coordinates"), F.first("paths").alias("paths"))
    nodes = stored(grouped, name + "/nodes")

    # paths, until each is small or deep enough
    pairs = []
    level = nodes.select(F.explode("paths").alias("path"), "node")
    for depth in range(1, DEPTH + 1):
        sizes = stored(level.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), name + "/sizes")  # by itself, so that the join can be split at large paths
        shared = stored(level.join(sizes, "path"), name + "/paths")
        large = F.col("n") > FEW
        pairs.append(shared if depth == DEPTH else shared.where(~large))
        deeper = shared.where(large)
        if depth == DEPTH or deeper.isEmpty():
            break
        level = stored(deeper.join(nodes.select("node", "coordinates"), "node").select("path", "node", "coordinates").mapInArrow(further, "path bigint, node bigint"), name + "/paths")
    every = pairs[0]
    for more in pairs[1:]:
        every = every.union(more)
    met = every.join(nodes.select("node", "coordinates"), "node").select("path", "node", "n", "coordinates")
    few = met.where(F.col("n") <= FEW)
    buckets = max(8, few.count() // (4 * FEW))
    single = F.struct(F.lit(0).alias("block"), F.lit(0).alias("other"), F.lit(True).alias("low"))
    few = few.select(F.pmod(F.xxhash64(F.lit(3), "path"), F.lit(buckets)).alias("group"), "path", "node", "coordinates", single.alias("s")).select("group", "path", "node", "coordinates", "s.*")
    many = block_pairs(met.where(F.col("n") > FEW).drop("n"), ["path"], "node", BLOCK).select(F.col("path").alias("group"), "path", "node", "coordinates", "block", "other", "low")
    forest = few.groupBy("group").applyInArrow(brute_force, "a bigint, b bigint").union(many.groupBy("group", "block", "other").applyInArrow(brute_force, "a bigint, b bigint"))
    clusters = components(forest, name + "/candidates")

    # exact similarity within the components of candidates
    members = stored(clusters.select("node", F.col("root").alias("cluster")).join(nodes.select("node", "picked", "copies", "size"), "node"), name + "/members")

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a task sends a node once, however many rows have its id and text
        for batch in batches:
            nodes = batch.column(1).to_pylist()
            fresh = [n not in seen and not seen.add(n) for n in nodes]
            for rows, data, offsets in tb.chunks(batch.filter(pa.array(fresh, pa.bool_())), "text"):
                sets, bounds = text_sets(data, offsets)
                right = pa.array(fingerprints(sets, bounds).view(np.int64) == rows.column(1).to_numpy())
                tokens = pa.array([sets[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*rows.columns[1:], tokens], [*rows.schema.names[1:], "tokens"]).filter(right)

    count = members.count()
    texts = only_in(source, F.col("text_hash"), members.select(F.col("picked.text_hash").alias("k")), count)
    fetched = texts.join(members, (F.col("text_hash") == F.col("picked.text_hash")) & F.col("id").eqNullSafe(F.col("picked.id"))).select("text", "node", "cluster", "copies", "size")
    loaded = fetched.mapInArrow(with_sets, "node bigint, cluster bigint, copies bigint, size bigint, tokens binary")
    weight = F.greatest(F.col("size"), F.lit(BLOCK_TOKENS // BLOCK))
    heavy = members.groupBy("cluster").agg(F.sum(weight).alias("weight")).withColumn("blocks", F.ceil(F.col("weight") / BLOCK_TOKENS).cast("int"))
    dealt = block_pairs(loaded, ["cluster"], "node", BLOCK_TOKENS, heavy.select("cluster", "blocks"))
    group = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64(F.lit(4), "cluster"), F.lit(max(8, count // 512)))).otherwise(F.col("cluster"))
    found = stored(dealt.withColumn("group", group).select("group", "blocks", "cluster", "node", "copies", "tokens", "block", "other", "low").groupBy("group", "blocks", "block", "other").applyInArrow(verified, "node bigint, n bigint, root bigint"), name + "/links")
    linked = found.groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), name)

    info = nodes.select("node", "first", "copies").join(linked, "node", "left").join(roots, "node", "left")
    info = stored(info.select("node", "first", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")), name + "/info")
    least = info.groupBy("root").agg(F.min("first").alias("class"))
    each = info.join(least, "root").select(F.col("node").alias("at"), "n_links", "class", "root")
    joined = rows.select("id", "text_hash", "node").join(each, F.col("node") == F.col("at"), "left")
    own = F.coalesce("class", "id")
    return joined.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("class_id"), F.col("id").eqNullSafe(own).alias("kept"), "root", "text_hash")


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", name: str = "chosen_path") -> DataFrame:
    """``docs`` with one row of each class: of those with the smallest id the one with the smallest hash of its text, then of the whole row."""
    state = stored(jaccard_join(docs, text, key, name).where("root is not null"), name + "/state")
    best = state.where("kept").groupBy("root").agg(F.min("text_hash").alias("best"))
    rows = state.groupBy("root", F.col(key).alias("id"), "text_hash").agg(F.first("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
    marked = stored(rows.join(best, "root").select("id", "text_hash", (F.col("kept") & (F.col("text_hash") == F.col("best"))).alias("stays"), "rows"), name + "/marked")
    same = lambda other: docs[key].eqNullSafe(other["id"]) & (F.xxhash64(docs[text]) == other["text_hash"])
    repeats = marked.where("stays and rows > 1")
    losers = marked.where("not stays or rows > 1")
    out = docs.join(losers, same(losers), "left_anti")
    if repeats.isEmpty():
        return out
    row = F.struct(*[docs[c] for c in docs.columns])
    again = docs.join(repeats, same(repeats), "left_semi").select(row.alias("row"), F.struct(F.xxhash64(row), F.xxhash64(F.lit(1), row)).alias("order"), docs[key].alias("own"), F.xxhash64(docs[text]).alias("hash"))
    return out.union(again.groupBy("own", "hash").agg(F.min_by("row", "order").alias("row")).select("row.*"))
