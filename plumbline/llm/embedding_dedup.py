"""Near-dedup of embeddings: spherical k-means cells, blocked cosine products.

Vectors are compared only within equal labels.  Equal vectors become one node
with a count first.  Centroids are fitted on a bounded sample of nodes by
spherical k-means; every node has the cell of its nearest centroid.  Two unit
vectors with cosine t or more are at most d = sqrt(2 - 2t) apart, so of two
linked vectors each is within d of the border to the other's cell (that is,
(own - other) . x <= d * |own - other|).  A vector visits those of them that
come after its own cell.  A cell compares its own vectors with each other and
with its guests: no link is lost at borders, and each is found once and counted
for both ends.  Cells are cut into blocks, and pairs of blocks are compared by
matrix products, so a cell of any size is spread over tasks.  Tasks return a
count and one link of a spanning forest for each vector, never pairs.

Only nodes are stored, a row each with the vector as it is given.  The guests
and the copies for pairs of blocks can be many times that, so they are moved in
waves of cells, each about as many rows as there are nodes, whose shuffle files
are removed before the next: more visits take more time, not more disk.

Defined cases: a vector that is null, zero or has null or non-finite
components, or a null label, links with nothing and is its own component; rows
with equal vector and label link with each other, also with equal ids, and a
component's id is its smallest vec_id; a null id has its own result row; an
empty table gives an empty one; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import components, shuffles_removed, stored, stored_parts

COSINE = 0.98
#: Rows of a block of a cell's own vectors; blocks of guests have ``GUESTS`` times as many.
BLOCK, GUESTS = 8192, 4
#: Rows that a wave moves at least; it moves about as many as there are nodes, where these are more.
WAVE = 1 << 20
#: Rows of the k-means sample at least, wanted rows of a cell, sampled rows a cell, rounds.
SAMPLE, CELL, SAMPLE_OF_CELL, ROUNDS = 20_000, 2000, 4, 8
#: Products of vectors and centroids that a task holds at a time.
PRODUCTS = 4 << 20


def dense(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column end to end, and len+1 offsets into them."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of doubles from binaries of equal length."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.float64).reshape(len(column), -1)


def usable(df: DataFrame, vector: str) -> F.Column:
    v = F.col(vector)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))


def unit_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the last column, an array of doubles, by a binary of the vector scaled to length one."""
    for batch in batches:
        flat, offsets = dense(batch.columns[-1])
        if batch.num_rows:
            of = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            flat = flat / np.maximum.reduceat(np.abs(flat), offsets[:-1])[of]
            flat = flat / np.sqrt(np.add.reduceat(flat * flat, offsets[:-1]))[of]
        raw = pa.BinaryArray.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((offsets * 8).astype(np.int32)), pa.py_buffer(flat)])
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], raw], batch.schema.names)


def centroids(sample: np.ndarray, k: int, seed: int = 3) -> np.ndarray:
    """Spherical k-means; an empty cell takes a random vector."""
    rng = np.random.default_rng(seed)
    k = min(k, len(sample))
    c = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(ROUNDS if k > 1 else 0):
        own = (sample @ c.T).argmax(1)
        c = np.zeros_like(c)
        np.add.at(c, own, sample)
        norms = np.linalg.norm(c, axis=1)
        c[norms == 0] = sample[rng.choice(len(sample), int((norms == 0).sum()))]
        c /= np.linalg.norm(c, axis=1)[:, None]
    return c


def raw_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the last column, an array of floats or doubles, by a binary of the same bytes."""
    for batch in batches:
        column = batch.columns[-1]
        flat = np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False))
        offsets = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]) * flat.itemsize
        raw = pa.BinaryArray.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat)])
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], raw], batch.schema.names)


def units(raws: list[bytes], kind: type) -> np.ndarray:
    """Rows of doubles scaled to length one, from vectors' bytes, all of one size."""
    x = np.frombuffer(b"".join(raws), kind).reshape(len(raws), -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fit_cells(valid: DataFrame, kind: type) -> np.ndarray:
    """Centroids for the largest label's number of nodes, from a sample of unit vectors.

    Cells have about ``CELL`` nodes of that label; from ``CELL`` squared nodes
    on there are as many cells as a cell has nodes, the square root, so neither
    the centroids, which all tasks get, nor the sample grow faster than that.
    """
    sizes = valid.groupBy("label", F.size("vec").alias("n")).agg(F.approx_count_distinct("node").alias("count")).agg(F.sum("count"), F.max("count")).first()
    total, most = int(sizes[0] or 0), int(sizes[1] or 0)
    if not total:
        return np.zeros((0, 0))
    cells = max(1, min(most // CELL, int(most**0.5)))
    part = int(min(1.0, max(SAMPLE, SAMPLE_OF_CELL * cells) / total) * (1 << 30))
    picked = valid.where(F.pmod(F.xxhash64(F.lit(11), F.col("node")), F.lit(1 << 30)) < part).select("node", "vec").dropDuplicates(["node"])
    by_size: dict[int, list] = {}
    for r in sorted(picked.mapInArrow(raw_vectors, "node bigint, vec binary").collect()):
        by_size.setdefault(len(r.vec), []).append(bytes(r.vec))
    if not by_size:
        return np.zeros((0, 0))
    return centroids(units(max(by_size.values(), key=len), kind), cells)


def visits(raws: list[bytes], own: np.ndarray, c: np.ndarray, kind: type, reach: float, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of the cells after its own, among the ``wanted`` ones, that each vector has to visit."""
    cells = np.arange(len(c)) if wanted is None else wanted
    rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    every = np.flatnonzero((own >= 0) & (own < (cells.max() if len(cells) else -1)))
    step = max(1, PRODUCTS // max(len(cells), 1))
    for a in range(0, len(every), step):
        at = every[a : a + step]
        x, mine = units([raws[i] for i in at.tolist()], kind), c[own[at]]
        gap = np.sqrt(np.maximum(0, 2 - 2 * (mine @ c[cells].T)))
        visit = ((x * mine).sum(1)[:, None] - x @ c[cells].T <= reach * gap + 1e-12) & (cells[None, :] > own[at][:, None])
        i, j = np.nonzero(visit)
        rows.append(at[i])
        found.append(cells[j])
    return np.concatenate(rows), np.concatenate(found)


def waves(moved: dict[int, int], limit: int) -> list[tuple[list[int], int]]:
    """(cells, parts): cells that together move about ``limit`` rows, or one that moves more, whose pairs of blocks are dealt to so many parts."""
    out: list[tuple[list[int], int]] = []
    size = limit
    for cell, rows in sorted(moved.items()):
        if rows > limit or size + rows > limit:
            out.append(([], max(1, -(-rows // limit))))
            size = 0
        out[-1][0].append(cell)
        size += rows
    return out


def embedding_dedup(vectors: DataFrame, vector: str = "embedding", label: str = "label", key: str = "vec_id", cosine: float = COSINE, name: str = "embedding_dedup") -> DataFrame:
    """Per row: ``key``, ``n_links``, ``component_id``, ``kept``."""
    single = vectors.schema[vector].dataType.simpleString() == "array<float>"
    kind = np.float32 if single else np.float64
    v = F.col(vector) if single else F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), v.alias("vec"))
    able = usable(rows, "vec") & F.col("label").isNotNull()
    rows = rows.withColumn("node", F.when(able, F.xxhash64("label", "vec")))
    valid = rows.where("node is not null")
    shared = vectors.sparkSession.sparkContext.broadcast(fit_cells(valid, kind))
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-9

    def owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in raw_vectors(batches):
            raws = batch.columns[-1].to_pylist()
            own = np.full(len(raws), -1, np.int32)  # vectors of another size than the centroids
            like = np.flatnonzero([len(x) == c.shape[1] * np.dtype(kind).itemsize for x in raws])
            step = max(1, PRODUCTS // max(len(c), 1))
            for a in range(0, len(like), step):
                at = like[a : a + step]
                own[at] = (units([raws[i] for i in at.tolist()], kind) @ c.T).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], [*batch.schema.names, "cell"])

    with shuffles_removed(vectors.sparkSession):
        grouped = valid.groupBy("node").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("vec").alias("vec"))
        of, id_kind = (grouped.schema[x].dataType.simpleString() for x in ("label", "first"))
        grouped = grouped.select("node", "first", "copies", "label", "vec")
        nodes = stored(grouped.mapInArrow(owned, f"node bigint, first {id_kind}, copies bigint, label {of}, vec binary, cell int"), name + "/nodes")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(2).to_numpy()
            i, cell = visits(batch.column(1).to_pylist(), own, shared.value, kind, reach)
            take = pa.array(np.concatenate([np.arange(len(own)), i]))
            here = pa.table({"label": batch.column(0).take(take), "cell": pa.array(np.concatenate([own, cell]), pa.int32()), "own": pa.array(np.arange(len(take)) < len(own))})
            here = here.group_by(["label", "cell", "own"]).aggregate([([], "count_all")]).select(["label", "cell", "own", "count_all"])
            yield from here.rename_columns(["label", "cell", "own", "n"]).combine_chunks().to_batches()

    counts = nodes.select("label", "vec", "cell").mapInArrow(counted, f"label {of}, cell int, own boolean, n bigint")
    total = lambda mine: F.coalesce(F.sum(F.when(F.col("own") == mine, F.col("n"))), F.lit(0))
    counts = counts.groupBy("label", "cell").agg(total(True).alias("mine"), total(False).alias("guests"))
    blocks = lambda n, size: F.ceil(F.col(n) / size).cast("int")
    counts = counts.where("mine > 0").withColumns({"__own": blocks("mine", BLOCK), "__guest": blocks("guests", GUESTS * BLOCK)})
    counts = stored(counts.select(F.col("label").alias("__label"), F.col("cell").alias("__cell"), "mine", "guests", "__own", "__guest"), name + "/counts")
    each = F.col("mine") * (F.col("__own") + F.col("__guest")) + F.col("guests") * F.col("__own")
    moved = {r.cell: int(r.n) for r in counts.groupBy(F.col("__cell").alias("cell")).agg(F.sum(each).alias("n")).toLocalIterator()}
    many = counts.where("__own > 1 or __guest > 0").select("__label", "__cell", "__own", "__guest")

    def placed(cells: list[int]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted = np.array([x for x in cells if x >= 0], np.int64)
            for batch in batches:
                own, raws = batch.column(4).to_numpy(), batch.column(3).to_pylist()
                here = np.flatnonzero(np.isin(own, cells))
                i, cell = visits(raws, own, shared.value, kind, reach, wanted)
                take = pa.array(np.concatenate([here, i]))
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(take) for k in range(4)], pa.array(np.concatenate([own[here], cell]), pa.int32()), pa.array(np.arange(len(take)) < len(here))], ["node", "copies", "label", "vec", "cell", "own"])

        return run

    def compared(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        out_node, out_n, out_root = [], [], []
        raws = table["vec"].to_pylist()
        sizes = np.array([len(x) for x in raws])
        node, copies, left = (table[c].to_numpy() for c in ("node", "copies", "left"))
        for size in np.unique(sizes):
            mine = sizes == size
            same = bool(key[2].as_py() == key[3].as_py() and not key[4].as_py())  # one block with itself
            l, r = np.flatnonzero(mine & left), np.flatnonzero(mine & (same | ~left))  # noqa: E741
            if not len(l) or not len(r):
                continue
            x, y = units([raws[i] for i in l.tolist()], kind), units([raws[i] for i in r.tolist()], kind)
            count = np.zeros(len(node), np.int64)
            edges, held = [np.zeros((2, 0), np.int64)], 0
            step = max(1, (PRODUCTS >> 2) // len(r))
            for a in range(0, len(l), step):
                hit = x[a : a + step] @ y.T >= cosine
                if same:
                    hit[np.arange(len(hit)), a + np.arange(len(hit))] = False
                i, j = np.nonzero(hit)
                np.add.at(count, l[i + a], copies[r[j]])
                if not same:
                    np.add.at(count, r[j], copies[l[i + a]])
                edges.append(np.array([l[i + a], r[j]]))
                held += len(i)
                if held > 4_000_000:
                    edges, held = [_tree(np.concatenate(edges, 1))], 0
            pairs = _tree(np.concatenate(edges, 1))
            root = np.arange(len(node))
            root[pairs[0]] = pairs[1]
            some = (count > 0) | (root != np.arange(len(node)))
            out_node.append(node[some])
            out_n.append(count[some])
            out_root.append(node[root[some]])
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.table({"node": join(out_node), "n": join(out_n), "root": join(out_root)})

    limit = max(WAVE, int(counts.agg(F.sum("mine")).first()[0] or 0))

    def compared_waves() -> Iterator[DataFrame]:
        for cells, parts in waves(moved, limit) or [([], 1)]:
            for part in range(parts):
                with shuffles_removed(vectors.sparkSession):
                    here = nodes.select("node", "copies", "label", "vec", "cell").mapInArrow(placed(cells), f"node bigint, copies bigint, label {of}, vec binary, cell int, own boolean")
                    here = here.join(many.where(F.col("__cell").isin(cells)), F.col("label").eqNullSafe(F.col("__label")) & (F.col("cell") == F.col("__cell")), "left")
                    pairs = paired(here).where(F.pmod(F.xxhash64("label", "cell", "block", "other", "guest"), F.lit(parts)) == part)
                    yield pairs.groupBy("label", "cell", "block", "other", "guest").applyInArrow(compared, "node bigint, n bigint, root bigint")

    found = stored_parts(compared_waves(), name + "/links")
    linked = found.groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), name)
    info = nodes.select("node", "first", "copies").join(linked, "node", "left").join(roots, "node", "left")
    info = stored(info.select("node", "first", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")), name + "/info")
    least = info.groupBy("root").agg(F.min("first").alias("component"))
    each = info.join(least, "root").select(F.col("node").alias("at"), "n_links", "component")
    joined = rows.select("id", "node").join(each, F.col("node") == F.col("at"), "left")
    component = F.coalesce("component", "id")
    return joined.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def paired(rows: DataFrame) -> DataFrame:
    """``rows`` of cells with (block, other, guest, left): a cell's own rows meet each other and its guests in one pair of blocks each; guests don't meet."""
    own, guest = F.coalesce("__own", F.lit(1)), F.coalesce("__guest", F.lit(0))
    mine = F.pmod(F.xxhash64(F.lit(5), F.col("node")), F.when(F.col("own"), own).otherwise(F.greatest(guest, F.lit(1)))).cast("int")
    upto = lambda n: F.slice(F.sequence(F.lit(0), F.greatest(n, F.lit(1))), F.lit(1), n)  # noqa: E731  0 to n-1, none for 0
    pair = lambda a, b, g, left: F.struct(a.alias("block"), b.alias("other"), F.lit(g).alias("guest"), left.alias("left"))
    others = F.transform(upto(own), lambda k: pair(F.least("__mine", k), F.greatest("__mine", k), False, F.col("__mine") <= k))
    hosts = F.transform(upto(guest), lambda k: pair(F.col("__mine"), k, True, F.lit(True)))
    hosted = F.transform(F.when(guest > 0, upto(own)).otherwise(F.array().cast("array<int>")), lambda k: pair(k, F.col("__mine"), True, F.lit(False)))
    every = rows.withColumn("__mine", mine).withColumn("__to", F.explode(F.when(F.col("own"), F.concat(others, hosts)).otherwise(hosted)))
    return every.select("node", "copies", "label", "vec", "cell", "__to.*")


def _tree(edges: np.ndarray) -> np.ndarray:
    """As connected as ``edges``, with each node once at most on the left."""
    if not edges.shape[1]:
        return edges
    nodes, ends = np.unique(edges, return_inverse=True)
    left, right = ends.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return np.array([nodes[moved], nodes[label[moved]]])


#: Walks the links from each vector; vectors of the tables have length one, so sums of products are cosines.
ORACLE = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
n AS (SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM e),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_dot_product(a.v, b.v) / (a.size * b.size) >= 0.98),
r(a, b) AS (SELECT vec_id, vec_id FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c
"""
