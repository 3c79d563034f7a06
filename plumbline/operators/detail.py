"""Levels of detail of an octree, and which of its nodes a view wants."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import bits
from plumbline.functions.geometry import XYZ
from plumbline.operators.filters import frustum_boxes
from plumbline.operators.order import PID, ordinal, with_one
from plumbline.operators.transforms import with_morton

#: Points of a batch, bytes of a packed point and of each further dimension.
BATCH, POINT_BYTES, DIMENSION_BYTES = 10_240, 17, 4


def lod_levels(df: DataFrame, levels: int = 4, divisions: int = 64) -> DataFrame:
    """``level``: 0 for the first point, in Z order, of each of the coarsest voxels, and so on; the rest gets the last level.

    A level's voxel has the longest extent by ``divisions``, halved for each level before.
    """
    levels = max(1, min(8, levels))
    box = df.agg(*[f(d).alias(f"__{n}{d}") for d in XYZ for n, f in (("a", F.min), ("b", F.max))])
    keyed = with_one(with_morton(df), box)
    longest = F.greatest(*[F.col(f"__b{d}") - F.col(f"__a{d}") for d in XYZ], F.lit(1e-6))
    out = keyed.withColumn("level", F.lit(levels - 1))
    for level in range(levels - 1):
        size = longest / divisions * (0.5**level)
        voxel = [F.floor((F.col(d) - F.col(f"__a{d}")) / size) for d in XYZ]
        free = F.col("level") == levels - 1
        w = Window.partitionBy(*[F.when(free, v) for v in voxel], F.when(~free, F.col(PID)), free).orderBy("morton", PID)
        out = out.withColumn("level", F.when(free & (F.row_number().over(w) == 1), level).otherwise(F.col("level")))
    return out.drop(*[f"__{n}{d}" for d in XYZ for n in "ab"])


def batched(df: DataFrame, size: int = BATCH) -> DataFrame:
    """``batch`` and ``ord``: runs of points in Z order, each sorted by level."""
    placed = ordinal(df, "morton", PID, name="__rn").withColumn("batch", F.floor(F.col("__rn") / size).cast("long"))
    w = Window.partitionBy("batch").orderBy("level", "__rn")
    return placed.withColumn("ord", F.row_number().over(w) - 1).drop("__rn")


def batch_table(df: DataFrame, levels: int = 8) -> DataFrame:
    """Per batch: bounds, points, and how many have at most each level."""
    box = [f(d).alias(f"{n}{d.lower()}") for n, f in (("min", F.min), ("max", F.max)) for d in XYZ]
    counts = F.array(*[F.count_if(F.col("level") <= k).cast("int") for k in range(levels)])
    return df.groupBy("batch").agg(*box, F.count(F.lit(1)).alias("num_points"), counts.alias("cum"))


def packed(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Positions within their batch's box in 30 bits an axis, as words ``low`` (the top ten bits of each), ``med``, ``high``."""
    w = Window.partitionBy("batch")
    q = tuple(bits.fixed30(F.col(d), F.min(d).over(w), F.max(d).over(w) - F.min(d).over(w)) for d in XYZ)
    keep = [c for c in ("rgba",) if c in df.columns]
    placed = df.withColumns({f"__q{d}": v for d, v in zip(XYZ, q, strict=True)})
    q = tuple(F.col(f"__q{d}") for d in XYZ)
    return placed.select(PID, "batch", "ord", "level", bits.word(q, 20).alias("low"), bits.word(q, 10).alias("med"), bits.word(q, 0).alias("high"), *keep, *[F.col(c).cast("float").alias(c) for c in extra])


def unpacked(df: DataFrame, batches: DataFrame) -> DataFrame:
    """Positions back from the words and the batches' bounds."""
    joined = df.join(batches.select("batch", *[f"{n}{d.lower()}" for n in ("min", "max") for d in XYZ]), "batch")
    for k, d in enumerate(XYZ):
        ten = lambda c: F.shiftright(F.col(c), 10 * k).bitwiseAND(F.lit(1023))  # noqa: B023, E731
        q = F.shiftleft(ten("low"), 20).bitwiseOR(F.shiftleft(ten("med"), 10)).bitwiseOR(ten("high"))
        size = F.greatest(F.col(f"max{d.lower()}") - F.col(f"min{d.lower()}"), F.lit(1e-6))
        joined = joined.withColumn(d, q / F.lit(float((1 << 30) - 1)) * size + F.col(f"min{d.lower()}"))
    return joined


def octree(df: DataFrame, depth: int = 6) -> DataFrame:
    """``level`` and the node (ox, oy, oz) of each point: the first point in input order of each of 64 parts an axis of a node stays there, the others go deeper."""
    box = df.agg(*[f(d).alias(f"__{n}{d}") for d in XYZ for n, f in (("a", F.min), ("b", F.max))])
    out = with_one(df, box)
    side = F.greatest(*[F.col(f"__b{d}") - F.col(f"__a{d}") for d in XYZ], F.lit(1e-6)) * 1.000001
    out = out.withColumn("level", F.lit(depth))
    for k in range(depth):
        cell = side / (64 * 2**k)
        voxel = [F.floor((F.col(d) - F.col(f"__a{d}")) / cell) for d in XYZ]
        free = F.col("level") == depth
        w = Window.partitionBy(*[F.when(free, v) for v in voxel], F.when(~free, F.col(PID))).orderBy(PID)
        out = out.withColumn("level", F.when(free & (F.row_number().over(w) == 1), k).otherwise(F.col("level")))
    width = side / F.pow(F.lit(2.0), F.col("level"))
    return out.withColumns({f"o{d.lower()}": F.floor((F.col(d) - F.col(f"__a{d}")) / width).cast("int") for d in XYZ}).drop(*[f"__{n}{d}" for d in XYZ for n in "ab"])


def node_table(df: DataFrame) -> DataFrame:
    """A row a node: id, depth, x, y, z, bounds, extent, point_count."""
    box = [f(d).alias(f"{n}{d}") for n, f in (("min", F.min), ("max", F.max)) for d in XYZ]
    rows = df.groupBy(F.col("level").alias("depth"), F.col("ox").alias("x"), F.col("oy").alias("y"), F.col("oz").alias("z")).agg(*box, F.count(F.lit(1)).alias("point_count"))
    extent = F.greatest(*[F.col(f"max{d}") - F.col(f"min{d}") for d in XYZ])
    return rows.withColumns({"id": bits.node_id(F.col("depth"), F.col("x"), F.col("y"), F.col("z")), "extent": extent})


def level_for(spacing: float, resolution: float) -> int:
    """The first level with spacing at most the resolution."""
    import math

    return max(0, math.ceil(math.log2(spacing / resolution)))


def slots(points: Column) -> Column:
    return F.ceil(points / F.lit(float(BATCH))).cast("long")


def budget_slots(budget_bytes: int, extra_dims: int = 0) -> int:
    return max(1, budget_bytes // (BATCH * (POINT_BYTES + DIMENSION_BYTES * extra_dims)))


def backlog_bytes(budget_bytes: int) -> int:
    """Bytes not yet taken by the consumer at which loading stops."""
    return min(max(budget_bytes // 4, 64 << 20), 512 << 20)


def depth_histogram(nodes: DataFrame) -> DataFrame:
    """(depth, nodes, slots) with running sums ``nodes_to`` and ``slots_to``."""
    rows = nodes.groupBy("depth").agg(F.count(F.lit(1)).alias("nodes"), F.sum(slots(F.col("point_count"))).alias("slots"))
    w = Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)  # a row a depth
    return rows.withColumns({"nodes_to": F.sum("nodes").over(w), "slots_to": F.sum("slots").over(w)})


def sum_to_depth(sums: Sequence[int] | None, depth: int) -> int | None:
    """A running sum at a depth: 0 before the first, the total past the last, None where nothing is published."""
    if sums is None or not len(sums):
        return None
    return 0 if depth < 0 else sums[min(depth, len(sums) - 1)]


def size_histogram(nodes: DataFrame) -> DataFrame:
    """(bucket, nodes, cumulative percent, share of points by the buckets' middles) by powers of two of the points, as many as there are."""
    bucket = F.length(F.bin(F.greatest("point_count", F.lit(1)))) - 1
    rows = nodes.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("nodes"))
    w = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    middle = F.col("nodes") * F.pow(F.lit(2.0), F.col("bucket")) * 1.5
    return rows.select("bucket", "nodes", (F.sum("nodes").over(w) * 100.0 / F.sum("nodes").over(every)).alias("cumulative"), (middle * 100.0 / F.sum(middle).over(every)).alias("point_share"))


# --- views ------------------------------------------------------------------


@dataclass(frozen=True)
class View:
    """A camera: row-major matrix, position, pixels that one unit takes at distance one, wanted pixels of a chunk."""

    matrix: tuple
    position: tuple = (0.0, 0.0, 0.0)
    pixel_scale: float = 1.0
    target: float = 256.0

    @property
    def orthographic(self) -> bool:
        return all(abs(v - w) < 1e-6 for v, w in zip(self.matrix[12:], (0, 0, 0, 1), strict=True))


def view_score(view: View) -> Column:
    """How near a node's size on the screen is to the target: 1 at best."""
    off = []
    for d, c in zip(XYZ, view.position, strict=True):
        middle = F.least(F.greatest(F.lit(float(c)), F.col(f"min{d}")), F.col(f"max{d}"))
        off.append((middle - float(c)) * (middle - float(c)))
    distance = F.sqrt(off[0] + off[1] + off[2])
    pixels = F.col("extent") * view.pixel_scale
    if not view.orthographic:
        pixels = pixels / (distance + 1e-3)
    ratio = F.greatest(pixels / view.target, F.lit(1e-12))
    return 1 / (1 + F.abs(F.log2(ratio)))


def candidates(nodes: DataFrame, views: Sequence[View], policy: str = "frustumFirstThenHalo") -> DataFrame:
    """``nodes`` with ``score`` and ``visible``: the best score over the views that see a node, or over all for hidden ones; with ``distanceOnly`` all are visible."""
    seen = [F.lit(True) if policy == "distanceOnly" else frustum_boxes(v.matrix) for v in views]
    scores = [view_score(v) for v in views]
    most = lambda cs: cs[0] if len(cs) == 1 else F.greatest(*cs)
    by_sight = most([F.when(s, v) for s, v in zip(seen, scores, strict=True)])
    return nodes.withColumns({"visible": by_sight.isNotNull(), "score": F.coalesce(by_sight, most(scores))})


def demand(scored: DataFrame) -> DataFrame:
    return scored.where("visible").agg(F.coalesce(F.sum(slots(F.col("point_count"))), F.lit(0)).alias("demand"))


def parents(nodes: DataFrame, resident: DataFrame) -> DataFrame:
    """Nodes whose parent is among the resident, and roots."""
    keyed = nodes.withColumn("parent", bits.parent_id(F.col("id")))
    held = keyed.join(resident.select(F.col("id").alias("parent")), "parent", "left_semi")
    return held.unionByName(keyed.where("parent is null")).drop("parent")


def distance_level(distance: Column) -> Column:
    """Coarser with distance: up to 10 level 10, up to 50 level 7, up to 100 level 5, up to 500 level 3, else 0."""
    return F.when(distance <= 10, 10).when(distance <= 50, 7).when(distance <= 100, 5).when(distance <= 500, 3).otherwise(0)


def cells_at(df: DataFrame, level: int, size: float) -> DataFrame:
    """(cx, cy, cz, n): cells of ``size`` halved ``level`` times."""
    side = size / 2**level
    return df.groupBy(*[F.floor(F.col(d) / side).cast("long").alias(f"c{d.lower()}") for d in XYZ]).agg(F.count(F.lit(1)).alias("n"))


def without_ancestors(chosen: DataFrame) -> DataFrame:
    """Nodes of which no descendant is chosen too."""
    ids = chosen.select("id")
    up = ids
    found = None
    for _ in range(20):
        up = up.select(bits.parent_id(F.col("id")).alias("id")).where("id is not null").distinct()
        found = up if found is None else found.union(up)
    return chosen.join(found.distinct(), "id", "left_anti")


# --- rules of a tick, on metadata ---------------------------------------------


def id_parts(node: int) -> tuple[int, int, int, int]:
    node &= (1 << 64) - 1
    m = (1 << 19) - 1
    return node >> 57, node >> 38 & m, node >> 19 & m, node & m


def parent_of(node: int) -> int | None:
    d, x, y, z = id_parts(node)
    if not d:
        return None
    value = (d - 1) << 57 | (x >> 1) << 38 | (y >> 1) << 19 | z >> 1
    return value - (1 << 64) if value >> 63 else value


def node_slots(points: int) -> int:
    return -(-points // BATCH)


def admit(nodes: dict[int, dict], budget: int, pinned: Sequence[int] = (), hierarchy: bool = True) -> tuple[list[int], int, bool]:
    """(wanted ids in order, demand, whether the budget left visible nodes out).

    ``nodes``: id to {points, depth, score, visible}.  All nodes are wanted,
    coarse first, if they fit.  Else the pinned come first and are always
    wanted; then visible ones by score, each after its missing ancestors from
    the root down until the budget breaks (what was taken stays); then hidden ones.
    """
    cost = {i: node_slots(n["points"]) for i, n in nodes.items()}
    asked = sum(cost[i] for i, n in nodes.items() if n["visible"])
    if sum(cost.values()) <= budget:
        return sorted(nodes, key=lambda i: (nodes[i]["depth"], i)), asked, False
    wanted: dict[int, None] = {}
    left = budget
    for i in pinned:
        if i in nodes and i not in wanted:
            wanted[i] = None
            left -= cost[i]

    def take(order: list[int]) -> None:
        nonlocal left
        for i in order:
            if i in wanted:
                continue
            chain, up = [i], parent_of(i)
            while hierarchy and up is not None:
                if up in nodes and up not in wanted:
                    chain.append(up)
                up = parent_of(up)
            for j in reversed(chain):
                if cost[j] > left:
                    break
                wanted[j] = None
                left -= cost[j]

    by_score = lambda seen: sorted((i for i, n in nodes.items() if n["visible"] == seen), key=lambda i: (-nodes[i]["score"], i))
    take(by_score(True))
    limited = any(n["visible"] and i not in wanted for i, n in nodes.items())
    if left > 0:
        take(by_score(False))
    return list(wanted), asked, limited


def prefetch_clusters(items: Sequence[tuple[int, int, int]], remote: bool = False, priority: dict[int, int] | None = None, max_nodes: int = 8, max_bytes: int = 16 << 20, gap: int | None = None) -> list[list[int]]:
    """Groups of (id, offset, size) to read at once: neighbours in the file with small gaps, few nodes and bytes.

    Groups come by their best member's priority (by default the given order), members by their own.
    """
    gap = gap if gap is not None else (1 << 20 if remote else 256 << 10)
    priority = priority or {i: k for k, (i, _, _) in enumerate(items)}
    groups: list[list[tuple[int, int, int]]] = []
    for item in sorted(items, key=lambda t: (t[1], t[0])):
        _, offset, size = item
        if groups:
            own = groups[-1]
            begin, end = own[0][1], max(o + s for _, o, s in own)
            if offset - end <= gap and len(own) < max_nodes and max(end, offset + size) - begin <= max_bytes:
                own.append(item)
                continue
        groups.append([item])
    ordered = [sorted((i for i, _, _ in g), key=lambda i: priority[i]) for g in groups]
    return sorted(ordered, key=lambda g: priority[g[0]])


@dataclass
class Residency:
    """What a source has resident, and since when it's not wanted."""

    resident: dict[int, int] = field(default_factory=dict)  # id -> ticks since it was wanted
    held: list[int] = field(default_factory=list)  # decoded, waiting for a parent
    undrained: list[tuple[str, int]] = field(default_factory=list)
    chunks: int = 0  # decoded so far
    points: int = 0

    def undrained_bytes(self, nodes: dict[int, dict], extra_dims: int = 0) -> int:
        return sum(nodes[i]["points"] for action, i in self.undrained if action == "added") * (POINT_BYTES + DIMENSION_BYTES * extra_dims)

    def stats(self, wanted: Sequence[int]) -> dict:
        """Chunks still to load and waiting for a parent, and what was decoded so far."""
        return {"pending": sum(i not in self.resident and i not in self.held for i in wanted), "in_flight": len(self.held), "chunks": self.chunks, "points": self.points}

    def tick(self, nodes: dict[int, dict], wanted: Sequence[int], pinned: Sequence[int] = (), max_in_flight: int = 4, delay: int = 5, hierarchy: bool = True, backlog: int | None = None) -> tuple[list[int], list[int], bool]:
        """(added, removed, settled) of a tick: evictions leaf first, then loads, published after their parents.

        Nothing is loaded while ``backlog`` bytes or more weren't drained.
        """
        want = set(wanted)
        for i in self.resident:
            self.resident[i] = 0 if i in want or i in pinned else self.resident[i] + 1
        removed = []
        for i in sorted(self.resident, key=lambda i: (-nodes[i]["depth"], i)):
            if self.resident[i] >= delay and i not in pinned:
                if hierarchy and any(parent_of(j) == i for j in self.resident if j not in removed):
                    continue
                removed.append(i)
        for i in removed:
            del self.resident[i]
        self.held = [i for i in self.held if i in want]
        loads = [i for i in wanted if i not in self.resident and i not in self.held]
        free = [i for i in loads if node_slots(nodes[i]["points"]) == 0]
        if backlog is not None and self.undrained_bytes(nodes) >= backlog:
            max_in_flight = 0
        taken = free + [i for i in loads if i not in free][:max_in_flight]
        self.held += taken
        self.chunks += len(taken)
        self.points += sum(nodes[i]["points"] for i in taken)
        added: list[int] = []
        moved = True
        while moved:
            moved = False
            for i in sorted(self.held, key=lambda i: (nodes[i]["depth"], i)):
                up = parent_of(i)
                if not hierarchy or up is None or up not in nodes or up in self.resident:
                    self.held.remove(i)
                    self.resident[i] = 0
                    added.append(i)
                    moved = True
        added.sort(key=lambda i: (nodes[i]["depth"], i))
        settled = not self.held and all(i in self.resident for i in wanted)
        return added, removed, settled

    def publish(self, added: Sequence[int], removed: Sequence[int]) -> None:
        """Queues a delta; a removal and an addition that wasn't drained yet cancel out."""
        for i in removed:
            if ("added", i) in self.undrained:
                self.undrained.remove(("added", i))
            else:
                self.undrained.append(("removed", i))
        self.undrained += [("added", i) for i in added]

    def drain(self) -> list[tuple[str, int]]:
        out, self.undrained = self.undrained, []
        return out
