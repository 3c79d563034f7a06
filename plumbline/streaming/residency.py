"""Camera and control rows in, ordered changes of residency out.

One state a source: its nodes' residency and the last views and budget.  The
same tick rule runs in batch over ordered rows and in a stream; a stream keeps
the state in Structured Streaming's state store, keyed by source, and is
driven by processing time, without watermarks or event-time windows.

Input rows: source_id, tick, views (JSON list of {matrix, position,
pixel_scale, target}), budget_slots, control (JSON object: ``cancel`` list of
ids, ``pin`` list, ``target``, ``policy``, ``hierarchy``; or null).
Output rows: source_id, tick, action (added, removed), id, ord.
"""

from __future__ import annotations

import json
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from plumbline.operators.detail import Residency, View, admit

OUTPUT = "source_id string, tick long, action string, id long, ord int, settled boolean, demand long"


@dataclass(frozen=True)
class Options:
    max_in_flight: int = 4
    concurrency: int = 4
    eviction_delay_ticks: int = 5
    tick_ms: int = 100
    policy: str = "frustumFirstThenHalo"
    target_pixels: float = 256.0
    enforce_hierarchy: bool = True
    pin_to_depth: int = -1


def score(node: dict, view: View) -> float:
    off = [min(max(c, lo), hi) - c for c, lo, hi in zip(view.position, node["low"], node["high"], strict=True)]
    pixels = node["extent"] * view.pixel_scale
    if not view.orthographic:
        pixels /= math.sqrt(sum(v * v for v in off)) + 1e-3
    return 1 / (1 + abs(math.log2(max(pixels / view.target, 1e-12))))


def sees(node: dict, view: View) -> bool:
    m = [view.matrix[4 * r : 4 * r + 4] for r in range(4)]
    planes = [[m[3][k] + s * m[r][k] for k in range(4)] for r in (0, 1) for s in (1, -1)] + [m[2], [m[3][k] - m[2][k] for k in range(4)]]
    return all(sum(p[k] * (node["high"] if p[k] >= 0 else node["low"])[k] for k in range(3)) + p[3] >= 0 for p in planes)


class Source:
    """The state of one source and its tick."""

    def __init__(self) -> None:
        self.residency, self.views, self.budget, self.cache = Residency(), [], 0, None
        self.pinned: list[int] = []
        self.policy = self.target = self.hierarchy = None

    def control(self, row: dict, options: Options) -> None:
        asked = json.loads(row["control"]) if row.get("control") else {}
        for i in asked.get("cancel", []):
            if i in self.residency.held:
                self.residency.held.remove(i)
        if asked:
            self.cache = None
        self.pinned = asked.get("pin", self.pinned)
        self.policy = asked.get("policy", self.policy)
        self.target = asked.get("target", self.target)
        self.hierarchy = asked.get("hierarchy", self.hierarchy)

    def tick(self, row: dict, nodes: dict[int, dict], options: Options) -> list[dict]:
        self.control(row, options)
        views = [View(tuple(map(float, v["matrix"])), tuple(v.get("position", (0, 0, 0))), v.get("pixel_scale", 1.0), self.target or v.get("target", options.target_pixels)) for v in json.loads(row["views"] or "[]")]
        hierarchy = options.enforce_hierarchy if self.hierarchy is None else self.hierarchy
        policy = self.policy or options.policy
        key = (tuple(views), row["budget_slots"])
        if not views:
            self.cache = (key, [], 0)
        elif self.cache is None or self.cache[0] != key:
            scored = {}
            for i, n in nodes.items():
                seen = [v for v in views if policy == "distanceOnly" or sees(n, v)]
                scored[i] = {"points": n["points"], "depth": n["depth"], "visible": bool(seen), "score": max(score(n, v) for v in seen or views)}
            pinned = [*self.pinned, *sorted((i for i, n in nodes.items() if n["depth"] <= options.pin_to_depth), key=lambda i: (nodes[i]["depth"], i))]
            wanted, demand, _ = admit(scored, row["budget_slots"], pinned, hierarchy)
            self.cache = (key, wanted, demand)
        _, wanted, demand = self.cache
        pinned = [*self.pinned, *(i for i, n in nodes.items() if n["depth"] <= options.pin_to_depth)]
        added, removed, settled = self.residency.tick(nodes, wanted, pinned, options.max_in_flight, options.eviction_delay_ticks, hierarchy)
        settled = settled or not views
        out = [("removed", i) for i in removed] + [("added", i) for i in added]
        return [{"source_id": row["source_id"], "tick": row["tick"], "action": a, "id": i, "ord": k, "settled": settled, "demand": demand} for k, (a, i) in enumerate(out)]


def _nodes(rows: list) -> dict[int, dict]:
    return {r["id"]: {"points": r["point_count"], "depth": r["depth"], "extent": r["extent"], "low": [r["minX"], r["minY"], r["minZ"]], "high": [r["maxX"], r["maxY"], r["maxZ"]]} for r in rows}


def residency_batch(ticks: DataFrame, nodes: DataFrame, options: Options = Options()) -> DataFrame:
    """The ticks of each source in order, in one task a source; ``nodes`` is metadata and goes to all tasks."""
    shared = ticks.sparkSession.sparkContext.broadcast(_nodes(nodes.collect()))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        source, out = Source(), []
        for row in pdf.sort_values("tick").to_dict("records"):
            out += source.tick(row, shared.value, options)
        return pd.DataFrame(out, columns=["source_id", "tick", "action", "id", "ord", "settled", "demand"])

    return ticks.groupBy("source_id").applyInPandas(run, OUTPUT)


def residency_stream(ticks: DataFrame, nodes: list, options: Options = Options()) -> DataFrame:
    """The same as a stream: within a micro-batch the latest tick of a source wins, its controls all count."""
    shared = ticks.sparkSession.sparkContext.broadcast(_nodes(nodes))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        source = pickle.loads(state.get[0]) if state.exists else Source()
        rows = [r for pdf in batches for r in pdf.sort_values("tick").to_dict("records")]
        rows.sort(key=lambda r: r["tick"])
        for row in rows[:-1]:
            source.control(row, options)
        out = source.tick(rows[-1], shared.value, options) if rows else []
        state.update((pickle.dumps(source),))
        yield pd.DataFrame(out, columns=["source_id", "tick", "action", "id", "ord", "settled", "demand"])

    return ticks.groupBy("source_id").applyInPandasWithState(run, OUTPUT, "source binary", "append", "NoTimeout")
