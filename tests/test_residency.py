import json

import pytest

from plumbline.operators import detail
from plumbline.streaming.residency import Options, Source, residency_batch, residency_stream

EYE = [1.0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1]
KEY = lambda d, x=0, y=0, z=0: d << 57 | x << 38 | y << 19 | z
#: A chain of four depths and siblings, each of 100 points: (id, depth, extent).
TREE = [(KEY(0), 0, 8.0), (KEY(1), 1, 4.0), (KEY(2), 2, 2.0), (KEY(3), 3, 1.0), (KEY(1, 1), 1, 4.0), (KEY(2, 2), 2, 2.0), (KEY(2, 3), 2, 2.0), (KEY(3, 4), 3, 1.3), (KEY(3, 5), 3, 1.3)]


def nodes(points=100):
    return {i: {"points": points, "depth": d, "extent": e, "low": [0, 0, 0], "high": [e, e, e]} for i, d, e in TREE}


def scored(**visible):
    return {i: {"points": 100, "depth": d, "visible": visible.get("all", True), "score": 1 / e} for i, d, e in TREE}


def row(tick, budget, views=True, control=None):
    view = [{"matrix": EYE, "pixel_scale": 1.0, "target": 1.0}]
    return {"source_id": "s", "tick": tick, "views": json.dumps(view if views else []), "budget_slots": budget, "control": json.dumps(control) if control else None}


def closed(ids):
    return all(detail.parent_of(i) is None or detail.parent_of(i) in ids or detail.parent_of(i) not in dict((n[0], 1) for n in TREE) for i in ids)


@pytest.mark.parametrize("budget", range(1, 10))
def test_admission_is_closed_and_fits(budget):
    wanted, demand, limited = detail.admit(scored(), budget)
    assert len(wanted) <= budget and demand == 9 and limited == (budget < 9)
    assert closed(set(wanted))


def test_leaf_waits_at_small_budget():
    wanted, _, _ = detail.admit(scored(), 2)
    assert wanted == [KEY(0), KEY(1)]


def test_pinned_are_wanted_at_no_budget():
    wanted, _, _ = detail.admit(scored(), 0, pinned=[KEY(0)])
    assert wanted == [KEY(0)]


def test_parents_are_published_first():
    source, seen = Source(), []
    options = Options(max_in_flight=2, policy="distanceOnly")
    for t in range(6):
        for r in source.tick(row(t, 20), nodes(), options):
            assert r["action"] == "added"
            up = detail.parent_of(r["id"])
            assert up is None or up in seen
            seen.append(r["id"])
    assert len(seen) == 9


def test_leaves_go_first_and_late():
    source, options = Source(), Options(max_in_flight=20, policy="distanceOnly", eviction_delay_ticks=3)
    source.tick(row(0, 20), nodes(), options)
    gone, order = [], []
    for t in range(1, 12):
        removed = [r["id"] for r in source.tick(row(t, 20, views=False), nodes(), options) if r["action"] == "removed"]
        gone += removed
        order.append(len(removed))
    assert order[:2] == [0, 0] and len(gone) == 9
    depth = {i: d for i, d, _ in TREE}
    for i in gone:
        assert not any(detail.parent_of(j) == i for j in gone[gone.index(i) + 1 :])
    assert depth[gone[-1]] == 0


def test_settled_and_demand():
    source, options = Source(), Options(max_in_flight=20, policy="distanceOnly")
    out = source.tick(row(0, 20), nodes(), options)
    assert all(r["settled"] and r["demand"] == 9 for r in out)


def test_cancel_and_pin():
    source, options = Source(), Options(max_in_flight=20, policy="distanceOnly")
    out = source.tick(row(0, 0, control={"pin": [KEY(0)]}), nodes(), options)
    assert [r["id"] for r in out] == [KEY(0)]


def test_undrained_pairs_vanish():
    state = detail.Residency()
    state.publish([1, 2], [])
    state.publish([], [1])
    assert state.drain() == [("added", 2)] and state.drain() == []


def test_backlog_and_counters():
    state, wanted = detail.Residency(), [i for i, _, _ in TREE]
    added, _, _ = state.tick(nodes(), wanted, max_in_flight=2)
    state.publish(added, [])
    assert state.stats(wanted) == {"pending": 7, "in_flight": 0, "chunks": 2, "points": 200}
    assert state.tick(nodes(), wanted, backlog=200 * 17)[0] == []
    state.drain()
    assert len(state.tick(nodes(), wanted, backlog=200 * 17)[0]) > 0 and state.chunks == 6


def test_partial_batch_is_a_slot():
    assert detail.node_slots(1) == detail.node_slots(10_240) == 1 and detail.node_slots(10_241) == 2 and detail.node_slots(0) == 0


def node_frame(spark):
    rows = [(i if i < 2**63 else i - 2**64, d, 100, e, *[0.0] * 3, *[e] * 3) for i, d, e in TREE]
    return spark.createDataFrame(rows, "id long, depth int, point_count long, extent double, minX double, minY double, minZ double, maxX double, maxY double, maxZ double")


SCHEMA = "source_id string, tick long, views string, budget_slots int, control string"


def test_stream_equals_batch(spark, tmp_path):
    rows = [tuple(row(t, 4 if t < 5 else 9, views=t < 8).values()) for t in range(16)]
    frame = spark.createDataFrame(rows, SCHEMA)
    batch = sorted(map(tuple, residency_batch(frame, node_frame(spark)).collect()))
    for t, r in enumerate(rows):
        spark.createDataFrame([r], SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in" / f"t={t:02d}"))
    got = []
    for t in range(len(rows)):  # a file a micro-batch, in order
        folder = tmp_path / "feed"
        folder.mkdir(exist_ok=True)
        for f in (tmp_path / "in" / f"t={t:02d}").glob("*.json"):
            f.rename(folder / f"{t:02d}.json")
        q = residency_stream(spark.readStream.schema(SCHEMA).json(str(folder)), node_frame(spark).collect()).writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(lambda df, _: got.extend(map(tuple, df.collect()))).start()
        q.awaitTermination()
        if t == 5:
            break
    assert sorted(got) == [b for b in batch if b[1] <= 5]
