import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import bits
from plumbline.functions import expression as ex
from plumbline.functions import geometry as geo
from plumbline.operators import aggregates as agg
from plumbline.operators import clusters, detail, filters, neighbours, order, sorting, surfaces
from plumbline.operators import transforms as tr
from plumbline.plans import queries
from plumbline.plans.pipeline import Cancelled, CannotInferDriver, ConvertOptions, DriverNotRegistered, Pipeline, PipelineEncodingFailed, PointFrame, Stage, convert
from plumbline.plans.registry import WRITERS
from plumbline.sources import formats
from plumbline.types import packed_layout, schema_summary


def scattered(n):
    """A seeded cloud of n points in a box of side 8."""
    return np.random.default_rng(77).uniform(0, 8, (n, 3))


@pytest.fixture(scope="module")
def cloud(spark):
    p = scattered(1200) + [512.25, -96.5, 17.0]
    rows = [(k + 1, *map(float, v), k % 4) for k, v in enumerate(p)]
    df = spark.createDataFrame(rows, "pid long, X double, Y double, Z double, Classification int")
    df.cache().count()
    return df


def values(df, *columns):
    return [tuple(r) for r in df.orderBy("pid").select(*columns).collect()]


# --- expressions -----------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "test"),
    [
        ("X > 3 && Y < 5 || Z == 1", lambda x, y, z: x > 3 and y < 5 or z == 1),
        ("!(X > 3) && -Y + 2 * Z >= -1", lambda x, y, z: not x > 3 and -y + 2 * z >= -1),
        ("!X > 3", lambda x, y, z: not x > 3),
        ("(X + Y) * 2 - Z / 4 != abs(Y - Z)", lambda x, y, z: (x + y) * 2 - z / 4 != abs(y - z)),
        ("sqrt(X) + floor(Y) <= ceil(Z) + 1", lambda x, y, z: math.sqrt(x) + math.floor(y) <= math.ceil(z) + 1),
    ],
)
def test_conditions(spark, text, test):
    rows = [(k, float(a), b / 2, float(c)) for k, (a, b, c) in enumerate(np.ndindex(6, 6, 4))]
    df = spark.createDataFrame(rows, "pid long, X double, Y double, Z double").where(ex.condition(text))
    assert [r.pid for r in df.orderBy("pid").collect()] == [r[0] for r in rows if test(*r[1:])]


@pytest.mark.parametrize("text", ["X >", "X + 1", "(X > 1", "X > 1 &&", "foo(X) > 1", "X > 1 > 2 && Y", "X $ 1", ""])
def test_bad_conditions(spark, text):
    with pytest.raises(ex.ExpressionError):
        ex.condition(text)


def test_ranges(spark):
    df = spark.createDataFrame([(k, float(k)) for k in range(10)], "pid long, X double")
    keep = lambda t: [r.pid for r in df.where(ex.ranges(t)).orderBy("pid").collect()]
    assert keep("X[2:4)") == [2, 3]
    assert keep("X(2:4]") == [3, 4]
    assert keep("X![2:8]") == [0, 1, 9]
    assert keep("X[:1],X[8:]") == [0, 1, 8, 9]
    assert keep("X!(2:8)") == [0, 1, 2, 8, 9]


def test_assignments_see_earlier_ones(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "pid long, X double, Y double")
    assert values(tr.assign(df, ["X = X + 1", "Y = X * 10 WHERE X > 5", "New = X"]), "X", "Y", "New") == [(3.0, 3.0, 3.0)]


# --- order -------------------------------------------------------------------------


def test_ordinals_over_buckets(spark):
    df = spark.createDataFrame([(int(v),) for v in np.random.default_rng(0).permutation(500) * 7], "pid long")
    got = {r.pid: r.rn for r in order.ordinal(df, width=100).collect()}
    assert got == {p: k for k, p in enumerate(sorted(got))}
    run = {r.pid: r.s for r in order.running(df, F.col("pid"), "s", width=100).collect()}
    assert run == dict(zip(sorted(run), np.cumsum(sorted(run)).tolist(), strict=True))
    before = {r.pid: r.b for r in order.previous(df, "pid", "b", width=100).collect()}
    assert before == dict(zip(sorted(run), [None, *sorted(run)[:-1]], strict=True))


def test_ordinals_have_no_sort_in_one_task(spark, cloud):
    plan = order.ordinal(cloud)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") == 1  # the buckets' counts


# --- transforms --------------------------------------------------------------------------


@pytest.mark.parametrize(("top", "scale"), [(1.0, 1.0), (200.0, 1 / 255), (60000.0, 1 / 65535)])
def test_soa(spark, top, scale):
    rows = [(k + 1, 1.5 * k, 2.0 * k - 3, 1 - 0.5 * k, k / 9 * top, 0.0, top) for k in range(10)]
    df = tr.soa(spark.createDataFrame(rows, "pid long, X double, Y double, Z double, red double, GREEN double, Blue double"))
    for r, raw in zip(df.orderBy("pid").collect(), rows, strict=True):
        assert r.position == pytest.approx([raw[1] - 6.75, raw[2] - 6, raw[3] + 1.25])
        assert r.color == pytest.approx([raw[4] * scale, 0, top * scale, 1], rel=1e-5)


def test_soa_without_colour(spark, cloud):
    assert tr.soa(cloud).first().color == [1, 1, 1, 1]


def test_inverse_undoes(spark, cloud):
    m = [0.8, -0.6, 0, 5, 0.6, 0.8, 0, -2, 0, 0, 2, 1, 0, 0, 0, 1]
    back = tr.transform(tr.transform(cloud, m), m, invert=True)
    assert np.allclose(values(back, "X", "Y", "Z"), values(cloud, "X", "Y", "Z"))


def test_mercator_and_back(spark):
    df = spark.createDataFrame([(1, 13.4, 52.5)], "pid long, X double, Y double")
    there = tr.reproject(df, "EPSG:4326", "EPSG:3857")
    assert values(there, "X", "Y")[0] == pytest.approx((1491681.18, 6891041.72), rel=1e-6)
    assert values(tr.reproject(there, "EPSG:3857", "EPSG:4326"), "X", "Y")[0] == pytest.approx((13.4, 52.5))


def test_straighten_and_back(spark):
    line = [(0, 0, 0), (10, 0, 0), (20, 10, 5)]
    df = spark.createDataFrame([(1, 3.0, 1.0, 2.0), (2, 15.0, 6.0, 4.0)], "pid long, X double, Y double, Z double")
    flat = tr.straighten(df, line)
    assert values(flat, "X", "Y", "Z")[0] == pytest.approx((3, 1, 2))
    assert np.allclose(values(tr.straighten(flat, line, reverse=True), "X", "Y", "Z"), values(df, "X", "Y", "Z"))


def test_hexagon_rings_close():
    rings = tr.hex_boundary([(0, 0), (1, 0), (5, 5)], 1.0)
    assert sorted(len(r) for r in rings) == [7, 11] and all(r[0] == r[-1] for r in rings)


def test_quantise_overflow(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 1e8, 0.0, 0.0)], "pid long, X double, Y double, Z double")
    with pytest.raises(Exception, match="32 bits"):
        tr.quantised(df, 0.001).collect()


# --- aggregates ---------------------------------------------------------------------------------


def test_one_point_has_no_deviation(spark):
    r = agg.statistics(spark.createDataFrame([(1, 5.0)], "pid long, X double"), ["X"], advanced=True).first()
    assert (r["count"], r.average, r.stddev, r.skewness, r.kurtosis) == (1, 5.0, None, 0.0, 0.0)


def test_statistics_of_metadata():
    found = agg.statistics_of([], {"count": 7, "wkt": "W", "spatialreference": "S", "bounds": {"minx": 0}})
    assert (found["count"], found["srs"], found["bounds"]) == (7, "W", {"minx": 0})
    assert agg.statistics_of([]) == {"count": 0, "srs": None, "bounds": None, "statistics": []}


def test_sidecar(spark, cloud):
    found = json.loads(agg.sidecar_text(agg.stac_properties(cloud, geo.XYZ)))
    assert set(found) == {"pc:type", "pc:encoding", "pc:count", "pc:schemas", "pc:statistics", "srs", "bounds"}
    assert found["pc:count"] == 1200 and all(s["minimum"] <= s["average"] <= s["maximum"] for s in found["pc:statistics"])


def test_chunks(spark, cloud):
    got = list(PointFrame(cloud).chunks(500))
    assert [len(c["points"]) for c in got] == [500, 500, 200]
    assert [c["is_complete"] for c in got] == [False, False, True] and [c["is_first"] for c in got] == [True, False, False]
    assert [c["total_so_far"] for c in got] == [500, 1000, 1200]
    assert [c["is_complete"] for c in PointFrame(cloud).chunks(600)] == [False, True]


def test_chips(spark, cloud):
    same = cloud.limit(300).withColumns({d: F.lit(1.0) for d in geo.XYZ})
    for df, n in ((cloud, 1200), (same, 300)):
        sizes = [r.n for r in agg.chip(df, 100).groupBy("chip").agg(F.count("*").alias("n")).collect()]
        assert max(sizes) <= 100 and sum(sizes) == n and min(sizes) >= 30


def test_wide_record(spark):
    df = spark.range(200).select((F.col("id") + 1).alias("pid"), *[(F.col("id") * k).cast("double").alias(f"D{k}") for k in range(83)])
    assert agg.statistics(df, [f"D{k}" for k in range(83)]).count() == 83


def test_layout(spark):
    df = spark.createDataFrame([], "A byte, X double, B short, C long")
    found = packed_layout(df.schema)
    assert [(f["offset"], f["size"]) for f in found["fields"]] == [(0, 1), (4, 4), (8, 2), (16, 8)] and found["stride"] == 24
    assert schema_summary(df.schema)[1] == {"name": "X", "size": 8, "type": "floating"}


# --- neighbours --------------------------------------------------------------------------------------


def test_grid_search_equals_broadcast(spark, cloud):
    small = cloud.limit(300)
    brute = {(r.a_pid, r["rank"]): (r.b_pid, r.d2) for r in neighbours.nearest(small, small, 5).collect()}
    grid = {(r.a_pid, r["rank"]): (r.b_pid, r.d2) for r in neighbours.nearest(small, small, 5, few=0).collect()}
    assert brute == grid and len(brute) == 1500


def test_fewer_points_than_neighbours(spark, cloud):
    three = cloud.limit(3)
    assert neighbours.nearest(three, three, 5, few=0).count() == 6


def test_radius_join_is_an_equi_join(spark, cloud):
    plan = neighbours.radius_pairs(cloud, cloud, 1.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_poisson_sample(spark, cloud):
    kept = sorting.poisson_sample(cloud, 1.5).select("pid")
    pairs = neighbours.radius_pairs(cloud.join(kept, "pid"), cloud.join(kept, "pid"), 1.5).where("a_pid <> b_pid")
    covered = neighbours.radius_pairs(cloud, cloud.join(kept, "pid"), 1.5).select("a_pid").distinct()
    assert pairs.count() == 0 and covered.count() == 1200


def test_farthest_points(spark, cloud):
    p = np.array(values(cloud, "X", "Y", "Z"))
    d, want, at = np.full(len(p), np.inf), [], 0
    for _ in range(6):
        want.append(at + 1)
        d = np.minimum(d, ((p - p[at]) ** 2).sum(1))
        at = int(d.argmax())
    assert [r.pid for r in sorting.farthest_points(cloud, 6).orderBy("fps").collect()] == want


def test_plane_normals(spark):
    rows = [(k + 1, float(k % 10), float(k // 10), 0.0) for k in range(100)]
    df = spark.createDataFrame(rows, "pid long, X double, Y double, Z double")
    got = neighbours.normals(df, 6).collect()
    assert all(abs(r.NormalZ - 1) < 1e-9 and r.Curvature < 1e-9 for r in got)
    assert all(abs(r.NormalZ - 1) < 1e-9 for r in neighbours.normals(df, 6, refine=True).collect())
    assert {r.Coplanar for r in neighbours.coplanar(df, 9).collect()} == {1}
    assert {r.Rank for r in neighbours.estimate_rank(df, 8).collect()} == {2}
    assert max(r.PlaneFit for r in neighbours.plane_fit(df, 8).collect()) < 1e-9


def test_enclosing_ball():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 4, 12):
        p = rng.normal(size=(n, 3))
        c, r = neighbours.enclosing_ball(p)
        d = np.linalg.norm(p - c, axis=1)
        assert d.max() <= r + 1e-7 and (n == 1 or (d > r - 1e-7).sum() >= 2)


def test_registration(spark, cloud):
    some = cloud.limit(400)
    m = [0.9998, -0.02, 0, 20.2, 0.02, 0.9998, 0, -20.1, 0, 0, 1, 0.05, 0, 0, 0, 1]
    moved = neighbours.register(tr.transform(some.select("pid", *[(F.col(d) - c).alias(d) for d, c in zip(geo.XYZ, (516, -92, 21), strict=True)]), [*m[:3], 0.1, *m[4:7], -0.1, *m[8:]]), some.select("pid", *[(F.col(d) - c).alias(d) for d, c in zip(geo.XYZ, (516, -92, 21), strict=True)]), 30)
    assert moved.first().icp_rmse < 1e-3


# --- clusters ----------------------------------------------------------------------------------------------


def groups(n, edges):
    root = list(range(n))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        root[find(a)] = find(b)
    return [find(k) for k in range(n)]


def test_clusters(spark, cloud):
    p = np.array(values(cloud, "X", "Y", "Z"))
    near = ((p[:, None] - p[None]) ** 2).sum(2) <= 0.6**2
    want = groups(len(p), np.argwhere(near))
    got = [r.ClusterID for r in clusters.euclidean(cloud, 0.6).orderBy("pid").collect()]
    assert len(set(got)) == len(set(want)) == len(set(zip(got, want, strict=True)))


def test_dbscan(spark, cloud):
    p = np.array(values(cloud, "X", "Y", "Z"))
    d = ((p[:, None] - p[None]) ** 2).sum(2)
    core = (d <= 0.8**2).sum(1) >= 4
    got = np.array([r.ClusterID for r in clusters.dbscan(cloud, 4, 0.8).orderBy("pid").collect()])
    border = ((d <= 0.8**2) & core[None]).any(1)
    assert ((got > 0) == border).all()
    want = np.array(groups(len(p), np.argwhere((d <= 0.8**2) & core[:, None] & core[None])))
    assert len(set(zip(got[core], want[core], strict=True))) == len(set(want[core]))


def test_chain_components(spark):
    df = spark.createDataFrame([(k, k + 1) for k in range(1, 200)], "a_pid long, b_pid long")
    assert {r.root for r in clusters.components(df).collect()} == {1}


def test_supervoxels_have_no_tile_borders(spark):
    p = np.random.default_rng(6).random((250, 3))
    df = spark.createDataFrame([(k + 1, *map(float, v)) for k, v in enumerate(p)], "pid long, X double, Y double, Z double")
    got, want = ({r.pid: r.ClusterID for r in clusters.supervoxels(df, 0.2, tile=t).collect()} for t in (0.5, 100.0))
    assert got == want and len(set(want.values())) > 10


# --- surfaces ------------------------------------------------------------------------------------------------


def test_delaunay_circles_are_empty():
    p = np.random.default_rng(2).random((60, 2))
    faces = surfaces.triangles(p)
    hull = len({e for f in faces for e in map(frozenset, ((f[0], f[1]), (f[1], f[2]), (f[2], f[0])))}) * 2 - 3 * len(faces)
    assert len(faces) == 2 * 60 - 2 - hull
    for a, b, c in faces:
        m = np.array([p[b] - p[a], p[c] - p[a]])
        centre = np.linalg.solve(2 * m, (m * m).sum(1))
        r = centre @ centre
        assert (((p - p[a] - centre) ** 2).sum(1) >= r * (1 - 1e-9)).all()


def mesh(faces):
    return sorted((r.a, r.b, r.c) for r in faces.collect())


@pytest.mark.parametrize("kind", ["random", "gap", "grid"])
def test_delaunay_in_tiles_is_the_whole_mesh(spark, kind):
    p = np.random.default_rng(4).random((300, 2)) * 4
    if kind == "gap":
        p = p[np.abs(p[:, 0] - 2) > 1.2]
    if kind == "grid":
        p = np.argwhere(np.ones((9, 9))) / 2.0
    df = spark.createDataFrame([(k, *map(float, v), 0.0) for k, v in enumerate(p)], "pid long, X double, Y double, Z double")
    got = mesh(surfaces.delaunay(df, 0.5))
    assert got == mesh(surfaces.delaunay(df)) and len(got) == len(set(got)) > len(p)


def test_delaunay_rest_in_larger_tiles(spark, monkeypatch):
    monkeypatch.setattr(surfaces, "REST_POINTS", 10)
    p = np.random.default_rng(5).random((200, 2)) * 4
    df = spark.createDataFrame([(k, *map(float, v), 0.0) for k, v in enumerate(p)], "pid long, X double, Y double, Z double")
    assert mesh(surfaces.delaunay(df, 0.5)) == mesh(surfaces.delaunay(df))


def test_ground_filters(spark):
    rows = []
    for x in range(30):
        for y in range(30):
            tower = 12 <= x < 16 and 12 <= y < 16
            rows.append((len(rows) + 1, x + 0.5, y + 0.5, 0.02 * x + (6.0 if tower else 0.0), 1))
    df = spark.createDataFrame(rows, "pid long, X double, Y double, Z double, Classification int")
    for f in (lambda d: surfaces.smrf(d, 1.0, window=8.0), lambda d: surfaces.pmf(d, 1.0, 17), lambda d: surfaces.csf(d, 1.0)):
        got = {r.pid: r.Classification for r in f(df).collect()}
        assert [got[r[0]] for r in rows if r[3] > 5] == [1] * 16
        assert sum(got[r[0]] == 2 for r in rows if r[3] < 5) > 850


def test_carve_by_ray(spark, monkeypatch):
    tetra = {"verts": [[0, 0, 0], [4, 0, 0], [0, 4, 0], [0, 0, 4]], "faces": [[0, 2, 1], [0, 1, 3], [0, 3, 2], [1, 2, 3]]}
    p = np.random.default_rng(3).random((400, 3)) * 4
    df = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(p)], "pid long, X double, Y double, Z double")
    want = [k for k, v in enumerate(p) if v.sum() < 4]
    assert [r.pid for r in surfaces.carve(df, [{**tetra, "op": "intersect"}]).orderBy("pid").collect()] == want
    monkeypatch.setattr(geo, "MOST_TERMS", 2)
    assert [r.pid for r in surfaces.carve(df, [{**tetra, "op": "intersect"}]).orderBy("pid").collect()] == want
    assert surfaces.carve(df, [{**tetra, "op": "anything"}]).count() == 400 - len(want)


def test_raster_fills_holes(spark):
    df = spark.createDataFrame([(1, 0.5, 0.5, 1.0), (2, 2.5, 0.5, 3.0)], "pid long, X double, Y double, Z double")
    got = {(r.i, r.j): r.idw for r in surfaces.raster(df, 1.0, bin_mode=True, window=1).collect()}
    assert got == {(0, 0): 1.0, (2, 0): 3.0, (1, 0): 2.0}


def test_polygon_of_many_corners(spark, cloud, monkeypatch):
    ring = [(516 + 3 * math.cos(k / 50 * math.pi), -92 + 3 * math.sin(k / 50 * math.pi)) for k in range(100)]
    few = values(filters.crop(cloud, polygon=ring), "pid")
    monkeypatch.setattr(geo, "MOST_TERMS", 10)
    assert values(filters.crop(cloud, polygon=ring), "pid") == few and 100 < len(few) < 1200


@pytest.mark.parametrize("share", [0.0, 0.1, 0.25, 0.5, 0.999, 1.0])
def test_refined_quantiles(spark, share):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 7.0).otherwise((F.col("id") * 7919 % 5003) / 10.0).alias("v"))
    want = np.quantile([r.v for r in df.collect()], share)
    assert order.quantiles(df, "v", [share])[0] == pytest.approx(want)
    assert order.quantiles(df, "v", [share], exact_rows=0)[0] == pytest.approx(want)


# --- polygons ---------------------------------------------------------------------------------------------------


def test_polygons():
    a, b, c = [(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (2, 1), (2, 2), (1, 2)], [(9, 9), (10, 9), (10, 10)]
    assert geo.area(a) == 16 and geo.within(b, a) and not geo.within(a, b)
    assert geo.intersects(a, b) and geo.disjoint(a, c)
    assert geo.simplify([(0, 0), (1, 0.01), (2, 0), (2, 2)], 0.1) == [(0, 0), (2, 0), (2, 2)]


# --- levels of detail -----------------------------------------------------------------------------------------------


def test_pack_and_unpack(spark, cloud):
    placed = detail.batched(detail.lod_levels(cloud, 4, 4), 512)
    rows = placed.orderBy("batch", "ord").collect()
    assert sorted(r.pid for r in rows) == list(range(1, 1201))
    assert [sum(r.batch == b for r in rows) for b in range(3)] == [512, 512, 176]
    assert all(a.level <= b.level for a, b in zip(rows, rows[1:]) if a.batch == b.batch)
    table = detail.batch_table(placed, 4)
    assert all(t.cum[-1] == t.num_points for t in table.collect())
    back = detail.unpacked(detail.packed(placed), table)
    assert np.allclose(values(back, "X", "Y", "Z"), values(cloud, "X", "Y", "Z"), atol=1e-3)


def test_levels_are_the_sequential_greedy(spark, cloud):
    rows = tr.with_morton(cloud).orderBy("morton", "pid").collect()
    p = np.array([[r.X, r.Y, r.Z] for r in rows])
    low, longest = p.min(0), (p.max(0) - p.min(0)).max()
    level = np.full(len(p), 3)
    for k in range(3):
        taken = set()
        for n in range(len(p)):
            if level[n] == 3:
                v = tuple(np.floor((p[n] - low) / (longest / 4 * 0.5**k)).astype(int))
                if v not in taken:
                    taken.add(v)
                    level[n] = k
    got = {r.pid: r.level for r in detail.lod_levels(cloud, 4, 4).collect()}
    assert [got[r.pid] for r in rows] == level.tolist()


def test_node_ids(spark):
    deep = spark.createDataFrame([(d, 5, 7, 11) for d in (0, 1, 15, 16, 20)], "d int, x int, y int, z int")
    got = deep.select("d", bits.node_id(*map(F.col, "dxyz")).alias("id")).select("d", "id", bits.parent_id(F.col("id")).alias("up"), *[c.alias(n) for n, c in bits.node_parts(F.col("id")).items()])
    for r in got.collect():
        assert (r.depth, r.x, r.y, r.z) == (r.d, 5, 7, 11)
        assert r.up == detail.parent_of(r.id)
    assert detail.budget_slots(10_240 * 17 * 3 + 5) == 3 and detail.budget_slots(1) == 1
    assert detail.backlog_bytes(1) == 64 << 20 and detail.backlog_bytes(10 << 30) == 512 << 20


def test_prefetch_groups():
    groups = detail.prefetch_clusters([(k, k * 1000, 1000) for k in range(10)], max_nodes=4)
    assert [len(g) for g in groups] == [4, 4, 2]
    assert detail.prefetch_clusters([(1, 0, 10), (2, 10 + (256 << 10), 10), (3, 21 + (512 << 10), 10)]) == [[1, 2], [3]]
    assert detail.prefetch_clusters([(7, 5000, 10), (8, 0, 10), (9, 900_000, 1)], priority={7: 1, 8: 2, 9: 0}) == [[9], [7, 8]]


# --- sources ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("sep", [" ", "\t", ","])
@pytest.mark.parametrize("columns", [3, 6])
@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_text(spark, tmp_path, sep, columns, newline):
    rows = [[f"{0.1 * i:.1f}", f"{0.2 * i:.1f}", f"{0.3 * i:.1f}", "10", "20", "30"][:columns] for i in range(8)]
    path = tmp_path / "a.xyz"
    path.write_bytes(newline.join(["# c", *(sep.join(r) for r in rows)]).encode())
    df = formats.READERS[formats.reader_for(str(path))](spark, str(path))
    assert df.columns[1:] == "X Y Z Red Green Blue".split()[:columns]
    assert values(df, *df.columns[1:]) == [tuple(map(float, r)) for r in rows]


def test_text_headers():
    assert formats.text_layout("a,b,c\n1,2,3\n")["columns"] == ["a", "b", "c"]
    assert formats.text_layout("3\n1 2 3 4 5 6 7\n")["points"] == 3
    assert formats.estimate_points(1000, "12345678\n" * 20) == 111 and formats.estimate_points(1000, "1\n") is None


def test_inference():
    assert formats.reader_for("a/B.COPC.LAZ") == "readers.copc" and formats.reader_for("x.laz") == "readers.las"
    assert formats.writer_for("x.txt") == "writers.text"
    with pytest.raises(CannotInferDriver):
        formats.reader_for("x.unknown")
    assert formats.writer_extras("a.laz", 0.01, {"scale_x": 5})["scale_x"] == 5
    assert formats.writer_extras("a.ply") == {} and "scale_x" not in formats.writer_extras("a.las", None)


@pytest.mark.parametrize("ext", ["las", "ply", "pcd", "parquet"])
def test_write_and_read(spark, cloud, tmp_path, ext):
    df = cloud.withColumn("Intensity", F.col("pid").cast("int"))
    target = str(tmp_path / f"out.{ext}")
    WRITERS[formats.writer_for(target)](df, target)
    back = formats.READERS[formats.reader_for(target)](spark, target)
    got = sorted((r.Intensity, r.X, r.Y, r.Z) for r in back.collect())
    want = sorted((r.Intensity, r.X, r.Y, r.Z) for r in df.collect())
    assert np.allclose(got, want, atol=6e-4)


def test_binary_ply():
    import struct

    head = b"ply\nformat binary_big_endian 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty double z\nproperty uchar red\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    body = struct.pack(">ffdB", 1, 2, 3, 4) + struct.pack(">ffdB", 5, 6, 7, 8) + struct.pack(">Biii", 3, 0, 1, 0)
    columns, faces = formats.decode_ply(head + body)
    assert columns["Z"].tolist() == [3, 7] and columns["Red"].tolist() == [4, 8] and faces == [[0, 1, 0]]


def test_ptx_pts_obj_sbet(spark, tmp_path):
    ptx = "2\n1\n0 0 0\n1 0 0\n0 1 0\n0 0 1\n1 0 0 0\n0 1 0 0\n0 0 1 0\n10 20 30 1\n1 2 3 0.5 1 2 3\n0 0 0 0 0 0 0\n"
    (tmp_path / "a.ptx").write_text(ptx)
    r = formats.read_ptx(spark, str(tmp_path / "a.ptx")).collect()
    assert [(p.X, p.Y, p.Z, p.Red) for p in r] == [(11, 22, 33, 1)]
    (tmp_path / "a.pts").write_text("2\n1 2 3 4 5 6 7\n8 9 10 11 12 13 14\n")
    assert formats.read_pts(spark, str(tmp_path / "a.pts")).count() == 2
    (tmp_path / "a.obj").write_text("v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1/1 2/2 3/3 4/4\n")
    assert formats.read_obj(spark, str(tmp_path / "a.obj")).count() == 4
    assert [tuple(f) for f in formats.read_obj_faces(spark, str(tmp_path / "a.obj")).collect()] == [(1, 2, 3), (1, 3, 4)]
    np.arange(34, dtype="<f8").tofile(tmp_path / "a.sbet")
    assert [r.GpsTime for r in formats.read_sbet(spark, str(tmp_path / "a.sbet")).orderBy("pid").collect()] == [0, 17]


def test_octree_dataset_prunes_levels(spark, cloud, tmp_path):
    path = str(tmp_path / "octree")
    formats.write_octree(cloud.withColumns({d: F.col(d) * 1000 for d in geo.XYZ}), path, depth=3)
    coarse = formats.read_octree(spark, path, resolution=0.5, spacing=1.0)
    assert "PartitionFilters: [isnotnull(level" in coarse._jdf.queryExecution().executedPlan().toString()
    assert 0 < coarse.count() <= formats.read_octree(spark, path).count() == 1200


def test_index_and_stac(spark, cloud, tmp_path):
    for k in range(2):
        cloud.where(f"pid % 2 = {k}").withColumn("X", F.col("X") + 100 * k).coalesce(1).write.parquet(str(tmp_path / f"t{k}"))
    index = formats.tile_index(spark, str(tmp_path / "t0"), str(tmp_path / "t1"))
    index.write.parquet(str(tmp_path / "index"))
    got = formats.read_index(spark, str(tmp_path / "index"), bounds=[[612, -300], [700, 0]])
    assert got.count() == 600
    items = [{"type": "Feature", "id": f"i{k}", "bbox": [k, 0, k + 1, 1], "properties": {"datetime": f"202{k}-01-01"}, "assets": {"data": {"href": str(tmp_path / f"t{k}")}}} for k in range(2)]
    (tmp_path / "c.json").write_text(json.dumps({"type": "FeatureCollection", "features": items}))
    assert formats.read_stac(spark, str(tmp_path / "c.json"), ids=["i1"]).count() == 600
    assert formats.read_stac(spark, str(tmp_path / "c.json"), dates=[["2019", "2020-06"]]).count() == 600
    assert formats.read_stac(spark, str(tmp_path / "c.json")).count() == 1200


def test_array_source(spark):
    df = formats.read_array(spark, np.arange(6).reshape(2, 3))
    assert values(df, "X", "Y", "Intensity") == [(0, 0, 0), (1, 0, 1), (2, 0, 2), (0, 1, 3), (1, 1, 4), (2, 1, 5)]


# --- pipelines ------------------------------------------------------------------------------------------------------------


def test_pipeline_round_trip():
    spec = {"pipeline": [{"type": "readers.faux", "count": 5}, {"type": "filters.range", "limits": "X[0:1]"}]}
    assert json.loads(Pipeline.from_json(spec).to_json()) == spec


def test_pipeline_errors(spark):
    with pytest.raises(PipelineEncodingFailed):
        Pipeline.from_json("{")
    with pytest.raises(DriverNotRegistered):
        Pipeline.from_json([{"type": "filters.shell"}]).plan(spark)


def test_convert(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("\n".join(f"{i} {2 * i} {3 * i}" for i in range(50)))
    ticks = []
    options = ConvertOptions(filters=[Stage("filters.ferry", {"dimensions": "X=>my_score, Y=>my_tag"}), Stage("filters.assign", {"value": "Z = 0", "where": "X > 40", "where_merge": False})], on_progress=ticks.append)
    result = convert(spark, str(tmp_path / "a.xyz"), str(tmp_path / "b.parquet"), options, stats=True)
    back = spark.read.parquet(str(tmp_path / "b.parquet"))
    assert result.point_count == back.count() == 9 and ticks[-1] == 1.0
    assert back.where("my_score <> X or my_tag <> Y").count() == 0
    assert [s["name"] for s in result.statistics] == ["X", "Y", "Z"]
    with pytest.raises(Cancelled):
        convert(spark, str(tmp_path / "a.xyz"), str(tmp_path / "c.parquet"), ConvertOptions(on_progress=lambda _: False))


def test_cancel_while_it_runs(spark, tmp_path):
    import time

    (tmp_path / "a.xyz").write_text("\n".join(f"{i} {2 * i} {3 * i}" for i in range(500)))

    def slow(columns):
        time.sleep(20)

    calls = []
    options = ConvertOptions(filters=[Stage("filters.streamcallback", {"function": slow})], on_progress=lambda p: calls.append(p) or len(calls) < 2)
    with pytest.raises(Cancelled):
        convert(spark, str(tmp_path / "a.xyz"), str(tmp_path / "b.parquet"), options)
    assert spark.range(3).count() == 3


def test_filters_reach_the_scan(spark, cloud, tmp_path):
    cloud.write.parquet(str(tmp_path / "p"))
    df = filters.keep_ranges(spark.read.parquet(str(tmp_path / "p")), "X[1:2]").select("Z")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(X,1.0)" in plan and "ReadSchema: struct<X:double,Z:double>" in plan


def test_nearest_of_few_and_by_cells_are_the_same(spark, cloud):
    for itself in (False, True):
        few, cells = (neighbours.nearest(cloud, cloud, 5, extra=["Classification"], itself=itself, few=n) for n in (5000, 0))
        columns = ["a_pid", "b_pid", "d2", "rank", "b_Classification"]
        assert sorted(map(tuple, few.select(columns).collect())) == sorted(map(tuple, cells.select(columns).collect()))


def test_openings_by_axis(spark):
    rows = [(i, j, float((i * 7 + j * 13) % 11)) for i in range(12) for j in range(12) if (i + j) % 5]
    df, known = spark.createDataFrame(rows, "i long, j long, h double"), {(i, j): h for i, j, h in rows}
    for round_ in (False, True):
        for how, plain in ((F.min, min), (F.max, max)):
            got = {(r.i, r.j): r.h for r in surfaces.around(df, 2, "h", how, round_).collect()}
            assert got == {(i, j): plain(v for (a, b), v in known.items() if abs(a - i) <= 2 and abs(b - j) <= 2 and (not round_ or (a - i) ** 2 + (b - j) ** 2 <= 4)) for i, j in known}


def test_las_counts():
    head = bytearray(375)
    head[:4], head[25] = b"LASF", 4
    head[107:111] = (77).to_bytes(4, "little")
    assert formats.las_points(bytes(head)) == 77
    head[247:255] = (2**33).to_bytes(8, "little")
    assert formats.las_points(bytes(head)) == 2**33
    with pytest.raises(ValueError):
        formats.las_points(b"NOPE" + bytes(head[4:]))


def test_overlay_joins_many_polygons(spark, cloud):
    r = np.random.default_rng(4)
    polygons = [{"ring": [(x, y), (x + w, y), (x + w / 2, y + w)], "zone": k} for k, (x, y, w) in enumerate(zip(r.uniform(512, 520, 30), r.uniform(-97, -88, 30), r.uniform(0.1, 3, 30), strict=True))]
    one, many = (neighbours.overlay(cloud.withColumn("zone", F.lit(-1)), polygons, "zone", "zone", cases=n) for n in (100, 1))
    assert values(one, "zone") == values(many, "zone") and len(set(values(one, "zone"))) > 5


def test_zone_coordinates(spark):
    places = [("EPSG:32631", 2.2945, 48.8582, 448252.0, 5411932.0), ("EPSG:32756", 151.2153, -33.8568, 334897.0, 6252270.0)]
    for srs, x, y, east, north in places:
        df = tr.reproject(spark.createDataFrame([(1, x, y, 0.0)], "pid long, X double, Y double, Z double"), "EPSG:4326", srs)
        got = df.first()
        assert abs(got.X - east) < 60 and abs(got.Y - north) < 60


def test_trees_equal_the_scan(spark):
    r = np.random.default_rng(6)
    p = [(k, float(x), float(y), float(h)) for k, (x, y, h) in enumerate(zip(r.uniform(0, 25, 300), r.uniform(0, 25, 300), r.uniform(0, 25, 300).round(), strict=True))]
    of, members = {}, []
    for k, x, y, h in sorted(p, key=lambda t: (-t[3], t[0])):
        if h < 3:
            break
        d = [min(((x - a) ** 2 + (y - b) ** 2) ** 0.5 for _, a, b, _ in m) for m in members]
        best = min(range(len(d)), key=d.__getitem__, default=None)
        if best is None or d[best] > (2.0 if h > 15 else 1.5):
            members.append([])
            best = len(members) - 1
        members[best].append((k, x, y, h))
    tops = sorted((m[0][0], [t[0] for t in m]) for m in members if len(m) >= 3)
    for n, (_, tree) in enumerate(tops, 1):
        of |= dict.fromkeys(tree, n)
    df = spark.createDataFrame([(k, x, y, 0.0, h) for k, x, y, h in p], "pid long, X double, Y double, Z double, HeightAboveGround double")
    assert values(clusters.trees(df, 3), "ClusterID") == [(of.get(k, 0),) for k in range(300)]


def test_size_histogram_of_large_nodes(spark):
    sizes = [1, 7, 8, (1 << 21) - 1, 1 << 22, 36_000_000, 1 << 40]
    df = spark.createDataFrame([(n,) for n in sizes], "point_count long")
    assert [(r.bucket, r.nodes) for r in detail.size_histogram(df).orderBy("bucket").collect()] == [(0, 1), (2, 1), (3, 1), (20, 1), (22, 1), (25, 1), (40, 1)]


def test_carve_on_edges_of_triangles(spark, monkeypatch):
    p = [(x, y, z) for x in (10.0, 11.0, 31.0) for y in (20.0003, 25.3336333, 36.0003, 52.0003, 60.0003, 40.4501, 50.7001) for z in (0.0, 1.0, 2.0, 5.0)]
    p += [(15.0, y, z) for y in (20.5, 30.2001, 37.03343333, 40.4501, 50.7001) for z in (1.0, 2.0)]
    df = spark.createDataFrame([(k, *v) for k, v in enumerate(p)], "pid long, X double, Y double, Z double")
    solid = lambda x, y, z, op: {**queries.BOX_MESH, "verts": [[a, b, c] for a in x for b in y for c in z], "op": op}
    meshes = [solid((10.25, 30.25), (20.0003, 60.0003), (-1, 6.5), "intersect"), solid((14.5, 20.5), (30.2001, 50.7001), (0.5, 3.5), "subtract")]
    want = [k for k, (x, y, z) in enumerate(p) if 10.25 <= x <= 30.25 and 20.0003 < y < 60.0003 and not (14.5 < x < 20.5 and 30.2001 < y < 50.7001 and 0.5 < z < 3.5)]
    assert [r.pid for r in surfaces.carve(df, meshes).orderBy("pid").collect()] == want
    monkeypatch.setattr(geo, "MOST_TERMS", 2)
    assert [r.pid for r in surfaces.carve(df, meshes).orderBy("pid").collect()] == want


def test_overlay_without_edges(spark):
    p = [(x, y) for x in range(1, 34) for y in (3.8, 3.80001, 10.79999, 10.8, 7.3, 13.8, 20.8, 1.46667, 13.13333)]
    df = spark.createDataFrame([(k, float(x), y) for k, (x, y) in enumerate(p)], "pid long, X double, Y double")
    middles = [(4 * (k % 8) + 3.5, 10 * (k // 8) + 7.3) for k in range(40)]
    polygons = [{"ring": [(x - 3, y), (x, y - 7), (x + 3, y), (x, y + 7)], "zone": k} for k, (x, y) in enumerate(middles)]
    want = [(next((k for k, (a, b) in enumerate(middles) if abs(x - a) / 3 + abs(y - b) / 7 < 1), -1),) for x, y in p]
    for cases in (100, 8):
        assert values(neighbours.overlay(df.withColumn("zone", F.lit(-1)), polygons, "zone", "zone", cases=cases, edges=False), "zone") == want


def test_chips_are_exact_halves(spark, monkeypatch):
    r = np.random.default_rng(8)
    p = [(k, float(x), float(y)) for k, (x, y) in enumerate(zip(r.integers(0, 9, 4001), r.integers(0, 2000, 4001) / 250, strict=True))]
    df = spark.createDataFrame(p, "pid long, X double, Y double")
    halves = lambda rows: rows if not rows else [rows[: (len(rows) + 1) // 2], rows[(len(rows) + 1) // 2 :]]
    want = [p]
    while max(map(len, want)) > 125:
        want = [h for c in want for h in halves(sorted(c, key=lambda t: (t[1 if max(q[1] for q in c) - min(q[1] for q in c) >= max(q[2] for q in c) - min(q[2] for q in c) else 2], t[0])))]
    want = {t[0]: len(want) + k for k, c in enumerate(want) for t in c}
    for most in (10, 600, 10_000):
        monkeypatch.setattr(agg, "CHIP_POINTS", most)
        assert {x.pid: x.chip for x in agg.chip(df, 125).collect()} == want
    assert len(set(want.values())) == 64


def test_smooth_z_makes_no_pairs(spark):
    p = np.random.default_rng(3).random((400, 3))
    df = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(p)], "pid long, X double, Y double, Z double")
    for percent in (50.0, 30.0):
        out = neighbours.smooth_z(df, 0.2, percent)
        assert "b_pid" not in out._jdf.queryExecution().toString()
        got = {r.pid: r.Zadj for r in out.collect()}
        for k, v in enumerate(p):
            assert abs(got[k] - np.percentile(p[((p[:, :2] - v[:2]) ** 2).sum(1) <= 0.2 * 0.2, 2], percent)) < 1e-12


def test_text_points_are_read_by_many_tasks(spark, tmp_path):
    df = spark.range(3000).select((F.col("id") + 1).alias("pid"), *[(F.col("id") * k / 8).alias(d) for k, d in enumerate(geo.XYZ, 1)])
    want = [(k + 1, k / 8, k / 4, 3 * k / 8) for k in range(3000)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096b")
    try:
        for write, read in ((formats.write_ply, formats.read_ply), (formats.write_pcd, formats.read_pcd)):
            path = str(tmp_path / write.__name__)
            write(df, path)
            got = read(spark, path)
            assert got.select(F.spark_partition_id()).distinct().count() > 1
            assert [(r.pid, r.X, r.Y, r.Z) for r in got.orderBy("pid").collect()] == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_delaunay_of_many_points():
    import time

    p, began = np.random.default_rng(12).normal(size=(10_000, 2)), time.process_time()
    faces = np.array(surfaces.triangles(p))
    assert time.process_time() - began < 20
    a, b, c = (p[faces[:, k]] for k in range(3))
    hull = len({e for f in faces.tolist() for e in map(frozenset, ((f[0], f[1]), (f[1], f[2]), (f[2], f[0])))}) * 2 - 3 * len(faces)
    assert len(faces) == 2 * len(p) - 2 - hull and (np.cross(b - a, c - a) > 0).all()
