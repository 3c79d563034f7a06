"""The registered queries over the driver's tables, and their SQL.

lineitem, embeddings and events stand in for point clouds.  A query names its
result's columns; those with ``*`` are rounded to six digits on both sides.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import bits
from plumbline.functions import geometry as geo
from plumbline.operators import aggregates as agg
from plumbline.operators import clusters, detail, filters, neighbours, sorting, surfaces
from plumbline.operators import transforms as tr
from plumbline.operators.materialise import stored
from plumbline.operators.order import PID, with_pid
from plumbline.plans import kernels
from plumbline.plans.pipeline import Pipeline
from plumbline.sources import formats
from plumbline.streaming import residency

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")

COMMON = {
    "p": """p0 AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pid, * FROM lineitem),
p AS (SELECT pid, l_orderkey AS line, l_quantity AS "X", l_extendedprice / 1000 AS "Y", round(l_discount * 100, 6) AS "Z", l_tax AS "Intensity",
 CASE l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 1 ELSE 6 END AS "Classification", row_number() OVER (PARTITION BY l_orderkey ORDER BY pid) AS "ReturnNumber",
 count(*) OVER (PARTITION BY l_orderkey) AS "NumberOfReturns", l_suppkey AS "PointSourceId", epoch(l_shipdate) AS "GpsTime" FROM p0)""",
    "e": 'e AS (SELECT vec_id AS pid, embedding[1]::DOUBLE AS "X", embedding[2]::DOUBLE AS "Y", embedding[3]::DOUBLE AS "Z", label AS "Classification" FROM embeddings)',
    "n": """nb AS (SELECT min("X") AS ax, min("Y") AS ay, min("Z") AS az, greatest(max("X") - min("X"), max("Y") - min("Y"), max("Z") - min("Z")) * 1.000001 AS side FROM p),
nc AS (SELECT d AS depth, "X", "Y", "Z", floor(("X" - ax) / (side / 2.0 ** d))::BIGINT AS nx, floor(("Y" - ay) / (side / 2.0 ** d))::BIGINT AS ny, floor(("Z" - az) / (side / 2.0 ** d))::BIGINT AS nz FROM p, nb, (SELECT unnest([0, 1, 2, 3]) AS d)),
n AS (SELECT depth, nx, ny, nz, ((depth::BIGINT << 57) | (nx << 38) | (ny << 19) | nz)::BIGINT AS id, min("X") AS "minX", max("X") AS "maxX", min("Y") AS "minY", max("Y") AS "maxY", min("Z") AS "minZ", max("Z") AS "maxZ",
 greatest(max("X") - min("X"), max("Y") - min("Y"), max("Z") - min("Z")) AS extent, count(*) AS point_count FROM nc GROUP BY ALL)""",
    "k": """kn AS (SELECT a.pid AS a, b.pid AS b, b."Z" AS bz, b."Classification" AS bc, a."Z" AS az, a."X" - b."X" AS dx, a."Y" - b."Y" AS dy, a."Z" - b."Z" AS dz FROM e a JOIN e b ON a.pid <> b.pid),
k AS (SELECT a, b, bc, dx * dx + dy * dy + dz * dz AS d2, row_number() OVER (PARTITION BY a ORDER BY dx * dx + dy * dy + dz * dz, b) AS rank FROM kn)""",
    "ki": """ki0 AS (SELECT a.pid AS a, b.pid AS b, b."X" - a."X" AS x, b."Y" - a."Y" AS y, b."Z" - a."Z" AS z FROM e a, e b),
ki AS (SELECT *, x * x + y * y + z * z AS d2, row_number() OVER (PARTITION BY a ORDER BY x * x + y * y + z * z, b) AS rank FROM ki0)""",
    "m": """m0 AS (SELECT p.*, min("X") OVER () AS ax, max("X") OVER () AS bx, min("Y") OVER () AS ay, max("Y") OVER () AS by_, min("Z") OVER () AS az, max("Z") OVER () AS bz FROM p),
m1 AS (SELECT *, floor(("X" - ax) * (1023.0 / greatest(bx - ax, 1e-6)))::BIGINT AS gx, floor(("Y" - ay) * (1023.0 / greatest(by_ - ay, 1e-6)))::BIGINT AS gy, floor(("Z" - az) * (1023.0 / greatest(bz - az, 1e-6)))::BIGINT AS gz FROM m0),
m AS (SELECT *, list_sum([(((gx >> b) & 1) << (3 * b + 2)) + (((gy >> b) & 1) << (3 * b + 1)) + (((gz >> b) & 1) << (3 * b)) for b in range(10)])::BIGINT AS morton FROM m1)""",
}
NEEDS = {"p": (), "e": (), "n": ("p",), "k": ("e",), "ki": ("e",), "m": ("p",)}


def _sql(body: str, columns: list[tuple[str, bool]]) -> str:
    wanted: list[str] = []

    def need(name: str) -> None:
        for other in NEEDS[name]:
            need(other)
        if name not in wanted:
            wanted.append(name)

    for name in COMMON:
        used = re.search(rf"\b(FROM|JOIN)\s+{name}\b", body)
        if used and not re.search(rf"\b{name}\s+AS\s+\(", body):
            need(name)
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?(.*?)\s*;;\s*(.*)", body, re.S)
    parts = [COMMON[n] for n in wanted] + ([own[2]] if own else [])
    main = own[3] if own else body
    shown = ", ".join(f'round("{c}"::DOUBLE, 6) AS "{c}"' if r else f'"{c}"' for c, r in columns)
    return ("WITH " + ("RECURSIVE " if own and own[1] else "") + ",\n".join(parts) + "\n" if parts else "") + f"SELECT {shown} FROM ({main}) AS t"


def query(columns: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; in ``sql`` own common tables come as ``WITH a AS (...) ;; SELECT ...``."""
    names = [(c.rstrip("*"), c.endswith("*")) for c in columns.split()]

    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[F.round(F.col(c).cast("double"), 6).alias(c) if r else F.col(c).alias(c) for c, r in names])

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = _sql(sql, names)
        return f

    return register


#: Eigenvalues e0 <= e1 <= e2 of the symmetric matrices (c0 c1 c2, c3 c4, c5) of ``cv``, by the cosines of a third of an angle.
_EIGEN = """g1 AS (SELECT *, (c0 + c3 + c5) / 3 AS q FROM cv), g2 AS (SELECT *, sqrt(((c0 - q) ** 2 + (c3 - q) ** 2 + (c5 - q) ** 2 + 2 * (c1 * c1 + c2 * c2 + c4 * c4)) / 6) AS p FROM g1),
g3 AS (SELECT *, CASE WHEN p = 0 THEN 0 ELSE ((c0 - q) * ((c3 - q) * (c5 - q) - c4 * c4) - c1 * (c1 * (c5 - q) - c4 * c2) + c2 * (c1 * c4 - (c3 - q) * c2)) / (2 * p * p * p) END AS r FROM g2),
g4 AS (SELECT *, acos(greatest(-1, least(1, r))) / 3 AS phi FROM g3),
g5 AS (SELECT *, q + 2 * p * cos(phi) AS e2, q + 2 * p * cos(phi + 2 * pi() / 3) AS e00 FROM g4),
eg AS (SELECT *, greatest(e00, 0) AS e0, greatest(3 * q - e00 - e2, 0) AS e1 FROM g5)"""
#: The unit vector of the least eigenvalue, as the longest product of two rows.
_NORMAL = """h1 AS (SELECT *, c0 - e00 AS m0, c3 - e00 AS m3, c5 - e00 AS m5 FROM eg),
h2 AS (SELECT *, [c1 * c4 - c2 * m3, c2 * c1 - m0 * c4, m0 * m3 - c1 * c1] AS u, [c1 * m5 - c2 * c4, c2 * c2 - m0 * m5, m0 * c4 - c1 * c2] AS v, [m3 * m5 - c4 * c4, c4 * c2 - c1 * m5, c1 * c4 - m3 * c2] AS w FROM h1),
h3 AS (SELECT *, CASE WHEN list_dot_product(u, u) >= list_dot_product(v, v) AND list_dot_product(u, u) >= list_dot_product(w, w) THEN u WHEN list_dot_product(v, v) >= list_dot_product(w, w) THEN v ELSE w END AS t FROM h2),
nm AS (SELECT *, t[1] / sqrt(list_dot_product(t, t)) AS nx, t[2] / sqrt(list_dot_product(t, t)) AS ny, t[3] / sqrt(list_dot_product(t, t)) AS nz FROM h3)"""


def _cov(group: str, source: str, by: str = "greatest(count(*) - 1, 1)") -> str:
    """``cv``: covariances of offsets x, y, z by group."""
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    return f"cv AS (SELECT {group}, " + ", ".join(f"(sum({a} * {b}) - count(*) * avg({a}) * avg({b})) / {by} AS c{k}" for k, (a, b) in enumerate(pairs)) + f", avg(x) AS mx, avg(y) AS my, avg(z) AS mz, sqrt(max(d2)) AS reach FROM {source} GROUP BY {group})"


def _greedy(order: str, near: str, source: str = "e", n: str = "") -> str:
    """``gr``: the pids that a scan of the source in the order keeps, as none kept before is ``near`` (of a, b)."""
    return f"""go{n} AS (SELECT *, row_number() OVER (ORDER BY {order}) AS i FROM {source}), gc{n} AS (SELECT a.i, a.pid, coalesce(list(b.pid) FILTER (b.pid IS NOT NULL), []) AS conflicts FROM go{n} a LEFT JOIN go{n} b ON b.i < a.i AND {near} GROUP BY a.i, a.pid),
gs{n}(i, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT c.i, CASE WHEN list_has_any(kept, conflicts) THEN kept ELSE list_append(kept, pid) END FROM gs{n} s JOIN gc{n} c ON c.i = s.i + 1),
gr{n} AS (SELECT unnest(kept) AS pid FROM (SELECT kept FROM gs{n} ORDER BY i DESC LIMIT 1))"""


_D2 = '(a."X" - b."X") * (a."X" - b."X") + (a."Y" - b."Y") * (a."Y" - b."Y") + (a."Z" - b."Z") * (a."Z" - b."Z")'
_HASH = lambda seed, pid="pid": f"('0x' || substr(md5('{seed}:' || {pid}), 1, 15))::BIGINT"


def _farthest(k: int) -> str:
    """``f1`` to ``fk``: points of ``e`` chosen as farthest from those before, with ``fps``."""
    parts = ['f1 AS MATERIALIZED (SELECT *, 0 AS fps FROM e ORDER BY pid LIMIT 1)', "d1 AS MATERIALIZED (SELECT e.*, (e.\"X\" - f.\"X\") * (e.\"X\" - f.\"X\") + (e.\"Y\" - f.\"Y\") * (e.\"Y\" - f.\"Y\") + (e.\"Z\" - f.\"Z\") * (e.\"Z\" - f.\"Z\") AS d FROM e, f1 f)"]
    for n in range(2, k + 1):
        parts.append(f'f{n} AS MATERIALIZED (SELECT * EXCLUDE (d), {n - 1} AS fps FROM d{n - 1} ORDER BY d DESC, pid LIMIT 1)')
        parts.append(f'd{n} AS MATERIALIZED (SELECT a.* EXCLUDE (d), least(a.d, {_D2}) AS d FROM d{n - 1} a, f{n} b)')
    return ", ".join(parts)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_pid(table(spark, sf_dir, "lineitem"), *ORDER, width=1024, keep=True)
    order = Window.partitionBy("__bucket", "l_orderkey")  # a bucket holds whole orders
    return df.select(
        PID, F.col("l_orderkey").alias("line"), F.col("l_quantity").alias("X"), (F.col("l_extendedprice") / 1000).alias("Y"), F.round(F.col("l_discount") * 100, 6).alias("Z"), F.col("l_tax").alias("Intensity"),
        F.when(F.col("l_returnflag") == "A", 2).when(F.col("l_returnflag") == "N", 1).otherwise(6).alias("Classification"), F.row_number().over(order.orderBy(PID)).cast("long").alias("ReturnNumber"), F.count(F.lit(1)).over(order).alias("NumberOfReturns"),
        F.col("l_suppkey").alias("PointSourceId"), F.unix_timestamp("l_shipdate").cast("double").alias("GpsTime"),
    )


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = lambda k: F.element_at("embedding", k).cast("double")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias(PID), v(1).alias("X"), v(2).alias("Y"), v(3).alias("Z"), F.col("label").alias("Classification"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.operators.order import with_one

    df = points(spark, sf_dir).select(*geo.XYZ)
    box = df.agg(*[F.min(d).alias(f"__a{d}") for d in geo.XYZ], (F.greatest(*[F.max(d) - F.min(d) for d in geo.XYZ]) * 1.000001).alias("__side"))
    placed = with_one(df, box).withColumn("depth", F.explode(F.array(*map(F.lit, range(4)))))
    width = F.col("__side") / F.pow(F.lit(2.0), F.col("depth"))
    cells = placed.withColumns({f"o{d.lower()}": F.floor((F.col(d) - F.col(f"__a{d}")) / width) for d in geo.XYZ})
    return detail.node_table(cells.withColumn("level", F.col("depth")))


IDENTITY = (1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)
#: An orthographic view of X 5..45, Y 20..70, Z 0..12.
VIEW = (0.05, 0.0, 0.0, -1.25, 0.0, 0.04, 0.0, -1.8, 0.0, 0.0, 1 / 12, 0.0, 0.0, 0.0, 0.0, 1.0)

# --- flagship -----------------------------------------------------------------

FLAGSHIP = {"pipeline": [{"type": "filters.range", "limits": "X[5:45]"}, {"type": "filters.voxeldownsize", "cell": 10.0, "origin": [0, 0, 0]}]}


@query(
    "position name count minimum* maximum* average* stddev* variance*",
    """WITH f AS (SELECT * FROM p WHERE "X" BETWEEN 5 AND 45),
v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY floor("X" / 10), floor("Y" / 10), floor("Z" / 10) ORDER BY pid) AS rn FROM f) WHERE rn = 1),
d AS (SELECT 0 AS position, 'X' AS name, "X" AS v FROM v UNION ALL SELECT 1, 'Y', "Y" FROM v UNION ALL SELECT 2, 'Z', "Z" FROM v) ;;
SELECT position, name, count(*) AS count, min(v) AS minimum, max(v) AS maximum, avg(v) AS average, stddev_samp(v) AS stddev, var_samp(v) AS variance FROM d GROUP BY position, name /* FROM p */""",
)
def voxel_statistics(spark: SparkSession, d: str) -> DataFrame:
    return agg.statistics(Pipeline.from_json(FLAGSHIP).plan(spark, points(spark, d)), geo.XYZ)


# --- filters ------------------------------------------------------------------


@query("pid X* Y* Z*", 'SELECT * FROM p WHERE "X" >= 10 AND "X" < 20 AND NOT ("Z" > 2 AND "Z" <= 5) AND ("Y" <= 30 OR "Y" >= 60)')
def range_filter(spark: SparkSession, d: str) -> DataFrame:
    return filters.keep_ranges(points(spark, d), "X[10:20),Z!(2:5],Y[:30],Y[60:]")


@query("pid X* Y* Z*", 'SELECT * FROM p WHERE (sqrt("X") + 2 * "Z" > 9 OR NOT "Classification" = 1) AND "Y" / 2 - 1 <= 20')
def expr_filter(spark: SparkSession, d: str) -> DataFrame:
    return filters.keep_expression(points(spark, d), "(sqrt(X) + 2 * Z > 9 || !Classification == 1) && Y / 2 - 1 <= 20")


@query("pid X* Classification", 'SELECT * FROM p WHERE ("X" > 40 OR "Classification" IN (2, 6)) AND NOT ("Z" < 3 OR "Y" >= 70)')
def mongo_filter(spark: SparkSession, d: str) -> DataFrame:
    return filters.keep_mongo(points(spark, d), '{"$and": [{"$or": [{"X": {"$gt": 40}}, {"Classification": {"$in": [2, 6]}}]}, {"$nor": [{"Z": {"$lt": 3}}, {"Y": {"$gte": 70}}]}]}')


@query("pid X*", 'SELECT * FROM p WHERE "Z" <> 4')
def nodata_filter(spark: SparkSession, d: str) -> DataFrame:
    return filters.drop_nodata(points(spark, d), 4.0)


@query("pid X* Y* Z*", 'SELECT * FROM p WHERE "X" BETWEEN 10 AND 30 AND "Y" BETWEEN 20 AND 50 AND "Z" BETWEEN 1 AND 8')
def crop_box(spark: SparkSession, d: str) -> DataFrame:
    return filters.crop(points(spark, d), bounds=[[10, 20, 1], [30, 50, 8]])


@query("pid X* Y* Z*", 'SELECT * FROM p WHERE ("X" - 25) * ("X" - 25) + ("Y" - 40) * ("Y" - 40) + ("Z" - 5) * ("Z" - 5) <= 144')
def crop_radius(spark: SparkSession, d: str) -> DataFrame:
    return filters.crop(points(spark, d), point=[25, 40, 5], distance=12)


RING = [(10, 10), (40, 20), (30, 80), (20, 40)]
_INSIDE = """"X" BETWEEN 10 AND 40 AND "Y" BETWEEN 10 AND 80 AND (
 ((10 > "Y") <> (20 > "Y") AND "X" < 30 * ("Y" - 10) / 10.0 + 10)::INT + ((20 > "Y") <> (80 > "Y") AND "X" < -10 * ("Y" - 20) / 60.0 + 40)::INT
 + ((80 > "Y") <> (40 > "Y") AND "X" < -10 * ("Y" - 80) / -40.0 + 30)::INT + ((40 > "Y") <> (10 > "Y") AND "X" < -10 * ("Y" - 40) / -30.0 + 20)::INT) % 2 = 1"""


@query("pid X* Y*", f"SELECT * FROM p WHERE {_INSIDE}")
def crop_polygon(spark: SparkSession, d: str) -> DataFrame:
    return filters.crop(points(spark, d), polygon=RING)


@query("pid view", """SELECT * FROM (SELECT pid, CASE WHEN "NumberOfReturns" = 1 THEN 'only' WHEN "ReturnNumber" = 1 THEN 'first' WHEN "ReturnNumber" = "NumberOfReturns" THEN 'last' ELSE 'intermediate' END AS view FROM p) WHERE view IN ('last', 'only', 'intermediate')""")
def returns_split(spark: SparkSession, d: str) -> DataFrame:
    return filters.split_returns(points(spark, d), ["last", "only", "intermediate"])


@query("pid Y*", 'WITH q AS (SELECT quantile_cont("Y", 0.25) AS a, quantile_cont("Y", 0.75) AS b FROM p) ;; SELECT pid, "Y" FROM p, q WHERE "Y" BETWEEN a - 0.4 * (b - a) AND b + 0.4 * (b - a)')
def iqr_keep(spark: SparkSession, d: str) -> DataFrame:
    return filters.keep_iqr(points(spark, d), "Y", 0.4)


@query("pid Y*", 'WITH q AS (SELECT median("Y") AS med FROM p), r AS (SELECT median(abs("Y" - med)) AS mad FROM p, q) ;; SELECT pid, "Y" FROM p, q, r WHERE abs("Y" - med) <= 0.8 * 1.4826 * mad')
def mad_keep(spark: SparkSession, d: str) -> DataFrame:
    return filters.keep_mad(points(spark, d), "Y", 0.8)


@query("pid Y*", 'SELECT * FROM p ORDER BY "Y" DESC, pid LIMIT 1')
def locate_max(spark: SparkSession, d: str) -> DataFrame:
    return filters.locate(points(spark, d), "Y", "max")


@query("pid X*", "SELECT * FROM p ORDER BY pid LIMIT 100")
def head_n(spark: SparkSession, d: str) -> DataFrame:
    return filters.head(points(spark, d), 100)


@query("pid X*", "SELECT * FROM p WHERE pid > 5000")
def head_n_invert(spark: SparkSession, d: str) -> DataFrame:
    return filters.head(points(spark, d), 5000, invert=True)


@query("pid X*", "SELECT * FROM p ORDER BY pid DESC LIMIT 10")
def tail_n(spark: SparkSession, d: str) -> DataFrame:
    return filters.tail(points(spark, d))


@query("pid X*", "SELECT * FROM p WHERE pid <= (SELECT count(*) FROM p) - 1000")
def tail_n_invert(spark: SparkSession, d: str) -> DataFrame:
    return filters.tail(points(spark, d), 1000, invert=True)


@query("pid X*", "SELECT * FROM p WHERE pid - 1 >= 3 AND pid - 1 < 50000 AND (pid - 1 - 3) % 7 = 0")
def decimate_step(spark: SparkSession, d: str) -> DataFrame:
    return filters.decimate(points(spark, d), 7, 3, 50_000)


@query("pid X*", "SELECT * FROM p WHERE ceil(ceil((pid - 1) / 2.5) * 2.5) = pid - 1")
def decimate_broken_step(spark: SparkSession, d: str) -> DataFrame:
    return filters.decimate(points(spark, d), 2.5)


@query("pid distance*", 'SELECT pid, sqrt(("X" - 20) * ("X" - 20) + ("Y" - 30) * ("Y" - 30)) AS distance FROM p ORDER BY distance, pid LIMIT 10')
def nearest_to_place(spark: SparkSession, d: str) -> DataFrame:
    return filters.nearest_to(points(spark, d), 20, 30)


@query("pid X* Y* Z*", 'SELECT * FROM p WHERE 0.05 * "X" - 1.25 + 1 >= 0 AND 1 - (0.05 * "X" - 1.25) >= 0 AND 0.04 * "Y" - 1.8 + 1 >= 0 AND 1 - (0.04 * "Y" - 1.8) >= 0 AND "Z" >= 0 AND "Z" / 12 <= 1')
def frustum_points(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).where(filters.frustum(VIEW))


BOX_MESH = {"verts": [[x, y, z] for x in (10, 30) for y in (20, 60) for z in (-1, 6)], "faces": [[0, 1, 3, 2], [4, 6, 7, 5], [0, 4, 5, 1], [2, 3, 7, 6], [0, 2, 6, 4], [1, 5, 7, 3]]}
INNER_MESH = {"verts": [[x, y, z] for x in (14.5, 20.5) for y in (30.2, 50.7) for z in (0.5, 3.5)], "faces": BOX_MESH["faces"], "op": "subtract"}


@query(
    "pid X* Y* Z*",
    """SELECT * FROM p WHERE "X" >= 10.25 AND "X" <= 30.25 AND "Y" > 20.0003 AND "Y" < 60.0003 AND "Z" > -1 AND "Z" < 6.5 AND NOT ("X" > 14.5 AND "X" < 20.5 AND "Y" > 30.2001 AND "Y" < 50.7001 AND "Z" > 0.5 AND "Z" < 3.5)""",
)
def mesh_carve_box(spark: SparkSession, d: str) -> DataFrame:
    outer = {"verts": [[v[0] + 0.25, round(v[1] + 0.0003, 4), v[2] if v[2] < 0 else 6.5] for v in BOX_MESH["verts"]], "faces": BOX_MESH["faces"], "op": "intersect"}
    inner = {**INNER_MESH, "verts": [[v[0], round(v[1] + 0.0001, 4), v[2]] for v in INNER_MESH["verts"]]}
    return surfaces.carve(points(spark, d), [outer, inner])


# --- transforms -----------------------------------------------------------------


@query("pid X* Z*", 'SELECT pid, CASE WHEN "Z" >= 5 THEN "X" * 2 + 1 ELSE "X" END AS "X", (CASE WHEN "Z" >= 5 THEN "X" * 2 + 1 ELSE "X" END) / 10 - "Z" AS "Z" FROM p')
def assign_where(spark: SparkSession, d: str) -> DataFrame:
    return tr.assign(points(spark, d), ["X = X * 2 + 1 WHERE Z >= 5", "Z = X / 10 - Z"])


@query("pid Score* Tag*", 'SELECT pid, "X" AS "Score", "Y" AS "Tag" FROM p')
def ferry(spark: SparkSession, d: str) -> DataFrame:
    return tr.ferry(points(spark, d), "X=>Score, Y=>Tag")


@query("pid Z*", 'SELECT pid, "Intensity" AS "Z" FROM p')
def dimension_map(spark: SparkSession, d: str) -> DataFrame:
    return tr.map_dimensions(points(spark, d), {"intensity": "Z"})


MATRIX = [0.0, -1.0, 0.0, 100.0, 1.0, 0.0, 0.0, -20.0, 0.0, 0.0, 2.0, 5.0, 0.0, 0.0, 0.0, 1.0]


@query("pid X* Y* Z*", 'SELECT pid, 100 - "Y" AS "X", "X" - 20 AS "Y", 2 * "Z" + 5 AS "Z" FROM p')
def transform4x4(spark: SparkSession, d: str) -> DataFrame:
    return tr.transform(points(spark, d), MATRIX)


@query("pid X* Y* Z*", 'SELECT pid, "Y" + 20 AS "X", 100 - "X" AS "Y", ("Z" - 5) / 2 AS "Z" FROM p')
def transform_inverse(spark: SparkSession, d: str) -> DataFrame:
    return tr.transform(points(spark, d), MATRIX, invert=True)


@query("pid X* Y*", 'SELECT pid, radians("X") * 6378137.0 AS "X", ln(tan(radians("Y" / 2) + pi() / 4)) * 6378137.0 AS "Y" FROM p WHERE "Y" < 80')
def reproject_mercator(spark: SparkSession, d: str) -> DataFrame:
    return tr.reproject(points(spark, d).where("Y < 80"), "EPSG:4326", "EPSG:3857")


@query("pid px* py* pz*", 'WITH b AS (SELECT (min("X") + max("X")) / 2 AS cx, (min("Y") + max("Y")) / 2 AS cy, (min("Z") + max("Z")) / 2 AS cz FROM p) ;; SELECT pid, ("X" - cx)::FLOAT::DOUBLE AS px, ("Y" - cy)::FLOAT::DOUBLE AS py, ("Z" - cz)::FLOAT::DOUBLE AS pz FROM p, b')
def center_position(spark: SparkSession, d: str) -> DataFrame:
    return tr.centred(points(spark, d)).select(PID, *[F.element_at("position", k + 1).alias(n) for k, n in enumerate(("px", "py", "pz"))])


def coloured(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).withColumns({"Red": F.col("PointSourceId") * 7 % 4000, "Green": F.rint(F.col("X") * 100).cast("long"), "Blue": F.floor(F.col("Y") * 10).cast("long")})


@query("pid r* g* b* a*", 'WITH c AS (SELECT pid, "PointSourceId" * 7 % 4000 AS r, ("X" * 100)::BIGINT AS g, floor("Y" * 10)::BIGINT AS b FROM p), q AS (SELECT CASE WHEN max(greatest(r, g, b)) > 255 THEN 1 / 65535.0::DOUBLE WHEN max(greatest(r, g, b)) > 1 THEN 1 / 255.0::DOUBLE ELSE 1 END AS s FROM c) ;; SELECT pid, (r * s)::FLOAT::DOUBLE AS r, (g * s)::FLOAT::DOUBLE AS g, (b * s)::FLOAT::DOUBLE AS b, 1.0::DOUBLE AS a FROM c, q /* FROM p */')
def colour_normalise(spark: SparkSession, d: str) -> DataFrame:
    return tr.colour_normalised(coloured(spark, d)).select(PID, *[F.element_at("color", k + 1).alias(n) for k, n in enumerate("rgba")])


@query("pid rgba", 'WITH c AS (SELECT pid, "PointSourceId" * 7 % 4000 AS r, ("X" * 100)::BIGINT AS g, floor("Y" * 10)::BIGINT AS b FROM p) ;; SELECT pid, (((r >> 8) & 255) + (((g >> 8) & 255) << 8) + (((b >> 8) & 255) << 16) + (255::BIGINT << 24))::BIGINT AS rgba FROM c /* FROM p */')
def colour_pack(spark: SparkSession, d: str) -> DataFrame:
    return tr.packed_colour(coloured(spark, d))


@query("minx* miny* minz* maxx* maxy* maxz*", 'SELECT 100 - max("Y") AS minx, min("X") - 20 AS miny, 2 * min("Z") + 5 AS minz, 100 - min("Y") AS maxx, max("X") - 20 AS maxy, 2 * max("Z") + 5 AS maxz FROM p')
def bounds_transform(spark: SparkSession, d: str) -> DataFrame:
    return tr.transform_bounds(points(spark, d), MATRIX)


@query(
    "pid X* Y* Z* Intensity",
    """WITH s AS (SELECT event_id AS pid, 10 + user_id % 3 AS tx, 1.0 AS ty, -2.0 AS tz, value AS r, (event_id % 360) / 60.0 AS az, (event_id % 90) / 60.0 AS el FROM events WHERE event_id % 11 <> 0),
c AS (SELECT *, r * cos(el) * cos(az) AS x, r * cos(el) * sin(az) AS y, r * sin(el) AS z FROM s) ;;
SELECT pid, -y + tx AS "X", x + ty AS "Y", z + tz AS "Z", floor(least(greatest(r / 50, 0), 1) * 65535 + 0.5)::INT AS "Intensity" FROM c""",
)
def e57_pose(spark: SparkSession, d: str) -> DataFrame:
    """Scans turned a quarter around Z; every eleventh point is invalid."""
    ev = table(spark, d, "events")
    raw = ev.select(F.col("event_id").alias(PID), (F.col("user_id") % 3).alias("scan_id"), F.col("value").alias("range"), ((F.col("event_id") % 360) / 60.0).alias("azimuth"), ((F.col("event_id") % 90) / 60.0).alias("elevation"), (F.col("event_id") % 11 == 0).cast("int").alias("invalid"), (F.col("value") / 50).alias("intensity"), *[F.lit(0.0).alias(c) for c in "xyz"])
    scans = spark.range(3).select(F.col("id").alias("scan_id"), (F.col("id") + 10.0).alias("tx"), F.lit(1.0).alias("ty"), F.lit(-2.0).alias("tz"), F.lit(0.5**0.5).alias("qw"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.lit(0.5**0.5).alias("qz"), F.lit(False).alias("has_cartesian"))
    return tr.scan_points(raw, scans)


@query(
    "pid X* Y* Z*",
    """WITH t AS (SELECT epoch(ts) AS time, event_id, value FROM events WHERE event_id % 10 = 0),
q AS (SELECT event_id AS pid, epoch(ts) AS time, value FROM events WHERE event_id % 10 <> 0) ;;
SELECT pid, -0.0 + t.value + q.value * cos(0.1) AS "X", 2 + q.value * sin(0.1) AS "Y", 1.0 + 3 AS "Z" FROM q ASOF JOIN t ON q.time >= t.time""",
)
def georeference(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").withColumn("time", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    pose = ev.where("event_id % 10 = 0").select("time", F.col("value").alias("x"), F.lit(2.0).alias("y"), F.lit(3.0).alias("z"), F.lit(0.0).alias("roll"), F.lit(0.0).alias("pitch"), F.lit(0.1).alias("azimuth"))
    own = ev.where("event_id % 10 <> 0").select(F.col("event_id").alias(PID), F.col("time").alias("GpsTime"), F.col("value").alias("X"), F.lit(0.0).alias("Y"), F.lit(1.0).alias("Z"))
    return tr.georeference(own, pose, bucket=86400.0)


@query("pid GpsTime*", 'SELECT pid, ("GpsTime" - 1e9) - floor(("GpsTime" - 1e9) / 604800) * 604800 AS "GpsTime" FROM (SELECT pid, "GpsTime" AS "GpsTime" FROM p)')
def gps_time(spark: SparkSession, d: str) -> DataFrame:
    df = points(spark, d)
    return tr.convert_gps_time(tr.convert_gps_time(df, "gt2gst"), "gt2ws")


@query(
    "pid GpsTime*",
    """WITH s AS (SELECT event_id AS pid, floor(epoch(ts))::BIGINT % 604800 AS w FROM events), l AS (SELECT *, lag(w) OVER (ORDER BY pid) AS before FROM s) ;;
SELECT pid, w + 604800.0 * sum(CASE WHEN before - w > 1 THEN 1 ELSE 0 END) OVER (ORDER BY pid) AS "GpsTime" FROM l""",
)
def gps_unwrap(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").select(F.col("event_id").alias(PID), (F.unix_seconds(F.col("ts").cast("timestamp")) % 604800).cast("double").alias("GpsTime"))
    return tr.convert_gps_time(ev, "ws2gt")


@query("q r n", """WITH h AS (SELECT "X" * (2.0::DOUBLE / 3) / 5 AS fq, ("Y" * sqrt(3) / 3 - "X" / 3) / 5 AS fr FROM p), i AS (SELECT *, floor(fq + 0.5) AS rq, floor(fr + 0.5) AS rr, floor(-fq - fr + 0.5) AS rs FROM h),
j AS (SELECT *, abs(rq - fq) AS dq, abs(rr - fr) AS dr, abs(rs + fq + fr) AS ds FROM i) ;; SELECT (CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END)::BIGINT AS q, (CASE WHEN dq > dr AND dq > ds THEN rr WHEN dr > ds THEN -rq - rs ELSE rr END)::BIGINT AS r, count(*) AS n FROM j GROUP BY 1, 2 HAVING count(*) >= 5 /* FROM p */""")
def hexbin_counts(spark: SparkSession, d: str) -> DataFrame:
    return tr.hexbin(points(spark, d), 5.0, 5)


@query("pid morton", "SELECT pid, morton FROM m")
def morton_order(spark: SparkSession, d: str) -> DataFrame:
    return tr.morton_order(points(spark, d))


@query("pid Xq Yq Zq X* Y*", 'WITH b AS (SELECT min("X") AS ax, min("Y") AS ay, min("Z") AS az FROM p), q AS (SELECT *, floor(("X" - ax) / 0.01 + 0.5)::INT AS "Xq", floor(("Y" - ay) / 0.01 + 0.5)::INT AS "Yq", floor(("Z" - az) / 0.01 + 0.5)::INT AS "Zq" FROM p, b) ;; SELECT pid, "Xq", "Yq", "Zq", "Xq" * 0.01 + ax AS "X", "Yq" * 0.01 + ay AS "Y" FROM q /* FROM p */')
def quantise_coordinates(spark: SparkSession, d: str) -> DataFrame:
    return tr.quantised(points(spark, d), 0.01)


_RAMP = {"Red": [110, 160, 245, 230], "Green": [160, 220, 235, 140], "Blue": [220, 160, 150, 110]}


@query("pid Red Green Blue", f"""WITH b AS (SELECT min("Y") AS lo, max("Y") AS hi FROM p), k AS (SELECT pid, floor(("Y" - lo) / (hi - lo) * 255 + 0.5)::INT AS k FROM p, b), s AS (SELECT pid, least(k // 85, 2) AS s, (k - 85 * least(k // 85, 2)) / 85.0 AS f FROM k) ;;
SELECT pid, {", ".join(f'round({v}[s + 1] + ({v}[s + 2] - {v}[s + 1]) * f)::INT AS "{c}"' for c, v in _RAMP.items())} FROM s /* FROM p */""")
def colour_ramp(spark: SparkSession, d: str) -> DataFrame:
    return tr.colour_ramp(points(spark, d), "Y", clamp=True)


_A, _B = 2000**0.5, 5800**0.5  # lengths of the two segments
_STATION = lambda n, ax, ay, az, dx, dy, dz, size, at: f"""t{n} AS (SELECT pid, "X" - {ax} AS x, "Y" - {ay} AS y, "Z" - {az} AS z FROM p), u{n} AS (SELECT *, least(greatest((x * {dx} + y * {dy}) / {size!r}, 0), {size!r}) AS t FROM t{n}),
v{n} AS (SELECT pid, round((x - t * {dx} / {size!r}) ** 2 + (y - t * {dy} / {size!r}) ** 2, 9) AS d, {n} AS n, t + {at!r} AS "X", (y * {dx} - x * {dy}) / {size!r} AS "Y", z - t / {size!r} * {dz} AS "Z" FROM u{n})"""  # noqa: E731


@query("pid X* Y* Z*", f"""WITH {_STATION(0, 0, 0, 0, 20, 40, 1, _A, 0.0)}, {_STATION(1, 20, 40, 1, 30, 70, 2, _B, _A)}, w AS (SELECT * FROM v0 UNION ALL SELECT * FROM v1) ;;
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY d, n) AS rn FROM w) WHERE rn = 1 /* FROM p */""")
def straighten(spark: SparkSession, d: str) -> DataFrame:
    return tr.straighten(points(spark, d), [(0, 0, 0), (20, 40, 1), (50, 110, 3)])


# --- aggregates -----------------------------------------------------------------

_DIMS = """d AS (SELECT 0 AS position, 'X' AS name, "X" AS v FROM p UNION ALL SELECT 1, 'Y', "Y" FROM p UNION ALL SELECT 2, 'Z', "Z" FROM p)"""


@query("position name count minimum* maximum* average* stddev* variance*", f"WITH {_DIMS} ;; SELECT position, name, count(*) AS count, min(v) AS minimum, max(v) AS maximum, avg(v) AS average, stddev_samp(v) AS stddev, var_samp(v) AS variance FROM d GROUP BY position, name /* FROM p */")
def stats_xyz(spark: SparkSession, d: str) -> DataFrame:
    return agg.statistics(points(spark, d), geo.XYZ)


@query("name skewness* kurtosis* median* mad*", f'WITH {_DIMS}, q AS (SELECT name, median(v) AS med FROM d GROUP BY name) ;; SELECT name, skewness(v) AS skewness, kurtosis(v) AS kurtosis, median(v) AS median, median(abs(v - med)) AS mad FROM d JOIN q USING (name) GROUP BY name /* FROM p */')
def stats_sample_moments(spark: SparkSession, d: str) -> DataFrame:
    return agg.statistics(points(spark, d), geo.XYZ, advanced=True, robust=True)


@query("value count", 'SELECT "Classification" AS value, count(*) AS count FROM p GROUP BY 1')
def enumerate_values(spark: SparkSession, d: str) -> DataFrame:
    return agg.enumerate_values(points(spark, d), "Classification")


@query("expression value count", """SELECT 'X > 25' AS expression, "Classification" AS value, count(*) AS count FROM p WHERE "X" > 25 GROUP BY 2 UNION ALL SELECT 'Z < 3', "Classification", count(*) FROM p WHERE "Z" < 3 GROUP BY 2""")
def expr_stats(spark: SparkSession, d: str) -> DataFrame:
    return agg.expression_statistics(points(spark, d), "Classification", ["X > 25", "Z < 3"])


@query("view_id n", 'SELECT "PointSourceId" AS view_id, count(*) AS n FROM p GROUP BY 1')
def groupby_view(spark: SparkSession, d: str) -> DataFrame:
    return agg.group_views(points(spark, d), "PointSourceId").groupBy("view_id").agg(F.count(F.lit(1)).alias("n"))


@query("minx* miny* minz* maxx* maxy* maxz*", 'SELECT min("X") AS minx, min("Y") AS miny, min("Z") AS minz, max("X") AS maxx, max("Y") AS maxy, max("Z") AS maxz FROM p')
def bounds(spark: SparkSession, d: str) -> DataFrame:
    return agg.bounds(points(spark, d))


@query("pid Classification", 'SELECT pid, CASE WHEN row_number() OVER (PARTITION BY floor("X" / 5), floor("Y" / 5) ORDER BY "Z", pid) = 1 THEN 2.0 ELSE "Classification" END::INT AS "Classification" FROM p')
def grid_min(spark: SparkSession, d: str) -> DataFrame:
    return agg.grid_decimation(points(spark, d), 5.0).withColumn("Classification", F.col("Classification").cast("int"))


_ORIGIN = 'o AS (SELECT "X" AS ox, "Y" AS oy, "Z" AS oz FROM p WHERE pid = 1), v AS (SELECT *, floor(("X" - ox) / 4) AS vx, floor(("Y" - oy) / 4) AS vy, floor(("Z" - oz) / 4) AS vz FROM p, o)'


@query("pid X* Y* Z*", f'WITH {_ORIGIN} ;; SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vx, vy, vz ORDER BY pid) AS rn FROM v) WHERE rn = 1 /* FROM p */')
def voxel_first(spark: SparkSession, d: str) -> DataFrame:
    return agg.voxel_first(points(spark, d), 4.0)


@query("pid X* Y* Z*", f'WITH {_ORIGIN} ;; SELECT pid, (vx + 0.5) * 4 + ox AS "X", (vy + 0.5) * 4 + oy AS "Y", (vz + 0.5) * 4 + oz AS "Z" FROM (SELECT *, row_number() OVER (PARTITION BY vx, vy, vz ORDER BY pid) AS rn FROM v) WHERE rn = 1 /* FROM p */')
def voxel_center(spark: SparkSession, d: str) -> DataFrame:
    return agg.voxel_first(points(spark, d), 4.0, "center")


@query("pid X* Y* Z*", f'WITH {_ORIGIN}, w AS (SELECT *, ("X" - ((vx + 0.5) * 4 + ox)) AS a, ("Y" - ((vy + 0.5) * 4 + oy)) AS b, ("Z" - ((vz + 0.5) * 4 + oz)) AS c FROM v) ;; SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vx, vy, vz ORDER BY a * a + b * b + c * c, pid) AS rn FROM w) WHERE rn = 1 /* FROM p */')
def voxel_center_nn(spark: SparkSession, d: str) -> DataFrame:
    return agg.voxel_nearest_centre(points(spark, d), 4.0)


@query("voxels mean_d2*", """WITH w AS (SELECT *, floor("X" / 4) AS vx, floor("Y" / 4) AS vy, floor("Z" / 4) AS vz FROM p), a AS (SELECT *, avg("X") OVER (PARTITION BY vx, vy, vz) AS mx, avg("Y") OVER (PARTITION BY vx, vy, vz) AS my, avg("Z") OVER (PARTITION BY vx, vy, vz) AS mz FROM w),
b AS (SELECT vx, vy, vz, min(("X" - mx) ** 2 + ("Y" - my) ** 2 + ("Z" - mz) ** 2) AS d2 FROM a GROUP BY 1, 2, 3) ;; SELECT count(*) AS voxels, avg(d2) AS mean_d2 FROM b /* FROM p */""")
def voxel_centroid_nn(spark: SparkSession, d: str) -> DataFrame:
    df = points(spark, d)
    means = df.groupBy(*[F.floor(F.col(c) / 4).alias(f"k{c}") for c in geo.XYZ]).agg(*[F.avg(c).alias(f"m{c}") for c in geo.XYZ])
    kept = agg.voxel_nearest_centroid(df, 4.0, origin=[0, 0, 0]).withColumns({f"k{c}": F.floor(F.col(c) / 4) for c in geo.XYZ}).join(means, ["kX", "kY", "kZ"])
    off = [(F.col(c) - F.col(f"m{c}")) for c in geo.XYZ]
    return kept.agg(F.count(F.lit(1)).alias("voxels"), F.avg(off[0] * off[0] + off[1] * off[1] + off[2] * off[2]).alias("mean_d2"))


@query("tx ty n", 'SELECT floor(("X" - 2) / 10)::BIGINT AS tx, floor(("Y" - 3) / 10)::BIGINT AS ty, count(*) AS n FROM p GROUP BY 1, 2')
def splitter_tiles(spark: SparkSession, d: str) -> DataFrame:
    return agg.split_tiles(points(spark, d), 10.0, 2.0, 3.0).groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n"))


@query("tx ty n", 'WITH a AS (SELECT "Y", unnest(range(floor(("X" - 1) / 10)::BIGINT, floor(("X" + 1) / 10)::BIGINT + 1)) AS tx FROM p), b AS (SELECT tx, unnest(range(floor(("Y" - 1) / 10)::BIGINT, floor(("Y" + 1) / 10)::BIGINT + 1)) AS ty FROM a) ;; SELECT tx, ty, count(*) AS n FROM b GROUP BY 1, 2 /* FROM p */')
def splitter_buffer(spark: SparkSession, d: str) -> DataFrame:
    return agg.split_tiles(points(spark, d), 10.0, buffer=1.0).groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n"))


@query("pid view_id", "SELECT pid, (pid - 1) % 7 AS view_id FROM p")
def divider_roundrobin(spark: SparkSession, d: str) -> DataFrame:
    return agg.divide(points(spark, d), "roundrobin", count=7)


@query("pid view_id", "SELECT pid, (pid - 1) // 1000 AS view_id FROM p")
def divider_capacity(spark: SparkSession, d: str) -> DataFrame:
    return agg.divide(points(spark, d), capacity=1000)


@query("pid view_id", "SELECT pid, ntile(7) OVER (ORDER BY pid) - 1 AS view_id FROM p")
def divider_partition(spark: SparkSession, d: str) -> DataFrame:
    return agg.divide(points(spark, d), count=7)


@query("pid view_id", 'SELECT pid, sum(CASE WHEN "X" > 49 THEN 1 ELSE 0 END) OVER (ORDER BY pid)::BIGINT AS view_id FROM p')
def divider_expression(spark: SparkSession, d: str) -> DataFrame:
    return agg.divide(points(spark, d), "expression", expression="X > 49")


@query("pid view_id", 'SELECT pid, ((sum(CASE WHEN "ReturnNumber" = "NumberOfReturns" THEN 1 ELSE 0 END) OVER (ORDER BY pid) - CASE WHEN "ReturnNumber" = "NumberOfReturns" THEN 1 ELSE 0 END) // 3)::BIGINT AS view_id FROM p')
def scan_lines(spark: SparkSession, d: str) -> DataFrame:
    df = points(spark, d).withColumn("EdgeOfFlightLine", (F.col("ReturnNumber") == F.col("NumberOfReturns")).cast("int"))
    return agg.separate_scan_lines(df, 3)


@query("chips points smallest", "SELECT (2 ** ceil(log2(count(*) / 2000.0)))::BIGINT AS chips, count(*) AS points, true AS smallest FROM p")
def chipper(spark: SparkSession, d: str) -> DataFrame:
    sizes = agg.chip(points(spark, d), 2000).groupBy("chip").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("chips"), F.sum("n").alias("points"), (F.max("n") <= 2000).alias("smallest"))


@query(
    "chunk points total_so_far is_first is_complete progress* minx* maxy*",
    """WITH c AS (SELECT (pid - 1) // 10000 AS chunk, count(*) AS points, min("X") AS a, max("Y") AS b FROM p GROUP BY 1) ;;
SELECT chunk, points, sum(points) OVER (ORDER BY chunk)::BIGINT AS total_so_far, chunk = 0 AS is_first, chunk = max(chunk) OVER () AS is_complete, sum(points) OVER (ORDER BY chunk) / sum(points) OVER () AS progress, min(a) OVER (ORDER BY chunk) AS minx, max(b) OVER (ORDER BY chunk) AS maxy FROM c /* FROM p */""",
)
def chunk_progress(spark: SparkSession, d: str) -> DataFrame:
    return agg.chunked(points(spark, d), 10_000)


_EVAL = """l AS (SELECT quality * 2 + toxic AS t, CASE WHEN doc_id % 5 = 0 THEN (quality * 2 + toxic + 1) % 4 ELSE quality * 2 + toxic END AS q FROM labels), m AS (SELECT t, q, count(*) AS n FROM l GROUP BY 1, 2),
k AS (SELECT DISTINCT t AS class FROM l UNION SELECT DISTINCT q FROM l), g AS (SELECT coalesce(sum(n), 0) AS grand, coalesce(sum(CASE WHEN t = q THEN n END), 0) AS rightly FROM m WHERE t < (SELECT max(class) FROM k)),
s AS (SELECT class, coalesce((SELECT sum(n) FROM m WHERE t = class), 0) AS support, coalesce((SELECT sum(n) FROM m WHERE t = class AND q = class), 0) AS tp, coalesce((SELECT sum(n) FROM m WHERE q = class AND t < (SELECT max(class) FROM k)), 0) AS col FROM k),
u AS (SELECT class, support, tp, greatest(col - tp, 0) AS fp, support - tp AS fn, grand, rightly FROM s, g), w AS (SELECT *, greatest(grand - tp - fp - fn, 0) AS tn FROM u)"""


@query("class support tp fp fn tn iou* f1* precision* accuracy* mean_iou* overall_accuracy*", f"""WITH {_EVAL} ;; SELECT class, support::BIGINT AS support, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 0 END AS iou, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1,
CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + tn + fp + fn > 0 THEN (tp + tn) / (tp + tn + fp + fn) ELSE 0 END AS accuracy, avg(CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 0 END) OVER () AS mean_iou, CASE WHEN grand > 0 THEN rightly / grand ELSE 0 END AS overall_accuracy FROM w""")
def eval_confusion(spark: SparkSession, d: str) -> DataFrame:
    truth = F.col("quality") * 2 + F.col("toxic")
    df = table(spark, d, "labels").withColumn("t", truth).withColumn("q", F.when(F.col("doc_id") % 5 == 0, (truth + 1) % 4).otherwise(truth))
    return agg.evaluation(df, "t", "q")


@query("name count average* minx* maxz*", f"""WITH {_DIMS}, b AS (SELECT min("X") AS minx, max("Z") AS maxz FROM p) ;; SELECT name, count(*) AS count, avg(v) AS average, any_value(minx) AS minx, any_value(maxz) AS maxz FROM d, b GROUP BY name /* FROM p */""")
def stac_properties(spark: SparkSession, d: str) -> DataFrame:
    found = agg.stac_properties(points(spark, d), geo.XYZ)
    rows = [(r["name"], r["count"], r["average"], found["bounds"]["minx"], found["bounds"]["maxz"]) for r in found["pc:statistics"]]
    return spark.createDataFrame(rows, "name string, count long, average double, minx double, maxz double")


# --- orders and sets ---------------------------------------------------------------


def placed(df: DataFrame, name: str) -> DataFrame:
    """(pid, ordinal): the place of each row in the whole frame, by the rows of the partitions before its own and those before it there."""
    at = stored(df.select(PID, F.monotonically_increasing_id().alias("at")), name)
    part = F.shiftright("at", 33)
    sizes = at.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # a row a partition
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return at.join(F.broadcast(before), part == F.col("part")).select(PID, (F.col("at") - F.shiftleft("part", 33) + F.col("before")).alias("ordinal"))


@query("pid ordinal", 'SELECT pid, row_number() OVER (ORDER BY "Z" DESC, "Y", pid) - 1 AS ordinal FROM p')
def sort_multi(spark: SparkSession, d: str) -> DataFrame:
    return placed(sorting.sort(points(spark, d), "Z DESC, Y"), "sort_multi")


@query("n pids", 'SELECT count(*) AS n, count(DISTINCT pid) AS pids FROM (SELECT pid FROM p WHERE "X" > 20 UNION ALL SELECT pid FROM p WHERE "Y" > 50)')
def merge_bag(spark: SparkSession, d: str) -> DataFrame:
    df = points(spark, d)
    both = sorting.merge(df.where("X > 20"), df.where("Y > 50").withColumn("Extra", F.lit(1.0)))
    return both.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(PID).alias("pids"))


@query("pid Duplicate", 'SELECT pid, CASE WHEN count(*) OVER (PARTITION BY "X", "Z", "Classification", "PointSourceId") > 1 THEN 1 ELSE 0 END AS "Duplicate" FROM p')
def label_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return sorting.label_duplicates(points(spark, d), "X, Z, Classification, PointSourceId")


@query("pid ordinal", f"SELECT pid, row_number() OVER (ORDER BY {_HASH(7)}, pid) - 1 AS ordinal FROM p")
def randomize(spark: SparkSession, d: str) -> DataFrame:
    return placed(sorting.randomize(points(spark, d), 7), "randomize")


@query("pid", f"""WITH RECURSIVE {_greedy(_HASH(1) + ", pid", _D2 + " <= 0.06::DOUBLE * 0.06::DOUBLE")} ;; SELECT pid FROM gr /* FROM e */""")
def poisson_sample(spark: SparkSession, d: str) -> DataFrame:
    return sorting.poisson_sample(cloud(spark, d), 0.06)


def _darts(count: int, radii: list[float]) -> str:
    """``kd``: each radius adds the points that a scan keeps of those not within it of any before, as long as there are fewer than ``count``."""
    parts = ["dk0 AS (SELECT * FROM e WHERE false)"]
    for n, r in enumerate(radii, 1):
        near = f"{_D2} <= {r!r}::DOUBLE * {r!r}::DOUBLE"
        parts += [f"do{n} AS (SELECT * FROM e a WHERE (SELECT count(*) FROM dk{n - 1}) < {count} AND NOT EXISTS (SELECT 1 FROM dk{n - 1} b WHERE {near}))", _greedy(_HASH(1) + ", pid", near, f"do{n}", str(n)), f"dk{n} AS (SELECT * FROM dk{n - 1} UNION ALL SELECT * FROM e WHERE pid IN (SELECT pid FROM gr{n}))"]
    return ", ".join([*parts, f"kd AS (SELECT * FROM dk{len(radii)})"])


@query("pid", f"""WITH RECURSIVE {_darts(40, [0.2 * 0.8**k for k in range(7)])} ;; SELECT pid FROM kd ORDER BY {_HASH(1)}, pid LIMIT 40 /* FROM e */""")
def dart_throwing(spark: SparkSession, d: str) -> DataFrame:
    return sorting.dart_throwing(cloud(spark, d), 40, 0.2, 0.05)


@query("pid fps", f"""WITH {_farthest(12)} ;; {" UNION ALL ".join(f"SELECT pid, fps FROM f{n}" for n in range(1, 13))} /* FROM e */""")
def farthest_points(spark: SparkSession, d: str) -> DataFrame:
    return sorting.farthest_points(cloud(spark, d), 12)


# --- rasters, ground, meshes ---------------------------------------------------------


@query("i j count min* max* mean* stdev*", 'SELECT floor("X" / 5)::BIGINT AS i, floor("Y" / 5)::BIGINT AS j, count(*) AS count, min("Z") AS min, max("Z") AS max, avg("Z") AS mean, stddev_pop("Z") AS stdev FROM p GROUP BY 1, 2')
def raster_bin_stats(spark: SparkSession, d: str) -> DataFrame:
    return surfaces.raster(points(spark, d), 5.0, bin_mode=True)


@query(
    "i j count mean* idw*",
    """WITH a AS (SELECT "X", "Y", "Z", unnest(range(ceil(("X" - 6) / 5 - 0.5)::BIGINT, floor(("X" + 6) / 5 - 0.5)::BIGINT + 1)) AS i FROM p), b AS (SELECT *, unnest(range(ceil(("Y" - 6) / 5 - 0.5)::BIGINT, floor(("Y" + 6) / 5 - 0.5)::BIGINT + 1)) AS j FROM a),
c AS (SELECT *, sqrt(("X" - (i + 0.5) * 5) * ("X" - (i + 0.5) * 5) + ("Y" - (j + 0.5) * 5) * ("Y" - (j + 0.5) * 5)) AS d FROM b) ;;
SELECT i, j, count(*) AS count, avg("Z") AS mean, coalesce(avg(CASE WHEN d = 0 THEN "Z" END), sum(CASE WHEN d > 0 THEN "Z" / (d * d) END) / sum(CASE WHEN d > 0 THEN 1 / (d * d) END)) AS idw FROM c WHERE d <= 6 GROUP BY i, j /* FROM p */""",
)
def raster_idw(spark: SparkSession, d: str) -> DataFrame:
    return surfaces.raster(points(spark, d), 5.0, radius=6.0, power=2.0)


@query("pid Classification", """WITH s AS (SELECT pid, "Classification", "Z", floor("X" / 2) AS i, floor("Y" / 2) AS j FROM p), t AS (SELECT *, CASE WHEN coalesce(lead("Z") OVER (PARTITION BY i, j ORDER BY "Z", pid) - "Z", 0) > 0.5 THEN 0 ELSE 1 END AS no FROM s) ;;
SELECT pid, CASE WHEN sum(no) OVER (PARTITION BY i, j ORDER BY "Z", pid ROWS UNBOUNDED PRECEDING) = 0 THEN 7 ELSE "Classification" END AS "Classification" FROM t /* FROM p */""")
def elm_flags(spark: SparkSession, d: str) -> DataFrame:
    return surfaces.low_noise(points(spark, d), 2.0, 0.5)


@query("pid Classification", """WITH s AS (SELECT pid, "Y" - (SELECT min("Y") FROM p) AS z FROM p), t AS (SELECT pid, count(*) OVER w AS n, sum(z) OVER w AS a, sum(z * z) OVER w AS b, sum(z * z * z) OVER w AS c FROM s WINDOW w AS (ORDER BY z, pid ROWS UNBOUNDED PRECEDING)),
u AS (SELECT pid, n, c / n - 3 * (a / n) * b / n + 2 * (a / n) ** 3 AS m3 FROM t) ;; SELECT pid, CASE WHEN n <= coalesce((SELECT max(n) FROM u WHERE m3 <= 1e-12), 0) THEN 2 ELSE 1 END AS "Classification" FROM u /* FROM p */""")
def skewness_balance(spark: SparkSession, d: str) -> DataFrame:
    return surfaces.skewness_balancing(points(spark, d).withColumn("Z", F.col("Y")))


def surface_cloud(spark: SparkSession, d: str) -> DataFrame:
    """A sloped field with towers: of lineitem, quantities and discounts as a plane, dear parts stand out."""
    df = points(spark, d)
    return df.select(PID, (F.col("X") * 1.0).alias("X"), (F.col("PointSourceId") % 50 * 1.0).alias("Y"), F.when(F.col("Y") > 60, F.col("X") * 0.05 + 8).otherwise(F.col("X") * 0.05).alias("Z"), F.lit(1).alias("Classification"))


_SURFACE = """s AS (SELECT pid, "X", ("PointSourceId" % 50)::DOUBLE AS "Y", CASE WHEN "Y" > 60 THEN "X" * 0.05::DOUBLE + 8 ELSE "X" * 0.05::DOUBLE END AS "Z" FROM p)"""
_OPENED = lambda n, m, r: f"""o{m} AS (SELECT a.i, a.j, min(b.h) AS h FROM g{n} a JOIN g{n} b ON abs(a.i - b.i) <= {r} AND abs(a.j - b.j) <= {r} GROUP BY a.i, a.j), g{m} AS (SELECT a.i, a.j, max(b.h) AS h FROM o{m} a JOIN o{m} b ON abs(a.i - b.i) <= {r} AND abs(a.j - b.j) <= {r} GROUP BY a.i, a.j)"""


@query("pid Classification", f"""WITH {_SURFACE}, c AS (SELECT *, floor("X" / 2)::BIGINT AS i, floor("Y" / 2)::BIGINT AS j FROM s), g0 AS (SELECT i, j, min("Z") AS h FROM c GROUP BY i, j), {_OPENED(0, 1, 1)}, {_OPENED(1, 2, 2)} ;;
SELECT pid, CASE WHEN "Z" - g1.h < 0.15::DOUBLE AND "Z" - g2.h < 2.5::DOUBLE THEN 2 ELSE 1 END AS "Classification" FROM c JOIN g1 USING (i, j) JOIN g2 USING (i, j) /* FROM p */""")
def ground_pmf(spark: SparkSession, d: str) -> DataFrame:
    return surfaces.pmf(surface_cloud(spark, d), 2.0, 5)


def _bare(rounds: int) -> str:
    """``gr``: the surface ``g0`` without the cells that openings by discs of one to three cells lower by more than the slope, holes filled from the rim in up to so many rounds."""
    near = lambda r: f"(a.i - b.i) * (a.i - b.i) + (a.j - b.j) * (a.j - b.j) <= {r * r}"
    parts = []
    for r in (1, 2, 3):
        parts.append(f"o{r} AS (SELECT a.i, a.j, min(b.h) AS h FROM g{r - 1} a JOIN g{r - 1} b ON {near(r)} GROUP BY a.i, a.j), g{r} AS (SELECT a.i, a.j, max(b.h) AS h FROM o{r} a JOIN o{r} b ON {near(r)} GROUP BY a.i, a.j)")
    fell = " OR ".join(f"g{r - 1}.h - g{r}.h > {0.15 * r * 2.0!r}::DOUBLE" for r in (1, 2, 3))
    parts.append(f"n0 AS (SELECT i, j, g0.h FROM g0 JOIN g1 USING (i, j) JOIN g2 USING (i, j) JOIN g3 USING (i, j) WHERE NOT ({fell}))")
    for k in range(rounds):
        parts.append(f"n{k + 1} AS (SELECT * FROM n{k} UNION ALL SELECT a.i, a.j, avg(b.h) FROM (SELECT * FROM g0 ANTI JOIN n{k} USING (i, j)) a JOIN n{k} b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 GROUP BY a.i, a.j)")
    return ", ".join([*parts, f"gr AS (SELECT a.i, a.j, any_value(a.h) AS h, (max(b.h) - min(b.h)) / 4 AS s FROM n{rounds} a JOIN n{rounds} b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 GROUP BY a.i, a.j)"])


@query("pid Classification", f"""WITH {_SURFACE}, c AS (SELECT *, floor("X" / 2)::BIGINT AS i, floor("Y" / 2)::BIGINT AS j FROM s), g0 AS (SELECT i, j, min("Z") AS h FROM c GROUP BY i, j), {_bare(4)} ;;
SELECT pid, CASE WHEN abs("Z" - gr.h) <= 0.5::DOUBLE + s * 2.5 THEN 2 ELSE 1 END AS "Classification" FROM c JOIN gr USING (i, j) /* FROM p */""")
def ground_smrf(spark: SparkSession, d: str) -> DataFrame:
    return surfaces.smrf(surface_cloud(spark, d), 2.0, window=6.0)


@query("pid Classification")
def ground_csf(spark: SparkSession, d: str) -> DataFrame:
    return surfaces.csf(surface_cloud(spark, d), 2.0)


@query("pid Classification", f"""WITH RECURSIVE {_greedy('"Z", pid', '(a."X" - b."X") * (a."X" - b."X") + (a."Y" - b."Y") * (a."Y" - b."Y") <= 0.05::DOUBLE * 0.05::DOUBLE')} ;; SELECT e.pid, CASE WHEN gr.pid IS NULL THEN 1 ELSE 2 END AS "Classification" FROM e LEFT JOIN gr USING (pid)""")
def sparse_surface(spark: SparkSession, d: str) -> DataFrame:
    return surfaces.sparse_surface(cloud(spark, d).withColumn("Classification", F.lit(2)), 0.05)


#: Faces by edges: the centres of the circles through an edge and a third point lie on a line; an edge with room between the last centre of
#: the points on its right and the first of those on its left is in the mesh, with these two points.
_MESH = """w AS (SELECT a.pid AS a, b.pid AS b, c.pid AS c, b."X" - a."X" AS bx, b."Y" - a."Y" AS by_, c."X" - a."X" AS cx, c."Y" - a."Y" AS cy FROM e a JOIN e b ON a.pid < b.pid JOIN e c ON c.pid <> a.pid AND c.pid <> b.pid),
t AS (SELECT a, b, c, bx * cy - by_ * cx AS side, (cx * cx + cy * cy - bx * cx - by_ * cy) / (2 * (bx * cy - by_ * cx)) AS t FROM w WHERE bx * cy <> by_ * cx),
g AS (SELECT a, b, min(t) FILTER (side > 0) AS l, arg_min(c, t) FILTER (side > 0) AS lc, max(t) FILTER (side < 0) AS r, arg_max(c, t) FILTER (side < 0) AS rc FROM t GROUP BY a, b),
m AS (SELECT a, b, unnest([lc, rc]) AS c FROM g WHERE l IS NULL OR r IS NULL OR r <= l),
f AS (SELECT DISTINCT least(a, b, c) AS a, a + b + c - least(a, b, c) - greatest(a, b, c) AS b, greatest(a, b, c) AS c FROM m WHERE c IS NOT NULL)"""


@query("a b c", f"WITH {_MESH} ;; SELECT a, b, c FROM f /* FROM e */")
def delaunay_faces(spark: SparkSession, d: str) -> DataFrame:
    corners = F.array_sort(F.array("a", "b", "c"))
    return surfaces.delaunay(cloud(spark, d), 0.1).select(*[F.element_at(corners, k + 1).alias(n) for k, n in enumerate("abc")])


@query(
    "i j z*",
    f"""WITH {_MESH}, q AS (SELECT p."X" AS ax, p."Y" AS ay, p."Z" AS az, q."X" AS bx, q."Y" AS by_, q."Z" AS bz, r."X" AS cx, r."Y" AS cy, r."Z" AS cz FROM f JOIN e p ON p.pid = f.a JOIN e q ON q.pid = f.b JOIN e r ON r.pid = f.c),
u AS (SELECT *, unnest(range(ceil(least(ax, bx, cx) / 0.02::DOUBLE - 0.5)::BIGINT, floor(greatest(ax, bx, cx) / 0.02::DOUBLE - 0.5)::BIGINT + 1)) AS i FROM q), v AS (SELECT *, unnest(range(ceil(least(ay, by_, cy) / 0.02::DOUBLE - 0.5)::BIGINT, floor(greatest(ay, by_, cy) / 0.02::DOUBLE - 0.5)::BIGINT + 1)) AS j FROM u),
x AS (SELECT *, (i + 0.5) * 0.02::DOUBLE AS x, (j + 0.5) * 0.02::DOUBLE AS y, (by_ - cy) * (ax - cx) + (cx - bx) * (ay - cy) AS det FROM v),
y AS (SELECT *, ((by_ - cy) * (x - cx) + (cx - bx) * (y - cy)) / det AS l1, ((cy - ay) * (x - cx) + (ax - cx) * (y - cy)) / det AS l2 FROM x WHERE det <> 0) ;;
SELECT i, j, max(l1 * az + l2 * bz + (1 - l1 - l2) * cz) AS z FROM y WHERE l1 >= -1e-12 AND l2 >= -1e-12 AND l1 + l2 <= 1 + 1e-12 GROUP BY i, j /* FROM e */""",
)
def face_raster(spark: SparkSession, d: str) -> DataFrame:
    df = cloud(spark, d)
    return surfaces.face_raster(surfaces.delaunay(df, 0.1), df, 0.02)


# --- neighbours ------------------------------------------------------------------------


@query("pid RadialDensity*", 'SELECT a.pid, count(*) / (4.0::DOUBLE / 3 * pi() * 0.1 ** 3) AS "RadialDensity" FROM e a JOIN e b ON (a."X" - b."X") * (a."X" - b."X") + (a."Y" - b."Y") * (a."Y" - b."Y") + (a."Z" - b."Z") * (a."Z" - b."Z") <= 0.1 * 0.1 GROUP BY a.pid')
def radius_density(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.radial_density(cloud(spark, d), 0.1)


@query("pid NNDistance*", 'SELECT a AS pid, max(sqrt(d2)) AS "NNDistance" FROM k WHERE rank <= 8 GROUP BY a')
def knn_distance(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nn_distance(cloud(spark, d), 8)


@query("pid NNDistance*", 'SELECT a AS pid, avg(sqrt(d2)) AS "NNDistance" FROM k WHERE rank <= 8 GROUP BY a')
def knn_mean_distance(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nn_distance(cloud(spark, d), 8, "average")


@query("pid Classification", 'WITH s AS (SELECT a, avg(sqrt(d2)) AS m FROM k WHERE rank <= 8 GROUP BY a), t AS (SELECT avg(m) + 2 * stddev_samp(m) AS lim FROM s) ;; SELECT e.pid, CASE WHEN m > lim THEN 7 ELSE "Classification" END AS "Classification" FROM e JOIN s ON s.a = e.pid, t /* FROM k */')
def outlier_statistical(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.mark_outliers(cloud(spark, d))


@query("pid Classification", 'WITH s AS (SELECT a, count_if(d2 <= 0.05 * 0.05) AS n FROM k GROUP BY a) ;; SELECT e.pid, CASE WHEN n < 2 THEN 7 ELSE "Classification" END AS "Classification" FROM e JOIN s ON s.a = e.pid /* FROM k */')
def outlier_radius(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.mark_outliers(cloud(spark, d), "radius", radius=0.05, min_k=2)


@query("pid LocalReachabilityDistance* LocalOutlierFactor*", """WITH g AS (SELECT a, b, sqrt(d2) AS d FROM k WHERE rank <= 6), h AS (SELECT a, max(d) AS kd FROM g GROUP BY a), r AS (SELECT g.a, 1 / avg(greatest(g.d, h.kd)) AS lrd FROM g JOIN h ON h.a = g.b GROUP BY g.a),
f AS (SELECT g.a, avg(r.lrd) AS m FROM g JOIN r ON r.a = g.b GROUP BY g.a) ;; SELECT r.a AS pid, lrd AS "LocalReachabilityDistance", m / lrd AS "LocalOutlierFactor" FROM r JOIN f ON f.a = r.a /* FROM k */""")
def lof(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.local_outlier_factor(cloud(spark, d), 6)


@query("pid Reciprocity*", 'WITH g AS (SELECT a, b FROM k WHERE rank <= 8) ;; SELECT x.a AS pid, 100.0 * count_if(y.a IS NULL) / 8 AS "Reciprocity" FROM g x LEFT JOIN g y ON y.a = x.b AND y.b = x.a GROUP BY x.a /* FROM k */')
def reciprocity(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.reciprocity(cloud(spark, d), 8)


@query("pid Classification", 'WITH v AS (SELECT a, bc, count(*) AS n FROM k WHERE rank <= 7 GROUP BY a, bc), w AS (SELECT a, bc, row_number() OVER (PARTITION BY a ORDER BY n DESC, bc) AS rn FROM v) ;; SELECT pid, CASE WHEN "Classification" >= 5 THEN bc ELSE "Classification" END AS "Classification" FROM e JOIN w ON w.a = e.pid AND rn = 1 /* FROM k */')
def nn_classifier(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.vote(cloud(spark, d), 7, domain="Classification[5:]")


@query("pid Classification", 'SELECT pid, CASE WHEN "Classification" >= 5 AND EXISTS (SELECT 1 FROM e b WHERE b."Classification" = 2 AND (a."X" - b."X") * (a."X" - b."X") + (a."Y" - b."Y") * (a."Y" - b."Y") + (a."Z" - b."Z") * (a."Z" - b."Z") <= 0.08 * 0.08) THEN 20.0 ELSE "Classification" END::INT AS "Classification" FROM e a')
def radius_assign(spark: SparkSession, d: str) -> DataFrame:
    out = neighbours.assign_near(cloud(spark, d), 0.08, "Classification = 20", "Classification[5:]", "Classification[2:2]")
    return out.withColumn("Classification", F.col("Classification").cast("int"))


@query("pid zone", f"SELECT pid, CASE WHEN {_INSIDE} THEN 1 WHEN \"X\" BETWEEN 0 AND 25 AND \"Y\" BETWEEN 0 AND 60 AND (((0 > \"Y\") <> (60 > \"Y\") AND \"X\" < 25)::INT + ((60 > \"Y\") <> (0 > \"Y\") AND \"X\" < 0)::INT) % 2 = 1 THEN 2 ELSE 0 END AS zone FROM p")
def overlay(spark: SparkSession, d: str) -> DataFrame:
    polygons = [{"ring": RING, "zone": 1}, {"ring": [(0, 0), (25, 0), (25, 60), (0, 60)], "zone": 2}]
    return neighbours.overlay(points(spark, d).withColumn("zone", F.lit(0)), polygons, "zone", "zone")


@query("pid distance*", """SELECT pid, sqrt(least(("X" - greatest(least("X", 30), 10)) ** 2 + ("Y" - 20) ** 2, ("X" - 30) ** 2 + ("Y" - greatest(least("Y", 50), 20)) ** 2, ("X" - greatest(least("X", 30), 10)) ** 2 + ("Y" - 50) ** 2, ("X" - 10) ** 2 + ("Y" - greatest(least("Y", 50), 20)) ** 2)) AS distance FROM p""")
def geometry_distance(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.geometry_distance(points(spark, d), [(10, 20), (30, 20), (30, 50), (10, 50)])


_DEM = 'r AS (SELECT floor("X" / 5)::BIGINT AS i, floor((110 - "Y") / 5)::BIGINT AS j, avg("Z") AS h FROM p GROUP BY 1, 2)'


def dem(spark: SparkSession, d: str) -> DataFrame:
    i, j = tr.cell_of(5.0, 5.0, 0.0, 110.0)
    return points(spark, d).groupBy(i.alias("col"), j.alias("row")).agg(F.avg("Z").alias("z"))


@query("pid HeightAboveGround*", f'WITH {_DEM} ;; SELECT pid, CASE WHEN "Classification" = 2 THEN 0 ELSE "Z" - h END AS "HeightAboveGround" FROM p JOIN r ON i = floor("X" / 5)::BIGINT AND j = floor((110 - "Y") / 5)::BIGINT')
def hag_dem(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.height_over_raster(points(spark, d), dem(spark, d), y0=110.0, px=5.0, py=5.0)


@query("pid Z*", f'WITH {_DEM} ;; SELECT pid, "Z" FROM p JOIN r ON i = floor("X" / 5)::BIGINT AND j = floor((110 - "Y") / 5)::BIGINT WHERE "Z" BETWEEN h - 2.003 AND h + 3.007')
def dem_band(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.near_surface(points(spark, d), dem(spark, d), 2.003, 3.007, y0=110.0, px=5.0, py=5.0)


@query("pid Red*", f'WITH {_DEM} ;; SELECT pid, h * 2.5 AS "Red" FROM p JOIN r ON i = floor("X" / 5)::BIGINT AND j = floor((110 - "Y") / 5)::BIGINT')
def colorize(spark: SparkSession, d: str) -> DataFrame:
    return tr.colorize(points(spark, d), dem(spark, d), ["Red:z:2.5"], y0=110.0, px=5.0, py=5.0)


@query("pid HeightAboveGround*", """WITH g AS (SELECT a.pid, a."Z" AS az, b."Z" AS bz, (a."X" - b."X") * (a."X" - b."X") + (a."Y" - b."Y") * (a."Y" - b."Y") AS d2, b.pid AS bp FROM e a JOIN e b ON b."Classification" = 2 AND a."Classification" <> 2),
h AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY d2, bp) AS rn FROM g) ;; SELECT pid, 0.0::DOUBLE AS "HeightAboveGround" FROM e WHERE "Classification" = 2 UNION ALL SELECT pid, any_value(az) - sum(bz / sqrt(d2)) / sum(1 / sqrt(d2)) FROM h WHERE rn <= 3 GROUP BY pid""")
def hag_nn(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.height_over_ground(cloud(spark, d), 3)


@query(
    "pid HeightAboveGround*",
    """WITH n0 AS (SELECT a.pid, a."Z" AS az, b."X" - a."X" AS x, b."Y" - a."Y" AS y, b."Z" AS z, b.pid AS bp FROM e a JOIN e b ON b."Classification" = 2 AND a."Classification" <> 2),
n1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY x * x + y * y, bp) AS r FROM n0) WHERE r <= 8),
t AS (SELECT a.pid, a.az, a.x AS x1, a.y AS y1, a.z AS z1, b.x AS x2, b.y AS y2, b.z AS z2, c.x AS x3, c.y AS y3, c.z AS z3, a.r AS r1, b.r AS r2, c.r AS r3, (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS area FROM n1 a JOIN n1 b ON a.pid = b.pid AND a.r < b.r JOIN n1 c ON c.pid = a.pid AND b.r < c.r),
u AS (SELECT *, (x2 * y3 - y2 * x3) / area AS l1, (x3 * y1 - y3 * x1) / area AS l2, (x1 * y2 - y1 * x2) / area AS l3 FROM t WHERE area <> 0),
v AS (SELECT * FROM u WHERE l1 >= -1e-12 AND l2 >= -1e-12 AND l3 >= -1e-12),
w AS (SELECT v.pid, any_value(v.az - (l1 * z1 + l2 * z2 + l3 * z3)) AS h, r1, r2, r3 FROM v JOIN n1 d ON d.pid = v.pid GROUP BY v.pid, r1, r2, r3 HAVING max(CASE WHEN d.r IN (r1, r2, r3) THEN -1 ELSE sign(area) * ((x1 - d.x) * ((y2 - d.y) * ((x3 - d.x) ** 2 + (y3 - d.y) ** 2) - (y3 - d.y) * ((x2 - d.x) ** 2 + (y2 - d.y) ** 2))
 - (y1 - d.y) * ((x2 - d.x) * ((x3 - d.x) ** 2 + (y3 - d.y) ** 2) - (x3 - d.x) * ((x2 - d.x) ** 2 + (y2 - d.y) ** 2)) + ((x1 - d.x) ** 2 + (y1 - d.y) ** 2) * ((x2 - d.x) * (y3 - d.y) - (x3 - d.x) * (y2 - d.y))) END) <= 0),
f AS (SELECT pid, az - z AS h FROM n1 WHERE r = 1) ;; SELECT pid, 0.0::DOUBLE AS "HeightAboveGround" FROM e WHERE "Classification" = 2 UNION ALL SELECT f.pid, coalesce(any_value(w.h), any_value(f.h)) FROM f LEFT JOIN w USING (pid) GROUP BY f.pid""",
)
def hag_delaunay(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.height_over_triangles(cloud(spark, d), 8)


@query("pid Zadj*", 'SELECT a.pid, median(b."Z") AS "Zadj" FROM e a JOIN e b ON (a."X" - b."X") * (a."X" - b."X") + (a."Y" - b."Y") * (a."Y" - b."Y") <= 0.1 * 0.1 GROUP BY a.pid')
def z_smooth(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.smooth_z(cloud(spark, d), 0.1)


_TWO = """x AS (SELECT * FROM e WHERE pid % 2 = 0), y AS (SELECT * FROM e WHERE pid % 2 = 1), xy AS (SELECT x.pid AS a, y.pid AS b, y."X" - x."X" AS dx, y."Y" - x."Y" AS dy, y."Z" - x."Z" AS dz FROM x, y),
s AS (SELECT *, dx * dx + dy * dy + dz * dz AS d2 FROM xy), u AS (SELECT a, min(d2) AS d2 FROM s GROUP BY a), v AS (SELECT b, min(d2) AS d2 FROM s GROUP BY b)"""


def halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    df = cloud(spark, d)
    return df.where("pid % 2 = 0"), df.where("pid % 2 = 1")


@query("chamfer*", f"WITH {_TWO} ;; SELECT (SELECT sum(d2) FROM u) + (SELECT sum(d2) FROM v) AS chamfer /* FROM e */")
def chamfer(spark: SparkSession, d: str) -> DataFrame:
    return kernels.chamfer(*halves(spark, d))


@query("hausdorff*", f"WITH {_TWO} ;; SELECT sqrt(greatest((SELECT max(d2) FROM u), (SELECT max(d2) FROM v))) AS hausdorff /* FROM e */")
def hausdorff(spark: SparkSession, d: str) -> DataFrame:
    return kernels.hausdorff(*halves(spark, d))


@query("name count minimum* maximum* average*", f"""WITH {_TWO}, w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d2, b) AS rn FROM s) WHERE rn = 1) ;;
SELECT 'X' AS name, count(*) AS count, min(dx) AS minimum, max(dx) AS maximum, avg(dx) AS average FROM w UNION ALL SELECT 'Y', count(*), min(dy), max(dy), avg(dy) FROM w UNION ALL SELECT 'Z', count(*), min(dz), max(dz), avg(dz) FROM w /* FROM e */""")
def delta_summary(spark: SparkSession, d: str) -> DataFrame:
    return kernels.delta(*halves(spark, d))


def _registered(rounds: int, turn: list[float]) -> str:
    """``er``: the mean squared distance before each round; a rotation is the orthogonal factor of the products' matrix, by Newton's steps X -> (X + inverse of X transposed) / 2."""
    at = lambda r: " + ".join(f"{turn[4 * r + k]!r}::DOUBLE * {c}" for k, c in enumerate(('"X"', '"Y"', '"Z"'))) + f" + {turn[4 * r + 3]!r}::DOUBLE"
    ij = [(i, j) for i in range(3) for j in range(3)]
    axes = "xyz"
    parts = [f"m0 AS MATERIALIZED (SELECT pid, {at(0)} AS x, {at(1)} AS y, {at(2)} AS z FROM e)"]
    for k in range(rounds):
        parts.append(f"""n{k} AS MATERIALIZED (SELECT * FROM (SELECT m.x AS ax, m.y AS ay, m.z AS az, e."X" AS bx, e."Y" AS by_, e."Z" AS bz, (m.x - e."X") ** 2 + (m.y - e."Y") ** 2 + (m.z - e."Z") ** 2 AS d2, row_number() OVER (PARTITION BY m.pid ORDER BY (m.x - e."X") * (m.x - e."X") + (m.y - e."Y") * (m.y - e."Y") + (m.z - e."Z") * (m.z - e."Z"), e.pid) AS rn FROM m{k} m, e) WHERE rn = 1)""")
        b = {"x": "bx", "y": "by_", "z": "bz"}
        means = ", ".join(f"avg(a{c}) AS ma{c}, avg({b[c]}) AS mb{c}" for c in axes)
        products = ", ".join(f"avg({b[axes[i]]} * a{axes[j]}) - avg({b[axes[i]]}) * avg(a{axes[j]}) AS x{i}{j}" for i, j in ij)
        parts.append(f"s{k}_0 AS MATERIALIZED (SELECT avg(d2) AS err, {means}, {products} FROM n{k})")
        cof = {(i, j): f"(x{(i + 1) % 3}{(j + 1) % 3} * x{(i + 2) % 3}{(j + 2) % 3} - x{(i + 1) % 3}{(j + 2) % 3} * x{(i + 2) % 3}{(j + 1) % 3})" for i, j in ij}
        det = " + ".join(f"x0{j} * {cof[0, j]}" for j in range(3))
        keep = "err, " + ", ".join(f"ma{c}, mb{c}" for c in axes)
        for n in range(14):
            parts.append(f"s{k}_{n + 1} AS MATERIALIZED (SELECT {keep}, " + ", ".join(f"(x{i}{j} + {cof[i, j]} / ({det})) / 2 AS x{i}{j}" for i, j in ij) + f" FROM s{k}_{n})")
        rows = ", ".join(f"x{i}0 * (m.x - max_) + x{i}1 * (m.y - may) + x{i}2 * (m.z - maz) + mb{axes[i]} AS {axes[i]}" for i in range(3)).replace("max_", "s.max")
        parts.append(f"m{k + 1} AS MATERIALIZED (SELECT pid, {rows} FROM m{k} m, s{k}_14 s)")
    every = " UNION ALL ".join(f"SELECT {k} AS k, err FROM s{k}_0" for k in range(rounds))
    return ", ".join([*parts, f"er AS (SELECT *, lag(err) OVER (ORDER BY k) AS last FROM ({every}))"])


_TURN = [0.9998, -0.02, 0.0, 0.01, 0.02, 0.9998, 0.0, -0.01, 0.0, 0.0, 1.0, 0.005, 0.0, 0.0, 0.0, 1.0]


@query("pid icp_rmse*", f"""WITH {_registered(6, _TURN)} ;; SELECT pid, sqrt(coalesce((SELECT last FROM er WHERE abs(last - err) <= 1e-8 ORDER BY k LIMIT 1), (SELECT err FROM er WHERE k = 5))) AS icp_rmse FROM e""")
def icp(spark: SparkSession, d: str) -> DataFrame:
    fixed = cloud(spark, d)
    return neighbours.register(tr.transform(fixed, _TURN), fixed, 6)


@query("trace*", """WITH g AS (SELECT a.pid, b."X" - a."X" AS x, b."Y" - a."Y" AS y, b."Z" - a."Z" AS z, row_number() OVER (PARTITION BY a.pid ORDER BY (a."X" - b."X") * (a."X" - b."X") + (a."Y" - b."Y") * (a."Y" - b."Y") + (a."Z" - b."Z") * (a."Z" - b."Z"), b.pid) AS rn FROM e a, e b),
c AS (SELECT pid, var_samp(x) + var_samp(y) + var_samp(z) AS t FROM g WHERE rn <= 8 GROUP BY pid) ;; SELECT sum(t) AS trace FROM c /* FROM e */""")
def eigen_trace(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.eigenvalues(cloud(spark, d), 8).agg(F.sum(F.col("Eigenvalue0") + F.col("Eigenvalue1") + F.col("Eigenvalue2")).alias("trace"))


@query("pid Eigenvalue0* Eigenvalue1* Eigenvalue2*", f'WITH k8 AS (SELECT * FROM ki WHERE rank <= 8), {_cov("a", "k8")}, {_EIGEN} ;; SELECT a AS pid, e0 AS "Eigenvalue0", e1 AS "Eigenvalue1", e2 AS "Eigenvalue2" FROM eg /* FROM ki */')
def eigenvalues(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.eigenvalues(cloud(spark, d), 8)


@query("pid Linearity* Planarity* Scattering* Anisotropy* Eigenentropy*", f"""WITH k10 AS (SELECT * FROM ki WHERE rank <= 10), {_cov("a", "k10")}, {_EIGEN}, v AS (SELECT a, sqrt(e0) AS v2, sqrt(e1) AS v1, sqrt(e2) AS v0 FROM eg), w AS (SELECT *, v0 / (v0 + v1 + v2) AS s0, v1 / (v0 + v1 + v2) AS s1, v2 / (v0 + v1 + v2) AS s2 FROM v) ;;
SELECT a AS pid, (v0 - v1) / v0 AS "Linearity", (v1 - v2) / v0 AS "Planarity", v2 / v0 AS "Scattering", (v0 - v2) / v0 AS "Anisotropy", -(s0 * ln(s0) + s1 * ln(s1) + CASE WHEN s2 > 0 THEN s2 * ln(s2) ELSE 0 END) AS "Eigenentropy" FROM w /* FROM ki */""")
def eigen_features(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.covariance_features(cloud(spark, d), 10)


@query("pid NormalX* NormalY* NormalZ* Curvature*", f"""WITH k8 AS (SELECT * FROM ki WHERE rank <= 8), {_cov("a", "k8")}, {_EIGEN}, {_NORMAL} ;;
SELECT a AS pid, CASE WHEN nz < 0 THEN -nx ELSE nx END AS "NormalX", CASE WHEN nz < 0 THEN -ny ELSE ny END AS "NormalY", abs(nz) AS "NormalZ", e0 / (e0 + e1 + e2) AS "Curvature" FROM nm /* FROM ki */""")
def normals(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.normals(cloud(spark, d), 8)


@query("pid Coplanar", f'WITH k8 AS (SELECT * FROM ki WHERE rank <= 8), {_cov("a", "k8")}, {_EIGEN} ;; SELECT a AS pid, (e1 > e0 * 25 AND e1 * 6 > e2)::INT AS "Coplanar" FROM eg /* FROM ki */')
def coplanar(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.coplanar(cloud(spark, d), 8)


@query("pid Rank", f'WITH k8 AS (SELECT * FROM ki WHERE rank <= 8), {_cov("a", "k8")}, {_EIGEN} ;; SELECT a AS pid, (e0 > 0.002)::INT + (e1 > 0.002)::INT + (e2 > 0.002)::INT AS "Rank" FROM eg /* FROM ki */')
def estimate_rank(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.estimate_rank(cloud(spark, d), 8, 0.002)


@query("pid PlaneFit*", f"""WITH k8 AS (SELECT a, -dx AS x, -dy AS y, -dz AS z, dx * dx + dy * dy + dz * dz AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY dx * dx + dy * dy + dz * dz, b) AS rank FROM kn) WHERE rank <= 8), {_cov("a", "k8", "count(*)")}, {_EIGEN}, {_NORMAL},
o AS (SELECT a, abs(mx * nx + my * ny + mz * nz) AS own FROM nm), w AS (SELECT k8.a, avg(abs((x - mx) * nx + (y - my) * ny + (z - mz) * nz)) AS away FROM k8 JOIN nm ON nm.a = k8.a GROUP BY k8.a) ;; SELECT o.a AS pid, own / (own + away) AS "PlaneFit" FROM o JOIN w ON w.a = o.a /* FROM k */""")
def plane_fit(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.plane_fit(cloud(spark, d), 8)


#: Smallest ball: of those through two, three or four of the points that hold all the smallest.
@query(
    "pid Miniball*",
    """WITH q AS (SELECT a, rank AS r, -dx AS x, -dy AS y, -dz AS z FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY dx * dx + dy * dy + dz * dz, b) AS rank FROM kn) WHERE rank <= 8),
b2 AS (SELECT p.a, p.x + (q.x - p.x) / 2 AS x, p.y + (q.y - p.y) / 2 AS y, p.z + (q.z - p.z) / 2 AS z, sqrt((q.x - p.x) ** 2 + (q.y - p.y) ** 2 + (q.z - p.z) ** 2) / 2 AS s FROM q p JOIN q ON q.a = p.a AND p.r < q.r),
v AS (SELECT p.a, p.r, q.r AS r2, s.r AS r3, p.x AS px, p.y AS py, p.z AS pz, q.x - p.x AS ax, q.y - p.y AS ay, q.z - p.z AS az, s.x - p.x AS bx, s.y - p.y AS by_, s.z - p.z AS bz FROM q p JOIN q ON q.a = p.a AND p.r < q.r JOIN q s ON s.a = p.a AND q.r < s.r),
v1 AS (SELECT *, ay * bz - az * by_ AS cx, az * bx - ax * bz AS cy, ax * by_ - ay * bx AS cz, ax * ax + ay * ay + az * az AS aa, bx * bx + by_ * by_ + bz * bz AS bb FROM v),
v2 AS (SELECT *, cx * cx + cy * cy + cz * cz AS cc FROM v1),
b3 AS (SELECT a, px, py, pz, (bb * (cy * az - cz * ay) + aa * (by_ * cz - bz * cy)) / (2 * cc) AS ux, (bb * (cz * ax - cx * az) + aa * (bz * cx - bx * cz)) / (2 * cc) AS uy, (bb * (cx * ay - cy * ax) + aa * (bx * cy - by_ * cx)) / (2 * cc) AS uz FROM v2 WHERE cc > 1e-24),
w AS (SELECT v2.*, s.x - px AS dx, s.y - py AS dy, s.z - pz AS dz FROM v2 JOIN q s ON s.a = v2.a AND s.r > r3),
w1 AS (SELECT *, dx * dx + dy * dy + dz * dz AS dd, 2 * (cx * dx + cy * dy + cz * dz) AS det FROM w),
b4 AS (SELECT a, px, py, pz, (aa * (by_ * dz - bz * dy) + bb * (dy * az - dz * ay) + dd * cx) / det AS ux, (aa * (bz * dx - bx * dz) + bb * (dz * ax - dx * az) + dd * cy) / det AS uy, (aa * (bx * dy - by_ * dx) + bb * (dx * ay - dy * ax) + dd * cz) / det AS uz FROM w1 WHERE abs(det) > 1e-18),
balls AS (SELECT * FROM b2 UNION ALL SELECT a, px + ux, py + uy, pz + uz, sqrt(ux * ux + uy * uy + uz * uz) FROM b3 UNION ALL SELECT a, px + ux, py + uy, pz + uz, sqrt(ux * ux + uy * uy + uz * uz) FROM b4),
h AS (SELECT c.a, c.x, c.y, c.z, c.s FROM balls c JOIN q ON q.a = c.a GROUP BY ALL HAVING max(sqrt((q.x - c.x) ** 2 + (q.y - c.y) ** 2 + (q.z - c.z) ** 2) - c.s) <= 1e-9),
m AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s) AS rn FROM h) ;; SELECT a AS pid, sqrt(x * x + y * y + z * z) / (sqrt(x * x + y * y + z * z) + 2 * s / sqrt(3)) AS "Miniball" FROM m WHERE rn = 1 /* FROM k */""",
)
def miniball(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.miniball(cloud(spark, d), 8)


@query("pid OptimalKNN OptimalRadius*", f"""WITH g AS (SELECT a, x, y, z, d2, k FROM ki JOIN (SELECT unnest([8, 9, 10, 11, 12]) AS k) ON rank <= k), {_cov("a, k", "g", "count(*)")}, {_EIGEN}, v AS (SELECT a, k, reach, e0 / (e0 + e1 + e2) AS s0, e1 / (e0 + e1 + e2) AS s1, e2 / (e0 + e1 + e2) AS s2 FROM eg),
w AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY -(s1 * ln(s1) + s2 * ln(s2) + CASE WHEN s0 > 0 THEN s0 * ln(s0) ELSE 0 END), k) AS rn FROM v) ;; SELECT a AS pid, k::BIGINT AS "OptimalKNN", reach AS "OptimalRadius" FROM w WHERE rn = 1 /* FROM ki */""")
def optimal_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.optimal_neighbourhood(cloud(spark, d), 8, 12)


_NEAR_LATTICE = """c AS (SELECT pid, "X" + dx AS "X", "Z" + dz AS "Z", "Y" AS y, dx * dx + dz * dz AS f2 FROM p, (SELECT unnest(range(-3, 4)) AS dx), (SELECT unnest(range(-3, 4)) AS dz)),
s AS (SELECT c.pid, p.pid AS b, f2 + (c.y - p."Y") * (c.y - p."Y") AS d2 FROM c JOIN p ON c."X" = p."X" AND c."Z" = p."Z" AND p."Y" BETWEEN c.y - 3 AND c.y + 3 WHERE c.pid <> p.pid AND d2 <= 9),
g AS (SELECT pid FROM s GROUP BY pid HAVING count(*) >= 8), r AS (SELECT * FROM p ANTI JOIN g USING (pid)),
t AS (SELECT * FROM s SEMI JOIN g USING (pid) UNION ALL SELECT r.pid, p.pid, (r."X" - p."X") ** 2 + (r."Y" - p."Y") ** 2 + (r."Z" - p."Z") ** 2 FROM r JOIN p ON r.pid <> p.pid),
q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY round(d2, 9), b) AS rn FROM t) WHERE rn <= 8)"""


@query("pid NNDistance*", f'WITH {_NEAR_LATTICE} ;; SELECT pid, max(sqrt(d2)) AS "NNDistance" FROM q GROUP BY pid /* FROM p */')
def knn_points(spark: SparkSession, d: str) -> DataFrame:
    """Eighth neighbour of every point of a cloud that no task could hold, by doubling radius joins."""
    return neighbours.nn_distance(points(spark, d).select(PID, *geo.XYZ), 8)


@query("pid n*", f'WITH {_NEAR_LATTICE} ;; SELECT pid, avg(sqrt(d2)) AS n FROM q GROUP BY pid /* FROM p */')
def knn_points_mean(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nn_distance(points(spark, d).select(PID, *geo.XYZ), 8, "average").withColumnRenamed("NNDistance", "n")


# --- clusters ----------------------------------------------------------------------------

@query("pid ClusterID", "WITH RECURSIVE l AS (SELECT a.pid AS a, b.pid AS b FROM e a JOIN e b ON (a.\"X\" - b.\"X\") * (a.\"X\" - b.\"X\") + (a.\"Y\" - b.\"Y\") * (a.\"Y\" - b.\"Y\") + (a.\"Z\" - b.\"Z\") * (a.\"Z\" - b.\"Z\") <= 0.04 * 0.04), w(a, b) AS (SELECT pid, pid FROM e UNION SELECT w.a, l.b FROM w JOIN l ON l.a = w.b), c AS (SELECT a AS pid, min(b) AS root FROM w GROUP BY a), s AS (SELECT root, row_number() OVER (ORDER BY root) AS id FROM c GROUP BY root HAVING count(*) >= 2) ;; SELECT pid, coalesce(id, 0)::BIGINT AS \"ClusterID\" FROM c LEFT JOIN s USING (root) /* FROM e */")
def cluster(spark: SparkSession, d: str) -> DataFrame:
    return clusters.euclidean(cloud(spark, d), 0.04, 2)


@query("pid ClusterID", f"""WITH RECURSIVE l AS (SELECT a.pid AS a, b.pid AS b, {_D2} AS d2 FROM e a JOIN e b ON {_D2} <= 0.07::DOUBLE * 0.07::DOUBLE), c AS (SELECT a FROM l GROUP BY a HAVING count(*) >= 4), i AS (SELECT l.a, l.b FROM l JOIN c x ON x.a = l.a JOIN c y ON y.a = l.b),
w(a, b) AS (SELECT a, a FROM c UNION SELECT w.a, i.b FROM w JOIN i ON i.a = w.b), r AS (SELECT a, min(b) AS root FROM w GROUP BY a), n AS (SELECT root, row_number() OVER (ORDER BY root) AS id FROM (SELECT DISTINCT root FROM r)),
t AS (SELECT l.a, r.root, row_number() OVER (PARTITION BY l.a ORDER BY l.d2, l.b) AS rn FROM l JOIN r ON r.a = l.b) ;; SELECT e.pid, coalesce(n.id, -1) AS "ClusterID" FROM e LEFT JOIN t ON t.a = e.pid AND rn = 1 LEFT JOIN n ON n.root = t.root""")
def dbscan(spark: SparkSession, d: str) -> DataFrame:
    return clusters.dbscan(cloud(spark, d), 4, 0.07)


def _lloyd(rounds: int) -> str:
    """``c0`` to ``c<rounds>``: centres after each round; ``a<n>``: points with their nearest centre of ``cn``."""
    nearest = lambda n: f'a{n} AS MATERIALIZED (SELECT * FROM (SELECT a.*, b.i, row_number() OVER (PARTITION BY a.pid ORDER BY {_D2}, b.i) AS rn FROM e a, c{n} b) WHERE rn = 1)'
    parts = ["c0 AS MATERIALIZED (" + " UNION ALL ".join(f'SELECT fps AS i, "X", "Y", "Z" FROM f{n}' for n in range(1, 6)) + ")"]
    for n in range(rounds):
        parts += [nearest(n), f'c{n + 1} AS MATERIALIZED (SELECT i, avg("X") AS "X", avg("Y") AS "Y", avg("Z") AS "Z" FROM a{n} GROUP BY i)']
    return ", ".join([*parts, nearest(rounds)])


@query("pid ClusterID", f"""WITH {_farthest(5)}, {_lloyd(10)} ;; SELECT pid, i::BIGINT AS "ClusterID" FROM a10 /* FROM e */""")
def kmeans(spark: SparkSession, d: str) -> DataFrame:
    return clusters.kmeans(cloud(spark, d), 5)


@query(
    "pid ClusterID",
    """WITH RECURSIVE t AS (SELECT pid, "X" * 100 AS x, "Y" * 100 AS y, ("Z" + 0.6::DOUBLE) * 20 AS h FROM e), o AS (SELECT * FROM t WHERE h >= 3),
j AS (SELECT a.pid, b.pid AS up, row_number() OVER (PARTITION BY a.pid ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.h DESC, b.pid) AS rn FROM o a JOIN o b ON (b.h > a.h OR (b.h = a.h AND b.pid < a.pid)) AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= CASE WHEN a.h > 15 THEN 4.0 ELSE 2.25 END),
w(pid, top) AS (SELECT pid, pid FROM o WHERE pid NOT IN (SELECT pid FROM j) UNION ALL SELECT j.pid, w.top FROM w JOIN j ON j.up = w.pid AND j.rn = 1),
n AS (SELECT top, row_number() OVER (ORDER BY top) AS id FROM w GROUP BY top HAVING count(*) >= 2) ;; SELECT e.pid, coalesce(n.id, 0) AS "ClusterID" FROM e LEFT JOIN w USING (pid) LEFT JOIN n USING (top)""",
)
def li_trees(spark: SparkSession, d: str) -> DataFrame:
    df = cloud(spark, d).select(PID, (F.col("X") * 100).alias("X"), (F.col("Y") * 100).alias("Y"), "Z", ((F.col("Z") + 0.6) * 20).alias("HeightAboveGround"))
    return clusters.trees(df, 2, 3.0)


def _patches(rounds: int, size: float) -> str:
    """``p<rounds>``: points with the patch ``l`` that each round gives them, from voxels of the size on."""
    parts = [f"""p0 AS MATERIALIZED (SELECT e.pid, "X" AS x, "Y" AS y, "Z" AS z, CASE WHEN nz < 0 THEN -nx ELSE nx END AS nx, CASE WHEN nz < 0 THEN -ny ELSE ny END AS ny, abs(nz) AS nz, dense_rank() OVER (ORDER BY floor("X" / {size}::DOUBLE), floor("Y" / {size}::DOUBLE), floor("Z" / {size}::DOUBLE)) AS l FROM e JOIN nm ON nm.a = e.pid)"""]
    for k in range(rounds):
        parts.append(f"""c{k} AS MATERIALIZED (SELECT l, avg(x) AS x, avg(y) AS y, avg(z) AS z, sum(nx) / sqrt(sum(nx) ** 2 + sum(ny) ** 2 + sum(nz) ** 2) AS nx, sum(ny) / sqrt(sum(nx) ** 2 + sum(ny) ** 2 + sum(nz) ** 2) AS ny, sum(nz) / sqrt(sum(nx) ** 2 + sum(ny) ** 2 + sum(nz) ** 2) AS nz FROM p{k} GROUP BY l),
d{k} AS (SELECT p.pid, c.l, sqrt((p.x - c.x) ** 2 + (p.y - c.y) ** 2 + (p.z - c.z) ** 2) AS d, abs(p.nx * c.nx + p.ny * c.ny + p.nz * c.nz) AS f FROM p{k} p, c{k} c),
p{k + 1} AS MATERIALIZED (SELECT p.* EXCLUDE (l), q.l FROM p{k} p JOIN (SELECT pid, l, row_number() OVER (PARTITION BY pid ORDER BY 0.4::DOUBLE * d / {size}::DOUBLE + 1 - f, l) AS rn FROM d{k} WHERE d <= {2 * size}::DOUBLE) q ON q.pid = p.pid AND rn = 1)""")
    return ", ".join(parts)


@query("pid ClusterID", f"""WITH k8 AS (SELECT * FROM ki WHERE rank <= 8), {_cov("a", "k8")}, {_EIGEN}, {_NORMAL}, {_patches(5, 0.1)}, r AS (SELECT pid, min(pid) OVER (PARTITION BY l) AS root FROM p5) ;;
SELECT pid, dense_rank() OVER (ORDER BY root) AS "ClusterID" FROM r /* FROM ki */""")
def supervoxels(spark: SparkSession, d: str) -> DataFrame:
    return clusters.supervoxels(cloud(spark, d), 0.1, tile=0.4)


# --- levels of detail --------------------------------------------------------------------

_LEVELS = """s AS (SELECT *, greatest(bx - ax, by_ - ay, bz - az, 1e-6) AS side FROM m),
l0 AS (SELECT *, row_number() OVER (PARTITION BY floor(("X" - ax) / (side / 16)), floor(("Y" - ay) / (side / 16)), floor(("Z" - az) / (side / 16)) ORDER BY morton, pid) = 1 AS c0 FROM s),
l1 AS (SELECT *, NOT c0 AND row_number() OVER (PARTITION BY c0, floor(("X" - ax) / (side / 16 * 0.5)), floor(("Y" - ay) / (side / 16 * 0.5)), floor(("Z" - az) / (side / 16 * 0.5)) ORDER BY morton, pid) = 1 AS c1 FROM l0),
l AS (SELECT *, CASE WHEN c0 THEN 0 WHEN c1 THEN 1 ELSE 2 END AS level FROM l1)"""


@query("pid level", f"WITH {_LEVELS} ;; SELECT pid, level FROM l /* FROM m */")
def lod_levels(spark: SparkSession, d: str) -> DataFrame:
    return detail.lod_levels(points(spark, d), 3, 16)


@query("batch num_points c0 c1 c2 minx* maxy*", f'WITH {_LEVELS}, b AS (SELECT *, (row_number() OVER (ORDER BY morton, pid) - 1) // 10240 AS batch FROM l) ;; SELECT batch, count(*) AS num_points, count_if(level <= 0)::BIGINT AS c0, count_if(level <= 1)::BIGINT AS c1, count_if(level <= 2)::BIGINT AS c2, min("X") AS minx, max("Y") AS maxy FROM b GROUP BY batch /* FROM m */')
def batch_cum_counts(spark: SparkSession, d: str) -> DataFrame:
    table_ = detail.batch_table(detail.batched(detail.lod_levels(points(spark, d), 3, 16)), 3)
    return table_.withColumns({f"c{k}": F.element_at("cum", k + 1).cast("long") for k in range(3)})


@query(
    "pid batch low med high",
    """WITH b AS (SELECT pid, "X", "Y", "Z", (row_number() OVER (ORDER BY morton, pid) - 1) // 10240 AS batch FROM m), x AS (SELECT *, min("X") OVER w AS ax, max("X") OVER w - min("X") OVER w AS sx, min("Y") OVER w AS ay, max("Y") OVER w - min("Y") OVER w AS sy, min("Z") OVER w AS az, max("Z") OVER w - min("Z") OVER w AS sz FROM b WINDOW w AS (PARTITION BY batch)),
q AS (SELECT pid, batch, floor(least(greatest(("X" - ax) / greatest(sx, 1e-6), 0), 0.99999994::DOUBLE) * 1073741823.0::DOUBLE)::BIGINT AS qx, floor(least(greatest(("Y" - ay) / greatest(sy, 1e-6), 0), 0.99999994::DOUBLE) * 1073741823.0::DOUBLE)::BIGINT AS qy, floor(least(greatest(("Z" - az) / greatest(sz, 1e-6), 0), 0.99999994::DOUBLE) * 1073741823.0::DOUBLE)::BIGINT AS qz FROM x) ;;
SELECT pid, batch, ((qx >> 20) & 1023) + (((qy >> 20) & 1023) << 10) + (((qz >> 20) & 1023) << 20) AS low, ((qx >> 10) & 1023) + (((qy >> 10) & 1023) << 10) + (((qz >> 10) & 1023) << 20) AS med, (qx & 1023) + ((qy & 1023) << 10) + ((qz & 1023) << 20) AS high FROM q /* FROM m */""",
)
def quantize_words(spark: SparkSession, d: str) -> DataFrame:
    return detail.packed(detail.batched(tr.with_morton(points(spark, d)).withColumn("level", F.lit(0))))


@query("id parent", "SELECT id, CASE WHEN depth > 0 THEN ((greatest(depth - 1, 0)::BIGINT << 57) | ((nx >> 1) << 38) | ((ny >> 1) << 19) | (nz >> 1))::BIGINT ELSE -1 END AS parent FROM n")
def chunk_id_parent(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).select("id", F.coalesce(bits.parent_id(F.col("id")), F.lit(-1)).alias("parent"))


@query("depth nodes slots nodes_to slots_to", "WITH h AS (SELECT depth, count(*) AS nodes, sum(ceil(point_count / 10240.0))::BIGINT AS slots FROM n GROUP BY depth) ;; SELECT depth, nodes, slots, sum(nodes) OVER (ORDER BY depth)::BIGINT AS nodes_to, sum(slots) OVER (ORDER BY depth)::BIGINT AS slots_to FROM h /* FROM n */")
def depth_histogram(spark: SparkSession, d: str) -> DataFrame:
    return detail.depth_histogram(nodes(spark, d))


@query("bucket nodes cumulative* point_share*", "WITH h AS (SELECT floor(log2(point_count))::INT AS bucket, count(*) AS nodes FROM n GROUP BY 1) ;; SELECT bucket, nodes, 100.0 * sum(nodes) OVER (ORDER BY bucket) / sum(nodes) OVER () AS cumulative, 100.0 * nodes * 2.0 ** bucket * 1.5 / sum(nodes * 2.0 ** bucket * 1.5) OVER () AS point_share FROM h /* FROM n */")
def size_histogram(spark: SparkSession, d: str) -> DataFrame:
    return detail.size_histogram(nodes(spark, d))


_SEEN = '0.05 * "maxX" - 1.25 + 1 >= 0 AND 1 - 0.05 * "minX" + 1.25 >= 0 AND 0.04 * "maxY" - 1.8 + 1 >= 0 AND 1 - 0.04 * "minY" + 1.8 >= 0 AND "maxZ" / 12 >= 0 AND 1 - "minZ" / 12 >= 0'


@query("id depth", f"SELECT * FROM n WHERE {_SEEN}")
def frustum_nodes(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).where(filters.frustum_boxes(VIEW))


_SCORE = f"c AS (SELECT *, {_SEEN} AS visible, 1 / (1 + abs(log2(greatest(extent * 10 / 256.0, 1e-12)))) AS score FROM n)"
CAMERA = detail.View(VIEW, (25.0, 45.0, 20.0), 10.0)


@query("id visible score*", f"WITH {_SCORE} ;; SELECT id, visible, score FROM c ORDER BY score DESC, id LIMIT 40 /* FROM n */")
def sse_score_topk(spark: SparkSession, d: str) -> DataFrame:
    return detail.candidates(nodes(spark, d), [CAMERA]).orderBy(F.desc("score"), "id").limit(40)


@query("demand", f"WITH {_SCORE} ;; SELECT sum(ceil(point_count / 10240.0))::BIGINT AS demand FROM c WHERE visible /* FROM n */")
def demand_slots(spark: SparkSession, d: str) -> DataFrame:
    return detail.demand(detail.candidates(nodes(spark, d), [CAMERA]))


@query("id", "SELECT id FROM n WHERE depth = 0 OR ((greatest(depth - 1, 0)::BIGINT << 57) | ((nx >> 1) << 38) | ((ny >> 1) << 19) | (nz >> 1))::BIGINT IN (SELECT id FROM n WHERE depth <= 1)")
def parent_lookup(spark: SparkSession, d: str) -> DataFrame:
    df = nodes(spark, d)
    return detail.parents(df, df.where("depth <= 1"))


@query("cx cy cz n level", 'WITH c AS (SELECT floor("X" / 8)::BIGINT AS cx, floor("Y" / 8)::BIGINT AS cy, floor("Z" / 8)::BIGINT AS cz, count(*) AS n FROM p GROUP BY 1, 2, 3) ;; SELECT *, CASE WHEN n <= 10 THEN 10 WHEN n <= 50 THEN 7 WHEN n <= 100 THEN 5 WHEN n <= 500 THEN 3 ELSE 0 END AS level FROM c /* FROM p */')
def level_cells(spark: SparkSession, d: str) -> DataFrame:
    return detail.cells_at(points(spark, d), 3, 64.0).withColumn("level", detail.distance_level(F.col("n")))


_STEP = lambda n: f"""t{n + 1} AS (SELECT * EXCLUDE (level), CASE WHEN level IS NULL AND row_number() OVER (PARTITION BY level IS NULL, floor(x / (side / {64 * 2**n})), floor(y / (side / {64 * 2**n})), floor(z / (side / {64 * 2**n})) ORDER BY pid) = 1 THEN {n} ELSE level END AS level FROM t{n})"""


@query("pid level", f"""WITH b AS (SELECT min("X") AS ax, min("Y") AS ay, min("Z") AS az, greatest(max("X") - min("X"), max("Y") - min("Y"), max("Z") - min("Z")) * 1.000001::DOUBLE AS side FROM p), t0 AS (SELECT pid, "X" - ax AS x, "Y" - ay AS y, "Z" - az AS z, side, NULL::INT AS level FROM p, b), {", ".join(map(_STEP, range(4)))} ;;
SELECT pid, coalesce(level, 4) AS level FROM t4 /* FROM p */""")
def octree_levels(spark: SparkSession, d: str) -> DataFrame:
    return detail.octree(points(spark, d), 4)


@query(
    "cluster ord id",
    """WITH RECURSIVE o AS (SELECT id, point_count * 17 AS size, row_number() OVER (ORDER BY depth, id) - 1 AS k FROM n), f AS (SELECT *, coalesce(sum(size + CASE WHEN k % 5 = 4 THEN 300000 ELSE 1000 END) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM o),
s(k, cluster, ord, begin_, end_, id) AS (SELECT 0::BIGINT, 0, 0, off, off + size, id FROM f WHERE k = 0 UNION ALL
 SELECT k, CASE WHEN near THEN cluster ELSE cluster + 1 END, CASE WHEN near THEN ord + 1 ELSE 0 END, CASE WHEN near THEN begin_ ELSE off END, CASE WHEN near THEN greatest(end_, off + size) ELSE off + size END, fid
 FROM (SELECT f.k, cluster, ord, begin_, end_, f.id AS fid, f.off, f.size, f.off - end_ <= 262144 AND ord < 7 AND greatest(end_, f.off + f.size) - begin_ <= 16777216 AS near FROM s JOIN f ON f.k = s.k + 1)) ;; SELECT cluster, ord, id FROM s /* FROM n */""",
)
def prefetch_clusters(spark: SparkSession, d: str) -> DataFrame:
    rows = nodes(spark, d).orderBy("depth", "id").select("id", "point_count").collect()  # metadata: a row a node
    offset, items = 0, []
    for k, r in enumerate(rows):
        items.append((r.id, offset, int(r.point_count) * 17))
        offset += int(r.point_count) * 17 + (300_000 if k % 5 == 4 else 1000)
    groups = detail.prefetch_clusters(items)
    return spark.createDataFrame([(c, k, i) for c, g in enumerate(groups) for k, i in enumerate(g)], "cluster int, ord int, id long")


@query("source_id tick action id ord settled demand")
def residency_ticks(spark: SparkSession, d: str) -> DataFrame:
    import json

    near, far = [{"matrix": VIEW, "pixel_scale": 10.0}], [{"matrix": [0.2, 0, 0, -2.0, 0, 0.1, 0, -4.0, 0, 0, 1 / 12, 0, 0, 0, 0, 1], "pixel_scale": 40.0}]
    rows = [(s, t, json.dumps(near if t < 4 else far if t < 14 else []), 12 + 4 * k, None) for k, s in enumerate("ab") for t in range(16)]
    ticks = spark.createDataFrame(rows, "source_id string, tick long, views string, budget_slots int, control string")
    return residency.residency_batch(ticks, nodes(spark, d))


# --- sources, whole programs ----------------------------------------------------------------


@query("pid X* Y* Z* GpsTime*", "SELECT i + 1 AS pid, 10.0 * i / 999 AS \"X\", -5 + 10.0 * i / 999 AS \"Y\", 2.0::DOUBLE * i / 999 AS \"Z\", i::DOUBLE AS \"GpsTime\" FROM (SELECT unnest(range(1000)) AS i)")
def faux_ramp(spark: SparkSession, d: str) -> DataFrame:
    return formats.faux(spark, 1000, "ramp", [[0, -5, 0], [10, 5, 2]])


@query("pid X* Y* Z*", "SELECT i + 1 AS pid, (i % 10)::DOUBLE AS \"X\", (i // 10 % 20)::DOUBLE AS \"Y\", (i // 200)::DOUBLE AS \"Z\" FROM (SELECT unnest(range(1000)) AS i)")
def faux_grid(spark: SparkSession, d: str) -> DataFrame:
    return formats.faux(spark, 1000, "grid", [[0, 0, 0], [10, 20, 5]])


@query("q r n density*", """WITH h AS (SELECT "X" * (2.0::DOUBLE / 3) / 8 AS fq, ("Y" * sqrt(3) / 3 - "X" / 3) / 8 AS fr FROM p), i AS (SELECT *, floor(fq + 0.5) AS rq, floor(fr + 0.5) AS rr, floor(-fq - fr + 0.5) AS rs FROM h),
j AS (SELECT *, abs(rq - fq) AS dq, abs(rr - fr) AS dr, abs(rs + fq + fr) AS ds FROM i), c AS (SELECT (CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END)::BIGINT AS q, (CASE WHEN dq > dr AND dq > ds THEN rr WHEN dr > ds THEN -rq - rs ELSE rr END)::BIGINT AS r, count(*) AS n FROM j GROUP BY 1, 2) ;; SELECT *, n / (1.5 * sqrt(3) * 64) AS density FROM c /* FROM p */""")
def density(spark: SparkSession, d: str) -> DataFrame:
    return kernels.density(points(spark, d), 8.0)


@query("pid Z*", 'SELECT pid, CASE WHEN "X" > 25 THEN "Z" + 1 ELSE "Z" END AS "Z" FROM p')
def conditional_stage(spark: SparkSession, d: str) -> DataFrame:
    """A stage with ``where``: points that fail it pass by."""
    spec = {"pipeline": [{"type": "filters.assign", "value": "Z = Z + 1", "where": "X > 25"}]}
    return Pipeline.from_json(spec).plan(spark, points(spark, d))


@query("pid half*", 'SELECT pid, "X" / 2 AS half FROM p')
def stream_callback(spark: SparkSession, d: str) -> DataFrame:
    import pyarrow.compute as pc

    return sorting.callback(points(spark, d).select(PID, "X"), lambda b: {PID: b[PID], "half": pc.divide(b["X"], 2.0)}, f"{PID} long, half double")
