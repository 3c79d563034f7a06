"""Registered queries over readers, writers and whole programs: what is written to the shared folder is read back and compared."""

from __future__ import annotations

import json
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import geometry as geo
from plumbline.operators import detail
from plumbline.operators import transforms as tr
from plumbline.operators.materialise import scratch
from plumbline.operators.order import PID
from plumbline.plans import kernels
from plumbline.plans.queries import _OPENED, _STEP, _SURFACE, cloud, placed, points, query, surface_cloud
from plumbline.sources import formats
from plumbline.types import schema_summary


def plain(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).select(PID, *geo.XYZ, F.col(PID).alias("id"), "Classification")


def first_of(spark: SparkSession, columns: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), columns)


# --- files of points -----------------------------------------------------------------

_SAME = 'SELECT pid AS id, "X", "Y", "Z", "Classification" FROM p'


@query("id X* Y* Z* Classification", _SAME)
def text_file(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "points.txt")
    formats.write_text(plain(spark, d), path, order="X:6,Y:6,Z:6,id,Classification")
    return formats.read_text(spark, path).withColumns({c: F.col(c).cast("long" if c == "id" else "int") for c in ("id", "Classification")})


@query("id X* Y* Z* Classification", _SAME)
def ply_file(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "points.ply")
    formats.write_ply(plain(spark, d), path)
    return formats.read_ply(spark, path).withColumns({c: F.col(c).cast("long" if c == "id" else "int") for c in ("id", "Classification")})


@query("id X* Y* Z* Classification", _SAME)
def pcd_file(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "points.pcd")
    formats.write_pcd(plain(spark, d), path)
    return formats.read_pcd(spark, path).withColumns({c: F.col(c).cast("long" if c == "id" else "int") for c in ("id", "Classification")})


@query(
    "id X* Y* Z* Classification ReturnNumber NumberOfReturns PointSourceId",
    """WITH o AS (SELECT min("X") AS ax, min("Y") AS ay, min("Z") AS az FROM p) ;; SELECT pid AS id, ax + floor(("X" - ax) / 0.001::DOUBLE + 0.5) * 0.001::DOUBLE AS "X", ay + floor(("Y" - ay) / 0.001::DOUBLE + 0.5) * 0.001::DOUBLE AS "Y", az + floor(("Z" - az) / 0.001::DOUBLE + 0.5) * 0.001::DOUBLE AS "Z",
 "Classification", ("ReturnNumber" % 8)::INT AS "ReturnNumber", ("NumberOfReturns" % 8)::INT AS "NumberOfReturns", ("PointSourceId" % 60000)::INT AS "PointSourceId" FROM p, o""",
)
def las_file(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "points.las")
    df = points(spark, d).select(PID, *geo.XYZ, "Classification", (F.col("ReturnNumber") % 8).alias("ReturnNumber"), (F.col("NumberOfReturns") % 8).alias("NumberOfReturns"), (F.col("PointSourceId") % 60000).alias("PointSourceId"), F.col(PID).cast("double").alias("GpsTime"))
    formats.write_las(df, path)
    back = formats.read_las(spark, path).withColumn("id", F.col("GpsTime").cast("long"))
    return back.withColumns({c: F.col(c).cast("int") for c in ("Classification", "ReturnNumber", "NumberOfReturns", "PointSourceId")})


@query("id X* Y* Z*", 'SELECT pid AS id, "X", "Y", "Z" FROM p')
def geojson_file(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "points.geojson")
    formats.write_text(plain(spark, d).select(*geo.XYZ, "id"), path, format="geojson")
    back = spark.read.schema("geometry struct<coordinates: array<double>>, properties struct<id: long>").json(path)
    return back.select("properties.id", *[F.element_at("geometry.coordinates", k + 1).alias(c) for k, c in enumerate(geo.XYZ)])


@query("value", """SELECT 'POINT Z (' || "X"::VARCHAR || ' ' || "Y"::VARCHAR || ' ' || "Z"::VARCHAR || ')' AS value FROM p""")
def ogr_file(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "points.wkt")
    formats.write_wkt(points(spark, d), path)
    return spark.read.text(path)


@query("i j count min* max* mean*", 'SELECT floor("X" / 5)::BIGINT AS i, floor("Y" / 5)::BIGINT AS j, count(*) AS count, min("Z") AS min, max("Z") AS max, avg("Z") AS mean FROM p GROUP BY 1, 2')
def raster_file(spark: SparkSession, d: str) -> DataFrame:
    path, again = scratch(spark, "raster"), scratch(spark, "cells")
    formats.write_raster(points(spark, d), path, 5.0, bin_mode=True)
    formats.write_cells(spark.read.parquet(path), again)
    return spark.read.parquet(again)


_OCTREE = f"""b AS (SELECT min("X") AS ax, min("Y") AS ay, min("Z") AS az, greatest(max("X") - min("X"), max("Y") - min("Y"), max("Z") - min("Z")) * 1.000001::DOUBLE AS side FROM p), t0 AS (SELECT pid, "X" AS own, "X" - ax AS x, "Y" - ay AS y, "Z" - az AS z, side, NULL::INT AS level FROM p, b), {", ".join(map(_STEP, range(4)))}"""


@query("pid level X*", f'WITH {_OCTREE} ;; SELECT pid, coalesce(level, 4) AS level, own AS "X" FROM t4 /* FROM p */')
def octree_file(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "points.copc")
    formats.write_octree(points(spark, d), path, 4)
    return formats.read_octree(spark, path)


@query("pid level X*", f'WITH {_OCTREE} ;; SELECT t4.pid, level, own AS "X" FROM t4 JOIN p ON p.pid = t4.pid WHERE level <= 2 AND own BETWEEN 10 AND 30 AND p."Y" BETWEEN 0 AND 60 AND p."Z" BETWEEN 0 AND 5')
def octree_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Levels down to a resolution (spacing 16, wanted 5: two halvings) within a box."""
    path = scratch(spark, "points.copc")
    formats.write_octree(points(spark, d), path, 4)
    return formats.read_octree(spark, path, 5.0, 16.0, [[10, 0, 0], [30, 60, 5]])


@query("pid tx ty Height*", 'SELECT pid, floor("X" / 20)::BIGINT AS tx, floor("Y" / 20)::BIGINT AS ty, "Z" * 2 AS "Height" FROM p WHERE (tx = 0 AND ty = 1) OR (tx = 1 AND ty = 2)')
def tile_files(spark: SparkSession, d: str) -> DataFrame:
    """Tiles of a tiled dataset, and a dimension from a side table."""
    path, side = scratch(spark, "tiles"), scratch(spark, "height")
    df = points(spark, d)
    kernels.tile(df, path, 20.0)
    formats.write_addon(df.withColumn("Height", F.col("Z") * 2), side, "Height")
    return formats.read_tiles(spark, path, [(0, 1), (1, 2)], {"Height": side}).withColumns({c: F.col(c).cast("long") for c in ("tx", "ty")})


def _halves(spark: SparkSession, d: str) -> tuple[str, str]:
    low, high = scratch(spark, "low.parquet"), scratch(spark, "high.parquet")
    df = points(spark, d)
    df.where("X <= 25").coalesce(1).write.parquet(low)
    df.where("X > 25").coalesce(1).write.parquet(high)
    return low, high


@query("count minx* maxx* miny* maxz*", 'SELECT count(*) AS count, min("X") AS minx, max("X") AS maxx, min("Y") AS miny, max("Z") AS maxz FROM p GROUP BY "X" <= 25')
def file_index(spark: SparkSession, d: str) -> DataFrame:
    return formats.tile_index(spark, *_halves(spark, d))


@query("pid X*", 'SELECT pid, "X" FROM p WHERE "X" BETWEEN 30 AND 40 AND "Y" BETWEEN 20 AND 50')
def index_read(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "index")
    formats.tile_index(spark, *_halves(spark, d)).write.parquet(path)
    return formats.read_index(spark, path, [[30, 20], [40, 50]])


@query("pid X*", 'SELECT pid, "X" FROM p WHERE "X" > 25')
def stac_read(spark: SparkSession, d: str) -> DataFrame:
    low, high = _halves(spark, d)
    items = [{"id": n, "bbox": [a, 0, b, 200], "properties": {"datetime": when}, "assets": {"data": {"href": path}}} for n, a, b, when, path in (("low", 0, 25, "2020-01-01", low), ("high", 26, 60, "2021-01-01", high))]
    path = scratch(spark, "catalogue.json")
    first_of(spark, "value string", (json.dumps({"type": "FeatureCollection", "features": items}),)).coalesce(1).write.text(path)
    return formats.read_stac(spark, path, dates=[("2020-06-01", "2022-01-01")], bounds=[[28, 0], [70, 100]])


def _text(spark: SparkSession, name: str, head: list[str], lines: DataFrame) -> str:
    """One text file of a head and lines (n, value) in order."""
    path = scratch(spark, name)
    formats._one_file(first_of(spark, "n long, value string", *[(k - len(head), v) for k, v in enumerate(head)]) if head else lines.where("false"), lines, path)
    return path


def _row(df: DataFrame, *parts: F.Column) -> DataFrame:
    return df.select(F.col(PID).alias("n"), F.concat_ws(" ", *parts).alias("value"))


@query("id X* Y* Z* Red", 'SELECT pid AS id, "X", "Y", "Z", "Classification" AS "Red" FROM e')
def pts_file(spark: SparkSession, d: str) -> DataFrame:
    df = cloud(spark, d)
    path = _text(spark, "points.pts", [str(df.count())], _row(df, *geo.XYZ, PID, "Classification", F.lit("0"), F.lit("0")))
    return formats.read_pts(spark, path).select(F.col("Intensity").cast("long").alias("id"), *geo.XYZ, F.col("Red").cast("int").alias("Red"))


@query("Intensity X* Y* Z* Red", """SELECT (pid % 4000)::INT AS "Intensity", -"Y" + 10 AS "X", "X" + 20 AS "Y", "Z" + 30 AS "Z", "Classification" AS "Red" FROM e""")
def ptx_file(spark: SparkSession, d: str) -> DataFrame:
    """A scan that is turned by a right angle and shifted, with a point without return."""
    df = cloud(spark, d)
    head = [str(df.count() + 1), "1", "10 20 30", "0 1 0", "-1 0 0", "0 0 1", "0 1 0 0", "-1 0 0 0", "0 0 1 0", "10 20 30 1", "0 0 0 0.5 0 0 0"]
    path = _text(spark, "points.ptx", head, _row(df, *geo.XYZ, ((F.col(PID) % 4000) / 4095).cast("string"), "Classification", F.lit("0"), F.lit("0")))
    return formats.read_ptx(spark, path)


@query("X* Y* Z*", 'SELECT "X", "Y", "Z" FROM e')
def obj_file(spark: SparkSession, d: str) -> DataFrame:
    path = _text(spark, "mesh.obj", ["# a mesh", "o cloud"], _row(cloud(spark, d), F.lit("v"), *geo.XYZ))
    return formats.read_obj(spark, path)


@query("a b c", "SELECT pid AS a, pid + 1 AS b, pid + 2 AS c FROM e WHERE pid > 0 UNION ALL SELECT pid, pid + 2, pid + 3 FROM e WHERE pid > 0")
def obj_faces(spark: SparkSession, d: str) -> DataFrame:
    """Faces of four corners, as fans of triangles."""
    path = _text(spark, "mesh.obj", [], _row(cloud(spark, d).where("pid > 0"), F.lit("f"), PID, F.concat(F.col(PID) + 1, F.lit("/1/1")), F.col(PID) + 2, F.col(PID) + 3))
    return formats.read_obj_faces(spark, path)


@query("id X* Y* Z*", 'SELECT pid AS id, "X" + 1 AS "X", "Y" + 1 AS "Y", "Z" + 1 AS "Z" FROM e UNION ALL SELECT pid, "X" + 2, "Y" + 2, "Z" + 2 FROM e')
def ilvis2_file(spark: SparkSession, d: str) -> DataFrame:
    """Lowest and highest modes of each shot."""
    columns = [F.lit("7"), F.col(PID), F.lit("0.5"), *geo.XYZ, *[F.col(c) + 1 for c in geo.XYZ], *[F.col(c) + 2 for c in geo.XYZ]]
    path = _text(spark, "shots.txt", ["# LFID SHOT TIME ..."], _row(cloud(spark, d), *columns))
    return formats.read_ilvis2(spark, path, "ALL").select(F.col("ShotNumber").cast("long").alias("id"), *geo.XYZ)


def _binary(spark: SparkSession, name: str, names: list[str]) -> str:
    """A trajectory of 100 records whose field k of record i is i + k / 100."""
    path = scratch(spark, name)
    formats.put_bytes(path, "part.bin", b"".join(struct.pack(f"<{len(names)}d", *[i + k / 100 for k in range(len(names))]) for i in range(100)))
    return path


@query("GpsTime* X* Y* Z* Azimuth*", 'SELECT i::DOUBLE AS "GpsTime", degrees(i + 0.02) AS "X", degrees(i + 0.01) AS "Y", i + 0.03 AS "Z", degrees(i + 0.09) AS "Azimuth" FROM (SELECT unnest(range(100)) AS i)')
def sbet_file(spark: SparkSession, d: str) -> DataFrame:
    return formats.read_sbet(spark, _binary(spark, "path.sbet", formats.SBET))


@query("GpsTime* NorthPositionRMS* HeadingRMS*", 'SELECT i::DOUBLE AS "GpsTime", i + 0.01 AS "NorthPositionRMS", i + 0.09 AS "HeadingRMS" FROM (SELECT unnest(range(100)) AS i)')
def smrmsg_file(spark: SparkSession, d: str) -> DataFrame:
    return formats.read_smrmsg(spark, _binary(spark, "path.smrmsg", formats.SMRMSG))


@query("pid X* Y* Intensity", 'SELECT k + 1 AS pid, (k % 30)::DOUBLE AS "X", (k // 30)::DOUBLE AS "Y", k * 3 AS "Intensity" FROM (SELECT unnest(range(600)) AS k)')
def array_rows(spark: SparkSession, d: str) -> DataFrame:
    return formats.read_array(spark, (np.arange(600) * 3).reshape(20, 30))


@query("pid X* Y* Intensity", 'SELECT k + 1 AS pid, (k // 20)::DOUBLE AS "X", (k % 20)::DOUBLE AS "Y", ((k % 20) * 30 + k // 20) * 3 AS "Intensity" FROM (SELECT unnest(range(600)) AS k)')
def array_columns(spark: SparkSession, d: str) -> DataFrame:
    return formats.read_array(spark, (np.arange(600) * 3).reshape(20, 30), "column")


@query("pid X* Y* Z* ReturnNumber NumberOfReturns", 'SELECT k + 1 AS pid, 3.0::DOUBLE AS "X", 4.0::DOUBLE AS "Y", 5.0::DOUBLE AS "Z", (k % 4 + 1)::SMALLINT AS "ReturnNumber", 4::SMALLINT AS "NumberOfReturns" FROM (SELECT unnest(range(500)) AS k)')
def faux_constant(spark: SparkSession, d: str) -> DataFrame:
    return formats.faux(spark, 500, "constant", [[3, 4, 5], [6, 7, 8]], number_of_returns=4)


@query("n inside spread", "SELECT 5000 AS n, true AS inside, true AS spread")
def faux_uniform(spark: SparkSession, d: str) -> DataFrame:
    """Within the bounds, and in each tenth of X about as many."""
    df = kernels.random(spark, 5000, [[1, 2, 3], [11, 4, 3.5]], seed=5)
    tenths = df.groupBy(F.floor("X").alias("t")).agg(F.count(F.lit(1)).alias("n"), F.min(geo.box_contains([1, 2, 3], [11, 4, 3.5])).alias("ok"))
    return tenths.agg(F.sum("n").cast("int").alias("n"), F.min("ok").alias("inside"), ((F.min("n") > 400) & (F.max("n") < 600) & (F.count(F.lit(1)) == 10)).alias("spread"))


@query("n middle width", "SELECT 5000 AS n, true AS middle, true AS width")
def faux_normal(spark: SparkSession, d: str) -> DataFrame:
    df = formats.faux(spark, 5000, "normal", mean=(10, 20, 30), stdev=(1, 2, 3))
    return df.agg(F.count(F.lit(1)).cast("int").alias("n"), ((F.abs(F.avg("X") - 10) < 0.1) & (F.abs(F.avg("Z") - 30) < 0.3)).alias("middle"), ((F.abs(F.stddev("Y") - 2) < 0.1) & (F.abs(F.stddev("Z") - 3) < 0.15)).alias("width"))


# --- what is inferred ------------------------------------------------------------------

_READERS = [("a.las", "readers.las"), ("b.LAZ", "readers.las"), ("c.copc.laz", "readers.copc"), ("d.ply", "readers.ply"), ("e.txt", "readers.text"), ("f.pcd", "readers.pcd")]


@query("path reader", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _READERS) + ") AS t(path, reader)")
def readers_inferred(spark: SparkSession, d: str) -> DataFrame:
    return first_of(spark, "path string, reader string", *[(p, formats.reader_for(p)) for p, _ in _READERS])


@query("path writer extras", """SELECT * FROM (VALUES ('a.las', 'writers.las', '{"offset_x": "auto", "offset_y": "auto", "offset_z": "auto", "scale_x": 0.001, "scale_y": 0.001, "scale_z": 0.001}'), ('b.ply', 'writers.ply', '{}'), ('c.txt', 'writers.text', '{}')) AS t(path, writer, extras)""")
def writers_inferred(spark: SparkSession, d: str) -> DataFrame:
    return first_of(spark, "path string, writer string, extras string", *[(p, formats.writer_for(p), json.dumps(formats.writer_extras(p), sort_keys=True)) for p in ("a.las", "b.ply", "c.txt")])


@query("sample columns sep skip", """SELECT * FROM (VALUES ('1 2 3', 'X Y Z', ' ', 0), ('X,Y,Z,Red', 'X Y Z Red', ',', 1), ('# c', 'X Y Z', ' ', 1)) AS t(sample, columns, sep, skip)""")
def text_layouts(spark: SparkSession, d: str) -> DataFrame:
    samples = {"1 2 3": "1 2 3\n4 5 6", "X,Y,Z,Red": "X,Y,Z,Red\n1,2,3,4", "# c": "# c\n1 2 3"}
    return first_of(spark, "sample string, columns string, sep string, skip int", *[(k, " ".join((x := formats.text_layout(v))["columns"]), x["sep"], x["skip"]) for k, v in samples.items()])


@query("header points", "SELECT * FROM (VALUES ('legacy', 1234), ('both', 5000000000), ('no 64 bits', 1234)) AS t(header, points)")
def las_header_points(spark: SparkSession, d: str) -> DataFrame:
    def header(minor: int, legacy: int, count: int) -> bytes:
        out = bytearray(375)
        out[:4], out[25] = b"LASF", minor
        struct.pack_into("<I", out, 107, legacy)
        struct.pack_into("<Q", out, 247, count)
        return bytes(out)

    cases = {"legacy": header(2, 1234, 99), "both": header(4, 0, 5_000_000_000), "no 64 bits": header(4, 1234, 0)}
    return first_of(spark, "header string, points long", *[(k, formats.las_points(v)) for k, v in cases.items()])


@query("name storage", "SELECT * FROM (VALUES ('pid', 'signed'), ('X', 'floating'), ('Classification', 'signed')) AS t(name, storage)")
def schema_rows(spark: SparkSession, d: str) -> DataFrame:
    found = schema_summary(points(spark, d).select(PID, "X", "Classification").schema)
    return first_of(spark, "name string, storage string", *[(r["name"], r.get("storage") or r.get("type")) for r in found])


@query("target extension source gate", "SELECT * FROM (VALUES ('EPSG:3857', 'laz', 'EPSG:4326', true), ('EPSG:3857', 'ply', 'EPSG:4326', false), ('', 'laz', 'EPSG:4326', false), ('EPSG:3857', 'laz', '', false)) AS t(target, extension, source, gate)")
def reprojection_gate(spark: SparkSession, d: str) -> DataFrame:
    cases = [("EPSG:3857", "laz", "EPSG:4326"), ("EPSG:3857", "ply", "EPSG:4326"), ("", "laz", "EPSG:4326"), ("EPSG:3857", "laz", "")]
    return first_of(spark, "target string, extension string, source string, gate boolean", *[(*c, tr.reprojects(*c)) for c in cases])


# --- whole programs, layouts -----------------------------------------------------------------


@query("pid ordinal", "SELECT pid, row_number() OVER (ORDER BY morton, pid) - 1 AS ordinal FROM m")
def sort_kernel(spark: SparkSession, d: str) -> DataFrame:
    return placed(kernels.sort(points(spark, d)), "sort-kernel")


@query("view_id n first*", "SELECT (pid - 1) // 7000 AS view_id, count(*) AS n, min(pid) AS first FROM p GROUP BY 1")
def split_kernel(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "split")
    kernels.split(points(spark, d), path, capacity=7000)
    return spark.read.parquet(path).groupBy(F.col("view_id").cast("long").alias("view_id")).agg(F.count(F.lit(1)).alias("n"), F.min(PID).alias("first"))


@query("tx ty n", 'SELECT floor(("X" - 3) / 15)::BIGINT AS tx, floor(("Y" - 1) / 15)::BIGINT AS ty, count(*) AS n FROM p GROUP BY 1, 2')
def tile_kernel(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "tiles")
    kernels.tile(points(spark, d), path, 15.0, 3.0, 1.0)
    return spark.read.parquet(path).groupBy(F.col("tx").cast("long").alias("tx"), F.col("ty").cast("long").alias("ty")).agg(F.count(F.lit(1)).alias("n"))


@query("id X* Y*", 'SELECT pid AS id, "X", "Y" FROM p WHERE "X" BETWEEN 10 AND 20')
def translate_kernel(spark: SparkSession, d: str) -> DataFrame:
    source, target = scratch(spark, "in.txt"), scratch(spark, "out.parquet")
    formats.write_text(plain(spark, d), source, order="X:6,Y:6,Z:6,id")
    kernels.translate(spark, source, target, [{"type": "filters.range", "limits": "X[10:20]"}])
    return spark.read.parquet(target).withColumn("id", F.col("id").cast("long"))


@query("count average* boundary nearest", """SELECT count(*) AS count, avg("X") AS average, any_value('x') IS NOT NULL AS boundary, (SELECT pid FROM p ORDER BY ("X" - 20) ** 2 + ("Y" - 30) ** 2 + ("Z" - 5) ** 2, pid LIMIT 1) AS nearest FROM p""")
def info_kernel(spark: SparkSession, d: str) -> DataFrame:
    found = kernels.info(points(spark, d), points=[1], query=[20.0, 30.0, 5.0, 1])
    x = next(r for r in found["stac"]["pc:statistics"] if r["name"] == "X")
    return first_of(spark, "count long, average double, boundary boolean, nearest long", (x["count"], x["average"], found["boundary"].startswith("POLYGON"), found["nearest"][0][PID]))


@query("pid", f"""WITH {_SURFACE}, c AS (SELECT *, floor("X" / 2)::BIGINT AS i, floor("Y" / 2)::BIGINT AS j FROM s), g0 AS (SELECT i, j, min("Z") AS h FROM c GROUP BY i, j), {_OPENED(0, 1, 1)}, {_OPENED(1, 2, 2)} ;;
SELECT pid FROM c JOIN g1 USING (i, j) JOIN g2 USING (i, j) WHERE "Z" - g1.h < 0.15::DOUBLE AND "Z" - g2.h < 2.5::DOUBLE /* FROM p */""")
def ground_kernel(spark: SparkSession, d: str) -> DataFrame:
    return kernels.ground(surface_cloud(spark, d), "pmf", low_noise=False, extract=True, cell_size=2.0, max_window_size=5)


@query("pid X* px* pz*", """WITH b AS (SELECT (min("X") + max("X")) / 2 AS cx, (min("Z") + max("Z")) / 2 AS cz FROM p) ;; SELECT pid, "X"::FLOAT AS "X", ("X" - cx)::FLOAT AS px, ("Z" - cz)::FLOAT AS pz FROM p, b""")
def deinterleave(spark: SparkSession, d: str) -> DataFrame:
    out = tr.soa(points(spark, d).select(PID, *geo.XYZ))
    return out.select(PID, "X", F.element_at("position", 1).alias("px"), F.element_at("position", 3).alias("pz"))


@query("pid batch Intensity*", 'SELECT pid, (row_number() OVER (ORDER BY morton, pid) - 1) // 10240 AS batch, "Intensity"::FLOAT AS "Intensity" FROM m')
def packed_scalars(spark: SparkSession, d: str) -> DataFrame:
    return detail.packed(detail.batched(tr.with_morton(points(spark, d)).withColumn("level", F.lit(0))), ["Intensity"])


@query("bytes dims slots backlog", "SELECT b AS bytes, d AS dims, greatest(1, b // (10240 * (17 + 4 * d)))::BIGINT AS slots, least(greatest(b // 4, 67108864), 536870912)::BIGINT AS backlog FROM (VALUES (1000::BIGINT, 0), (104857600, 2), (8589934592, 5)) AS t(b, d)")
def byte_budgets(spark: SparkSession, d: str) -> DataFrame:
    return first_of(spark, "bytes long, dims int, slots long, backlog long", *[(b, n, detail.budget_slots(b, n), detail.backlog_bytes(b)) for b, n in ((1000, 0), (100 << 20, 2), (8 << 30, 5))])


_WEEKS = {"gt2gst": '"GpsTime" - 1e9::DOUBLE', "gst2gt": '"GpsTime" + 1e9::DOUBLE', "gt2ws": '"GpsTime" - floor("GpsTime" / 604800) * 604800', "gst2ws": '"GpsTime" + 1e9::DOUBLE - floor(("GpsTime" + 1e9::DOUBLE) / 604800) * 604800'}


@query("pid " + " ".join(f"{c}*" for c in _WEEKS), "SELECT pid, " + ", ".join(f"{v} AS {c}" for c, v in _WEEKS.items()) + " FROM p")
def gps_conversions(spark: SparkSession, d: str) -> DataFrame:
    out = points(spark, d).withColumn("t", F.col("GpsTime"))
    for c in _WEEKS:
        out = tr.convert_gps_time(out.withColumn("GpsTime", F.col("t")), c).withColumn(c, F.col("GpsTime"))
    return out


@query("pair meet apart inside", "SELECT * FROM (VALUES ('far', false, true, false), ('over', true, false, false), ('within', true, false, true)) AS t(pair, meet, apart, inside)")
def polygon_relations(spark: SparkSession, d: str) -> DataFrame:
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    pairs = {"far": (square(0, 0, 1), square(5, 5, 1)), "over": (square(0, 0, 2), square(1, 1, 2)), "within": (square(1, 1, 1), square(0, 0, 4))}
    return first_of(spark, "pair string, meet boolean, apart boolean, inside boolean", *[(k, geo.intersects(a, b), geo.disjoint(a, b), geo.within(a, b)) for k, (a, b) in pairs.items()])


# --- projections, overlays, functions ------------------------------------------------------

_E, _RADIUS, _ALPHA, _, _ = tr._third(tr.FLATTENING)
_UTM = f"""t AS (SELECT pid, radians("X" - 15) AS l, sinh(atanh(sin(radians("Y"))) - {_E!r} * atanh({_E!r} * sin(radians("Y")))) AS t FROM p WHERE "X" BETWEEN 9 AND 21 AND "Y" < 80),
u AS (SELECT pid, atan2(t, cos(l)) AS n, atanh(sin(l) / sqrt(1 + t * t)) AS m FROM t)"""


@query("pid x_km* y_km*", f"""WITH {_UTM} ;; SELECT pid, (500000 + {0.9996 * _RADIUS!r} * (m + {" + ".join(f"{a!r} * cos({2 * k} * n) * sinh({2 * k} * m)" for k, a in enumerate(_ALPHA, 1))})) / 1000 AS x_km, {0.9996 * _RADIUS!r} * (n + {" + ".join(f"{a!r} * sin({2 * k} * n) * cosh({2 * k} * m)" for k, a in enumerate(_ALPHA, 1))}) / 1000 AS y_km FROM u /* FROM p */""")
def reproject_zone(spark: SparkSession, d: str) -> DataFrame:
    """Degrees to zone 33, as far as it is used, in kilometres."""
    out = tr.reproject(points(spark, d).where("X BETWEEN 9 AND 21 AND Y < 80"), "EPSG:4326", "EPSG:32633")
    return out.select(PID, (F.col("X") / 1000).alias("x_km"), (F.col("Y") / 1000).alias("y_km"))


@query("pid X* Y*", 'SELECT pid, "X", "Y" FROM p WHERE "X" BETWEEN 9 AND 21 AND "Y" < 80')
def reproject_back(spark: SparkSession, d: str) -> DataFrame:
    """Degrees to a zone of the south, to Mercator, to a zone of the north, to degrees."""
    out = points(spark, d).where("X BETWEEN 9 AND 21 AND Y < 80")
    for a, b in (("EPSG:4326", "EPSG:32733"), ("EPSG:32733", "EPSG:3857"), ("EPSG:3857", "EPSG:32633"), ("EPSG:32633", "EPSG:4326")):
        out = tr.reproject(out, a, b)
    return out


@query("pid zone", """SELECT pid, coalesce((SELECT min(k) FROM (SELECT unnest(range(40)) AS k) WHERE p."X" BETWEEN 4 * (k % 8) + 0.5 AND 4 * (k % 8) + 6.5 AND p."Y" BETWEEN 10 * (k // 8) + 0.3 AND 10 * (k // 8) + 14.3
 AND abs(p."X" - (4 * (k % 8) + 3.5)) / 3 + abs(p."Y" - (10 * (k // 8) + 7.3)) / 7 < 1), -1)::INT AS zone FROM p""")
def overlay_many(spark: SparkSession, d: str) -> DataFrame:
    """Forty diamonds that overlap; the first that holds a point, not just on its edge, gives its number."""
    polygons = []
    for k in range(40):
        x, y = 4 * (k % 8) + 3.5, 10 * (k // 8) + 7.3
        polygons.append({"ring": [(x - 3, y), (x, y - 7), (x + 3, y), (x, y + 7)], "zone": k})
    from plumbline.operators import neighbours

    return neighbours.overlay(points(spark, d).withColumn("zone", F.lit(-1)), polygons, "zone", "zone", edges=False)


_MATHS = {"a": ("abs(X - 25)", 'abs("X" - 25)'), "b": ("ceil(Y)", 'ceil("Y")'), "c": ("floor(Y)", 'floor("Y")'), "f": ("sqrt(X)", 'sqrt("X")'), "g": ("exp(Z / 10)", 'exp("Z" / 10)'), "h": ("log(X)", 'ln("X")'), "i": ("log10(X)", 'log10("X")'), "j": ("sin(X) + cos(Y) * tan(Z)", 'sin("X") + cos("Y") * tan("Z")'), "k": ("asin(X / 60) - acos(X / 60)", 'asin("X" / 60) - acos("X" / 60)'), "l": ("atan(Y) - -Z", 'atan("Y") + "Z"')}


@query("pid " + " ".join(f"{c}*" for c in _MATHS), "SELECT pid, " + ", ".join(f"{v} AS {c}" for c, (_, v) in _MATHS.items()) + " FROM p")
def expr_functions(spark: SparkSession, d: str) -> DataFrame:
    return tr.assign(points(spark, d), [f"{c} = {v}" for c, (v, _) in _MATHS.items()])


@query("case box", "SELECT * FROM (VALUES ('grown', '[[-1.0, 0.0], [4.0, 6.0]]'), ('clipped', '[[1.0, 1.0], [3.0, 2.0]]'), ('apart', 'null'), ('ring', '[[0, 1], [3, 1], [3, 5], [0, 5], [0, 1]]')) AS t(\"case\", box)")
def box_functions(spark: SparkSession, d: str) -> DataFrame:
    found = {"grown": geo.box_grown([0.0, 1.0], [3.0, 5.0], 1.0), "clipped": geo.box_clipped([0.0, 1.0], [3.0, 5.0], [1.0, 0.0], [9.0, 2.0]), "apart": geo.box_clipped([0.0, 1.0], [3.0, 5.0], [4.0, 0.0], [9.0, 2.0]), "ring": geo.box_geojson([0, 1], [3, 5])["coordinates"][0]}
    return first_of(spark, "`case` string, box string", *[(k, json.dumps(v)) for k, v in found.items()])
