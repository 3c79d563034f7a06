"""Whole-program operations."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.geometry import XYZ, box_wkt
from plumbline.operators import aggregates as agg
from plumbline.operators import detail, neighbours, sorting, surfaces, transforms
from plumbline.plans.pipeline import Pipeline, apply_filter
from plumbline.sources import formats

chamfer, hausdorff, delta = neighbours.chamfer, neighbours.hausdorff, neighbours.delta
evaluate, tile_index = agg.evaluation, formats.tile_index


def density(df: DataFrame, edge_length: float, threshold: int = 1) -> DataFrame:
    """Hexagons with their points per area."""
    area = 1.5 * 3**0.5 * edge_length**2
    return transforms.hexbin(df, edge_length, threshold).withColumn("density", F.col("n") / area)


def ground(df: DataFrame, method: str = "smrf", low_noise: bool = True, extract: bool = False, **options: object) -> DataFrame:
    """Ground classified: low noise marked first, then pmf, smrf or csf on the rest; ``extract`` keeps ground alone."""
    if low_noise:
        df = surfaces.low_noise(df)
        noise = df.where("Classification = 7")
        df = df.where("Classification <> 7")
    out = apply_filter(df, f"filters.{method}", options)
    if extract:
        return out.where("Classification = 2")
    return out.unionByName(noise.select(out.columns)) if low_noise else out


def info(df: DataFrame, dims: Sequence[str] = XYZ, points: Sequence[int] = (), query: Sequence[float] | None = None, boundary_edge: float | None = None) -> dict:
    """Statistics, schema, summary, boundary, STAC properties, chosen points, nearest points."""
    from plumbline.operators.filters import nearest_to
    from plumbline.types import schema_summary

    out = {"schema": schema_summary(df.schema), "stac": agg.stac_properties(df, dims), "points": [r.asDict() for r in df.where(F.col("pid").isin(list(points))).collect()]}
    box = agg.bounds(df)
    out["boundary"] = box.select(box_wkt(*[F.col(c) for c in ("minx", "miny", "maxx", "maxy")]).alias("b")).first()[0]
    if query is not None:
        out["nearest"] = [r.asDict() for r in nearest_to(df, *query).collect()]
    if boundary_edge:
        out["rings"] = transforms.hex_boundary([(r.q, r.r) for r in transforms.hexbin(df, boundary_edge).select("q", "r").collect()], boundary_edge)  # a row a hexagon
    return out


def merge(*frames: DataFrame) -> DataFrame:
    return sorting.merge(frames[0], *frames[1:])


def random(spark: SparkSession, count: int, bounds: Sequence[Sequence[float]], distribution: str = "uniform", seed: int = 0, **options: object) -> DataFrame:
    return formats.faux(spark, count, distribution, bounds, seed, **options)


def sort(df: DataFrame) -> DataFrame:
    return transforms.morton_order(df)


def split(df: DataFrame, path: str, capacity: int | None = None, length: float | None = None) -> None:
    """Files of ``capacity`` points or of square tiles, as partitions."""
    if length:
        tile(df, path, length)
    else:
        agg.divide(df, capacity=capacity).write.mode("overwrite").partitionBy("view_id").parquet(path)


def tile(df: DataFrame, path: str, length: float = 1000.0, origin_x: float = 0.0, origin_y: float = 0.0, buffer: float = 0.0, out_srs: str | None = None, in_srs: str | None = None) -> None:
    if out_srs and in_srs:
        df = transforms.reproject(df, in_srs, out_srs)
    agg.split_tiles(df, length, origin_x, origin_y, buffer).repartition("tx", "ty").write.mode("overwrite").partitionBy("tx", "ty").parquet(path)


def translate(spark: SparkSession, source: str, target: str, filters: str | Sequence[dict] = ()):
    given = json.loads(filters) if isinstance(filters, str) and filters else list(filters)
    return Pipeline.from_json([source, *given, target]).execute(spark)


def carve_clouds(spark: SparkSession, spec: dict, suffix: str = "_carved") -> dict[str, int]:
    """Carves each cloud of {clouds: [{name, source, origin, meshes}]} beside its source; clouds without meshes are skipped."""
    out = {}
    for cloud in spec["clouds"]:
        if not cloud.get("meshes"):
            continue
        df = formats.READERS[formats.reader_for(cloud["source"], fallback="readers.parquet")](spark, cloud["source"])
        kept = surfaces.carve(df, cloud["meshes"], cloud.get("origin", (0, 0, 0)))
        base, _, extension = cloud["source"].rpartition(".")
        kept.write.mode("overwrite").parquet(f"{base}{suffix}.{extension}")
        out[cloud["name"]] = kept.count()
    return out


def read_nodes(df: DataFrame, depth: int = 6) -> DataFrame:
    return detail.node_table(detail.octree(df, depth))
