"""Pipelines: a reader, filters and a writer, from JSON or Python, as one DataFrame plan.

Any filter may carry ``where``, a condition: points that fail it pass the
filter by and are put back after (``where_merge`` false leaves them out).
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import plumbline.operators.aggregates as agg
import plumbline.operators.clusters  # noqa: F401  registers stages
import plumbline.operators.detail
import plumbline.operators.filters
import plumbline.operators.neighbours
import plumbline.operators.sorting
import plumbline.operators.surfaces
import plumbline.operators.transforms as tr
import plumbline.sources.formats as formats
from plumbline.functions import expression as ex
from plumbline.functions.geometry import XYZ
from plumbline.operators.order import PID
from plumbline.plans.registry import FILTERS, READERS, WRITERS, registered
from plumbline.types import schema_summary


class ConvertError(Exception):
    """A pipeline that can't be run."""


class PipelineEncodingFailed(ConvertError):
    pass


class PipelineFailed(ConvertError):
    pass


class Cancelled(ConvertError):
    pass


class DriverNotRegistered(ConvertError):
    pass


CannotInferDriver = formats.CannotInferDriver

# Status codes and what they stand for here.
STATUS = {0: None, -11: Cancelled, -12: ValueError} | dict.fromkeys(range(-10, 0), PipelineFailed)


@dataclass
class Stage:
    type: str
    options: dict = field(default_factory=dict)

    def spec(self) -> dict:
        return {"type": self.type, **self.options}


@dataclass
class ConvertOptions:
    reader: Stage | None = None
    filters: Sequence[Stage] = ()
    writer: Stage | None = None
    streaming: bool = True
    streaming_chunk_size: int = 10_000
    on_progress: Callable[[float | None], bool | None] | None = None
    point_total_hint: int | None = None
    coordinate_scale: float | None = 0.001


@dataclass
class ConvertResult:
    point_count: int
    metadata_json: str
    schema_json: str
    statistics: list | None = None


def apply_filter(df: DataFrame, name: str, options: dict) -> DataFrame:
    if name not in FILTERS:
        raise DriverNotRegistered(name)
    options = dict(options)
    where, merge = options.pop("where", None), options.pop("where_merge", True)
    if where is None:
        return FILTERS[name](df, **options)
    test = F.coalesce(ex.condition(where), F.lit(False))
    done = FILTERS[name](df.where(test), **options)
    return done if merge is False else done.unionByName(df.where(~test), allowMissingColumns=True)


class Pipeline:
    """Stages in order; the first may be a reader and the last a writer."""

    def __init__(self, stages: Sequence[Stage]) -> None:
        self.stages = list(stages)

    @classmethod
    def from_json(cls, spec: str | dict | list) -> Pipeline:
        try:
            spec = json.loads(spec) if isinstance(spec, str) else spec
            items = spec["pipeline"] if isinstance(spec, dict) else spec
            stages = []
            for k, item in enumerate(items):
                if isinstance(item, str):
                    kind = formats.reader_for(item) if k == 0 else formats.writer_for(item)
                    item = {"type": kind, "filename": item}
                elif "type" not in item:
                    kind = formats.reader_for(item["filename"]) if k == 0 else formats.writer_for(item["filename"])
                    item = {"type": kind, **item}
                stages.append(Stage(item["type"], {a: b for a, b in item.items() if a not in ("type", "tag", "inputs")}))
        except (ValueError, KeyError, TypeError) as e:
            if isinstance(e, CannotInferDriver):
                raise
            raise PipelineEncodingFailed(str(e)) from e
        return cls(stages)

    def to_json(self) -> str:
        return json.dumps({"pipeline": [s.spec() for s in self.stages]})

    def validate(self) -> None:
        for s in self.stages:
            if not registered(s.type):
                raise DriverNotRegistered(s.type)

    def plan(self, spark: SparkSession, df: DataFrame | None = None) -> DataFrame:
        """The frame before the writer, from the reader or from ``df``."""
        self.validate()
        for s in self.stages:
            if s.type in READERS:
                options = dict(s.options)
                path = options.pop("filename", None)
                new = READERS[s.type](spark, path, **options) if path is not None else READERS[s.type](spark, **options)
                df = new if df is None else df.unionByName(new, allowMissingColumns=True)
            elif s.type in FILTERS:
                df = apply_filter(df, s.type, s.options)
        return df

    def execute(self, spark: SparkSession, df: DataFrame | None = None) -> ConvertResult:
        out = self.plan(spark, df)
        stats = next((s for s in self.stages if s.type == "filters.stats"), None)
        for s in self.stages:
            if s.type in WRITERS:
                options = dict(s.options)
                WRITERS[s.type](out, options.pop("filename", ""), **options)
        rows = None
        if stats:
            dims = stats.options.get("dimensions", XYZ)
            dims = [d.strip() for d in dims.split(",")] if isinstance(dims, str) else list(dims)
            rows = [r.asDict() for r in agg.statistics(out, dims).orderBy("position").collect()]
        count = out.count()
        metadata = {"stages": [s.type for s in self.stages], "count": count, "statistics": rows}
        return ConvertResult(count, json.dumps(metadata, sort_keys=True), json.dumps(schema_summary(out.schema)), rows)


def convert(spark: SparkSession, source: str, target: str, options: ConvertOptions = ConvertOptions(), stats: bool = False) -> ConvertResult:
    """Reads, filters and writes; ``stats`` adds statistics after the caller's filters unless there are some."""
    read = options.reader or Stage(formats.reader_for(source))
    write = options.writer or Stage(formats.writer_for(target))
    for s in (read, write):
        if not registered(s.type):
            raise DriverNotRegistered(s.type)
    filters = list(options.filters)
    if stats and not any(s.type == "filters.stats" for s in filters):
        filters.append(Stage("filters.stats", {"dimensions": list(XYZ)}))
    extras = formats.writer_extras(target, options.coordinate_scale, write.options)
    stages = [Stage(read.type, {"filename": source, **read.options}), *filters, Stage(write.type, {"filename": target, **extras})]
    if options.on_progress and options.on_progress(0.0 if options.point_total_hint else None) is False:
        raise Cancelled(source)
    watch = _Progress(spark, options.on_progress)
    try:
        with watch:
            result = Pipeline(stages).execute(spark)
    except ConvertError:
        raise
    except Exception as e:
        raise (Cancelled(source) if watch.cancelled else PipelineFailed(str(e))) from e
    if options.on_progress:
        options.on_progress(1.0)
    return result


class _Progress:
    """Tells the share of tasks done while jobs run; a callback that returns False cancels them."""

    def __init__(self, spark: SparkSession, callback: Callable[[float | None], bool | None] | None, every: float = 0.2) -> None:
        self.context, self.callback, self.every = spark.sparkContext, callback, every
        self.group, self.cancelled, self.over = f"convert-{uuid.uuid4().hex}", False, threading.Event()

    def __enter__(self) -> _Progress:
        if self.callback:
            self.context.setJobGroup(self.group, "convert", interruptOnCancel=True)
            self.thread = threading.Thread(target=self.watch, daemon=True)
            self.thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        if self.callback:
            self.over.set()
            self.thread.join()
            self.context.setLocalProperty("spark.jobGroup.id", None)

    def watch(self) -> None:
        tracker, last = self.context.statusTracker(), None
        while not self.over.wait(self.every):
            if self.cancelled:  # jobs that began since then, too
                self.context.cancelJobGroup(self.group)
                continue
            stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(self.group) for s in (tracker.getJobInfo(j).stageIds if tracker.getJobInfo(j) else ())]
            total = sum(s.numTasks for s in stages if s)
            share = min(0.99, sum(s.numCompletedTasks for s in stages if s) / total) if total else None
            if share != last:
                last = share
                if self.callback(share) is False:
                    self.cancelled = True
                    self.context.cancelJobGroup(self.group)


@dataclass
class PointFrame:
    """Points with their spatial reference."""

    df: DataFrame
    srs: str | None = None

    @classmethod
    def read(cls, spark: SparkSession, path: str, reader: str | None = None, out_srs: str = "", resolution: float = 0.0, dimension_map: dict[str, str] | None = None, nodata: float | None = None, srs: str | None = None) -> PointFrame:
        name = reader or formats.reader_for(path, resolution, "readers.text")
        options = {"resolution": resolution} if resolution and name == "readers.copc" else {}
        df = READERS[name](spark, path, **options)
        if dimension_map:
            df = tr.map_dimensions(df, dimension_map)
        if nodata is not None:
            df = plumbline.operators.filters.drop_nodata(df, nodata)
        extension = path.rpartition(".")[2]
        if tr.reprojects(out_srs, extension, srs):
            return cls(tr.reproject(df, srs, out_srs), out_srs)
        return cls(df, srs)

    def info(self) -> dict:
        box = agg.bounds(self.df).withColumn("count", F.lit(0)).first()
        return {"count": self.df.count(), "bounds": {k: box[k] for k in box.asDict() if k != "count"}, "schema": schema_summary(self.df.schema), "srs": self.srs}

    def soa(self) -> DataFrame:
        return tr.soa(self.df)

    def chunks(self, size: int = 10_000) -> Iterator[dict]:
        """Chunks in input order, one at a time on the driver; stop iterating to cancel."""
        total, rows, so_far, first = self.df.count(), [], 0, True
        for row in self.df.orderBy(PID).toLocalIterator(prefetchPartitions=True):
            rows.append(row)
            if len(rows) == size or so_far + len(rows) == total:
                so_far += len(rows)
                yield {"points": rows, "total_so_far": so_far, "is_first": first, "is_complete": so_far == total, "progress": agg.progress(so_far, total)}
                rows, first = [], False

    def carve(self, meshes: Sequence[dict], origin: Sequence[float] = (0.0, 0.0, 0.0)) -> PointFrame:
        return PointFrame(plumbline.operators.surfaces.carve(self.df, meshes, origin), self.srs)

    def stac(self, dims: Sequence[str] = XYZ, kind: str = "lidar", encoding: str = "parquet") -> dict:
        return agg.stac_properties(self.df, dims, kind, encoding, self.srs)

    def nodes(self) -> DataFrame:
        return plumbline.operators.detail.node_table(self.df)

    def read_nodes(self, ids: Sequence[int]) -> DataFrame:
        from plumbline.functions import bits

        return self.df.where(bits.node_id(F.col("level"), F.col("ox"), F.col("oy"), F.col("oz")).isin(list(ids)))
