"""Point files: which reader or writer a name asks for, and the formats themselves.

Text formats are read by Spark's readers, so files split over tasks.  Binary
formats are read file by file in tasks (``binaryFile``), never on the driver.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.geometry import XYZ
from plumbline.operators.materialise import scratch
from plumbline.plans.registry import READERS, reader, writer


class CannotInferDriver(ValueError):
    """The name doesn't tell a reader or writer."""


# Extensions and the readers and writers that they ask for.
READS = {"copc.laz": "readers.copc", "copc.las": "readers.copc", "las": "readers.las", "laz": "readers.las", "ply": "readers.ply", "ptx": "readers.ptx", "pts": "readers.pts", "e57": "readers.e57", "xyz": "readers.text", "txt": "readers.text", "csv": "readers.text", "bpf": "readers.bpf", "pcd": "readers.pcd", "tif": "readers.gdal", "tiff": "readers.gdal", "obj": "readers.obj", "parquet": "readers.parquet", "sbet": "readers.sbet", "out": "readers.sbet", "smrmsg": "readers.smrmsg"}
WRITES = {"copc.laz": "writers.copc", "las": "writers.las", "laz": "writers.las", "ply": "writers.ply", "pcd": "writers.pcd", "bpf": "writers.bpf", "e57": "writers.e57", "xyz": "writers.text", "txt": "writers.text", "csv": "writers.text", "parquet": "writers.parquet"}
#: Columns of a text file by their number.
TEXT_COLUMNS = {3: "X Y Z", 4: "X Y Z Intensity", 6: "X Y Z Red Green Blue", 7: "X Y Z Intensity Red Green Blue", 9: "X Y Z Red Green Blue NormalX NormalY NormalZ"}


def _extension(path: str, known: dict[str, str]) -> str:
    name = path.rstrip("/").rpartition("/")[2].lower()
    for ext in sorted(known, key=len, reverse=True):
        if name.endswith("." + ext):
            return known[ext]
    raise CannotInferDriver(path)


def reader_for(path: str, resolution: float = 0.0, fallback: str | None = None) -> str:
    if resolution > 0 and path.lower().endswith((".copc.laz", ".copc.las")):
        return "readers.copc"
    try:
        return _extension(path, READS)
    except CannotInferDriver:
        if fallback:
            return fallback
        raise


def writer_for(path: str) -> str:
    return _extension(path, WRITES)


def writer_extras(path: str, scale: float | None = 0.001, given: dict | None = None) -> dict:
    """Options a writer gets by default; none replaces a given one, and only formats of scaled integers get a scale."""
    name, out = path.lower(), {}
    if name.endswith(".copc.laz"):
        out["extra_dims"] = "all"
    elif name.endswith(".laz"):
        out |= {"compression": "laszip", "extra_dims": "all"}
    if scale is not None and name.endswith((".las", ".laz")):
        out |= {f"scale_{d}": scale for d in "xyz"} | {f"offset_{d}": "auto" for d in "xyz"}
    return out | (given or {})


def text_layout(sample: str, numeric_only: bool = True) -> dict:
    """{columns, sep, skip} from a file's beginning: the separator by tab, comma, space; a first line that isn't numbers is a header."""
    lines = [ln.rstrip("\r") for ln in sample.split("\n")]
    lines = [(k, ln) for k, ln in enumerate(lines) if ln.strip() and not ln.lstrip().startswith("#")]
    if not lines:
        return {"columns": TEXT_COLUMNS[3].split(), "sep": " ", "skip": 0, "header": False}
    at, line = lines[0]
    sep = "\t" if "\t" in line else "," if "," in line else " "
    parts = [p.strip() for p in (line.split() if sep == " " else line.split(sep)) if p.strip()]
    try:
        float(parts[0])
    except ValueError:
        if numeric_only:
            return {"columns": [p.strip('"') for p in parts], "sep": sep, "skip": at + 1, "header": True}
    if len(parts) == 1 and parts[0].isdigit():
        return text_layout("\n".join(ln for _, ln in lines[1:]), numeric_only) | {"points": int(parts[0]), "count_line": True}
    return {"columns": TEXT_COLUMNS.get(len(parts), TEXT_COLUMNS[3]).split(), "sep": sep, "skip": at, "header": False}


def estimate_points(size: int, sample: str) -> int | None:
    """Points of a text file by the mean length of at least 16 sampled lines."""
    lines = [ln for ln in sample.split("\n")[:-1] if ln.strip()]
    if len(lines) < 16:
        return None
    return round(size / (sum(len(ln) + 1 for ln in lines) / len(lines)))


def las_points(header: bytes) -> int:
    """The point count of a LAS header: 64 bits at 247 from minor version 4 on, unless they are 0, else 32 bits at 107."""
    if header[:4] != b"LASF":
        raise ValueError("not a LAS file")
    legacy = struct.unpack_from("<I", header, 107)[0]
    return (struct.unpack_from("<Q", header, 247)[0] if header[25] >= 4 and len(header) >= 255 else 0) or legacy


def peek(spark: SparkSession, path: str, lines: int = 64) -> str:
    """The first lines of a text file, by Spark's reader."""
    return "\n".join(r[0] for r in spark.read.text(path).limit(lines).collect())


def _fields(line: Column, sep: str) -> Column:
    return F.split(F.trim(F.regexp_replace(line, "\r", "")), r"\s+" if sep == " " else sep)


@reader("readers.text")
def read_text(spark: SparkSession, path: str, columns: str | Sequence[str] | None = None, separator: str | None = None, skip: int | None = None) -> DataFrame:
    """Delimited numbers; layout by the first lines where it isn't given.  ``pid`` grows with the place in the files."""
    found = text_layout(peek(spark, path))
    names = columns.split() if isinstance(columns, str) else list(columns or found["columns"])
    sep = separator or found["sep"]
    lines = spark.read.text(path).select("value", (F.monotonically_increasing_id() + 1).alias("pid"))
    parts = _fields(F.col("value"), sep)
    numbers = [F.try_element_at(parts, F.lit(k + 1)).try_cast("double").alias(n) for k, n in enumerate(names)]
    rows = lines.where(~F.col("value").startswith("#")).select("pid", *numbers).where(F.col(names[0]).isNotNull() & F.col(names[min(2, len(names) - 1)]).isNotNull())
    return rows


@reader("readers.pts")
def read_pts(spark: SparkSession, path: str) -> DataFrame:
    return read_text(spark, path, "X Y Z Intensity Red Green Blue", " ")


@reader("readers.ilvis2")
def read_ilvis2(spark: SparkSession, path: str, mapping: str = "LOW") -> DataFrame:
    """ILVIS2 text: longitude, latitude, height of the lowest or highest mode (``mapping`` LOW, HIGH, or ALL)."""
    names = ["LvisLfid", "ShotNumber", "GpsTime", "LongitudeCentroid", "LatitudeCentroid", "ElevationCentroid", "LongitudeLow", "LatitudeLow", "ElevationLow", "LongitudeHigh", "LatitudeHigh", "ElevationHigh"]
    rows = read_text(spark, path, names, " ")
    one = lambda m: rows.withColumns({"X": F.col(f"Longitude{m}"), "Y": F.col(f"Latitude{m}"), "Z": F.col(f"Elevation{m}")})
    return one("Low").unionByName(one("High")) if mapping == "ALL" else one(mapping.capitalize())


def ptx_scans(text: str) -> Iterator[tuple[list[float], list[list[float]]]]:
    """(4x4 matrix, points) of each scan of a PTX text."""
    lines = text.replace("\r", "").split("\n")
    at = 0
    while at + 10 <= len(lines) and lines[at].strip():
        n = int(lines[at]) * int(lines[at + 1])
        m = [float(v) for ln in lines[at + 6 : at + 10] for v in ln.split()]
        yield m, [[float(v) for v in ln.split()] for ln in lines[at + 10 : at + 10 + n]]
        at += 10 + n


def _by_file(spark: SparkSession, path: str, decode, schema: str) -> DataFrame:
    """Rows that ``decode(bytes)`` makes of each file as a dict of numpy columns; ``pid`` counts within files, files by path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        for batch in batches:
            for raw, rank in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                columns = decode(raw.as_py())
                n = len(next(iter(columns.values())))
                columns["pid"] = (np.int64(rank) << 40) + np.arange(1, n + 1)
                for a in range(0, max(n, 1), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(columns[c][a : a + (1 << 16)]) for c in names], names)

    files = spark.read.format("binaryFile").load(path)
    paths = files.select("path").distinct()
    from pyspark.sql import Window

    ranks = paths.select(F.col("path").alias("p"), (F.row_number().over(Window.orderBy("path")) - 1).alias("rank"))  # a row a file
    return files.join(ranks, F.col("path") == F.col("p")).select("content", "rank").mapInArrow(run, schema)


@reader("readers.ptx")
def read_ptx(spark: SparkSession, path: str, discard_missing: bool = True) -> DataFrame:
    def decode(data: bytes) -> dict:
        out = []
        for m, points in ptx_scans(data.decode()):
            p = np.array([(v + [0, 0, 0, 0])[:7] if len(v) < 7 else v[:7] for v in points], float).reshape(-1, 7)
            if discard_missing:
                p = p[(p[:, :3] != 0).any(1)]
            p[:, :3] = np.column_stack([p[:, :3], np.ones(len(p))]) @ np.array(m).reshape(4, 4)[:, :3]
            out.append(p)
        p = np.concatenate(out) if out else np.zeros((0, 7))
        return {**{d: p[:, k] for k, d in enumerate(XYZ)}, "Intensity": np.rint(p[:, 3] * 4095).astype(np.int32), **{c: p[:, 4 + k].astype(np.int32) for k, c in enumerate(("Red", "Green", "Blue"))}}

    return _by_file(spark, path, decode, "pid long, X double, Y double, Z double, Intensity int, Red int, Green int, Blue int")


# PLY's names of number types.
PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
_PLY_NAMES = {"x": "X", "y": "Y", "z": "Z", "red": "Red", "green": "Green", "blue": "Blue", "intensity": "Intensity", "nx": "NormalX", "ny": "NormalY", "nz": "NormalZ"}


def decode_ply(data: bytes) -> tuple[dict, list[list[int]]]:
    """(vertex columns, faces) of a PLY file, text or binary of either byte order."""
    head, _, body = data.partition(b"end_header")
    body = body[body.index(b"\n") + 1 :]
    form, elements = "ascii", []
    for line in head.decode("ascii", "replace").replace("\r", "").split("\n"):
        w = line.split()
        if w[:1] == ["format"]:
            form = w[1]
        elif w[:1] == ["element"]:
            elements.append((w[1], int(w[2]), []))
        elif w[:1] == ["property"]:
            elements[-1][2].append((w[-1], w[1:-1]))
    columns: dict = {}
    faces: list[list[int]] = []
    order = ">" if "big" in form else "<"
    if form == "ascii":
        rows = body.decode().replace("\r", "").split("\n")
    at = 0
    for name, count, props in elements:
        lists = any(kind[0] == "list" for _, kind in props)
        if form == "ascii":
            own, at = rows[at : at + count], at + count
            if name == "vertex":
                table = np.array([ln.split() for ln in own], float).reshape(count, len(props))
                columns = {_PLY_NAMES.get(p.lower(), p): table[:, k] for k, (p, _) in enumerate(props)}
            elif name == "face":
                faces = [[int(v) for v in ln.split()[1 : 1 + int(ln.split()[0])]] for ln in own]
        elif not lists:
            kind = np.dtype([(p, order + PLY_TYPES[k[0]]) for p, k in props])
            table = np.frombuffer(body, kind, count, at)
            at += kind.itemsize * count
            if name == "vertex":
                columns = {_PLY_NAMES.get(p.lower(), p): table[p].astype(float) for p, _ in props}
        else:
            for _ in range(count):
                for p, k in props:
                    if k[0] == "list":
                        size, item = np.dtype(order + PLY_TYPES[k[1]]), np.dtype(order + PLY_TYPES[k[2]])
                        n = int(np.frombuffer(body, size, 1, at)[0])
                        values = np.frombuffer(body, item, n, at + size.itemsize)
                        at += size.itemsize + n * item.itemsize
                        if name == "face":
                            faces.append([int(v) for v in values])
                    else:
                        at += np.dtype(PLY_TYPES[k[0]]).itemsize
    return columns, faces


#: Lines of a file that may be its header.
HEAD_LINES = 500


def _text_points(spark: SparkSession, path: str, header) -> DataFrame | None:
    """Points of files of text, read by many tasks; None if a file holds binary data.

    ``header(lines)`` gives a file's names, the number of lines before its first
    point and of points, or None.  Lines are numbered by the counts of the
    blocks before, a row a block.
    """
    from pyspark.sql import Window

    files = sorted(r.path for r in spark.read.format("binaryFile").load(path).select("path").collect())
    found = [header([r.value for r in spark.read.text(f).take(HEAD_LINES)]) for f in files]
    if not found or None in found or len({tuple(names) for names, _, _ in found}) > 1:
        return None
    names = found[0][0]
    lines = spark.read.text(files).select("value", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__m"))
    blocks = lines.groupBy("__f", "__b").agg(F.count(F.lit(1)).alias("__n"), F.min("__m").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__f").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("__before", before).select("__f", "__b", "__before", "__first")
    bounds = spark.createDataFrame([(f, k, skip, n) for k, (f, (_, skip, n)) in enumerate(zip(files, found, strict=True))], "__path string, __rank long, __skip long, __points long")
    same = lambda c: F.regexp_replace(c, "^file:/+", "/")
    blocks = blocks.join(F.broadcast(bounds), same("__f") == same("__path"))
    numbered = lines.join(F.broadcast(blocks), ["__f", "__b"]).withColumn("__k", F.col("__m") - F.col("__first") + F.col("__before") - F.col("__skip"))
    values = F.split(F.trim("value"), r"\s+")
    points = numbered.where((F.col("__k") >= 0) & (F.col("__k") < F.col("__points"))).select((F.shiftleft("__rank", 40) + F.col("__k") + 1).alias("pid"), values.alias("__v"))
    return points.select("pid", *[F.element_at("__v", k + 1).cast("double").alias(n) for k, n in enumerate(names)])


def _head(spark: SparkSession, path: str, size: int = 65536) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select(F.substring("content", 1, size)).first()[0])


@reader("readers.ply")
def read_ply(spark: SparkSession, path: str) -> DataFrame:
    def header(lines: list[str]) -> tuple[list[str], int, int] | None:
        if "format ascii 1.0" not in lines or "end_header" not in lines:
            return None
        end = lines.index("end_header")
        elements: list[tuple[str, int, list[str]]] = []
        for w in (ln.split() for ln in lines[:end]):
            if w[:1] == ["element"]:
                elements.append((w[1], int(w[2]), []))
            elif w[:1] == ["property"]:
                elements[-1][2].append(_PLY_NAMES.get(w[-1].lower(), w[-1]))
        place = next((k for k, e in enumerate(elements) if e[0] == "vertex"), None)
        return None if place is None else (elements[place][2], end + 1 + sum(e[1] for e in elements[:place]), elements[place][1])

    if (points := _text_points(spark, path, header)) is not None:
        return points
    head = _head(spark, path).split(b"end_header")[0].decode("ascii", "replace").split("element face")[0]
    names = [_PLY_NAMES.get(n.lower(), n) for n in (ln.split()[-1] for ln in head.replace("\r", "").split("\n") if ln.startswith("property") and " list " not in ln)]
    return _by_file(spark, path, lambda data: decode_ply(data)[0], ", ".join(["pid long", *[f"{n} double" for n in names]]))


def read_ply_faces(spark: SparkSession, path: str) -> DataFrame:
    def decode(data: bytes) -> dict:
        faces = [[f[0], f[k], f[k + 1]] for f in decode_ply(data)[1] for k in range(1, len(f) - 1)]
        table = np.array(faces, np.int64).reshape(-1, 3)
        return {n: table[:, k] for k, n in enumerate("abc")}

    return _by_file(spark, path, decode, "pid long, a long, b long, c long").drop("pid")


@reader("readers.pcd")
def read_pcd(spark: SparkSession, path: str) -> DataFrame:
    """PCD as text, read by many tasks, or plain binary."""

    def header(lines: list[str]) -> tuple[list[str], int, int] | None:
        end = next((k for k, ln in enumerate(lines) if ln.split() == ["DATA", "ascii"]), None)
        if end is None:
            return None
        words = {w[0]: w[1:] for w in (ln.split() for ln in lines[:end]) if w}
        return [_PLY_NAMES.get(n.lower(), n) for n in words["FIELDS"]], end + 1, int(words["POINTS"][0])

    if (points := _text_points(spark, path, header)) is not None:
        return points
    head = _head(spark, path).decode("ascii", "replace").split("\nDATA")[0]
    names = next(ln.split()[1:] for ln in head.split("\n") if ln.startswith("FIELDS"))
    titles = [_PLY_NAMES.get(n.lower(), n) for n in names]

    def decode(data: bytes) -> dict:
        head, _, rest = data.partition(b"\nDATA ")
        form, _, body = rest.partition(b"\n")
        lines = {ln.split()[0]: ln.split()[1:] for ln in head.decode().replace("\r", "").split("\n") if ln and not ln.startswith("#")}
        n = int(lines["POINTS"][0])
        if form.strip() == b"ascii":
            table = np.array([ln.split() for ln in body.decode().replace("\r", "").split("\n")[:n]], float).reshape(n, len(names))
            return {t: table[:, k] for k, t in enumerate(titles)}
        kinds = np.dtype([(f, {"F": "f", "I": "i", "U": "u"}[k] + s) for f, k, s in zip(names, lines["TYPE"], lines["SIZE"], strict=True)])
        table = np.frombuffer(body, kinds, n)
        return {t: table[f].astype(float) for t, f in zip(titles, names, strict=True)}

    return _by_file(spark, path, decode, ", ".join(["pid long", *[f"{t} double" for t in titles]]))


@reader("readers.obj")
def read_obj(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where(F.col("value").startswith("v ")).select(_fields(F.col("value"), " ").alias("p"), (F.monotonically_increasing_id() + 1).alias("pid"))
    return lines.select("pid", *[F.element_at("p", k + 2).cast("double").alias(d) for k, d in enumerate(XYZ)])


def read_obj_faces(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where(F.col("value").startswith("f ")).select(_fields(F.col("value"), " ").alias("p"))
    corners = F.transform(F.slice("p", 2, 10_000), lambda c: F.element_at(F.split(c, "/"), 1).cast("long"))
    fans = lines.select(corners.alias("c")).select("c", F.explode(F.sequence(F.lit(2), F.size("c") - 1)).alias("k"))
    return fans.select(F.element_at("c", 1).alias("a"), F.element_at("c", F.col("k")).alias("b"), F.element_at("c", F.col("k") + 1).alias("c"))


# Offsets and types of the plain LAS point records, by format.
_LAS_BASE = [("X", "<i4", 0), ("Y", "<i4", 4), ("Z", "<i4", 8), ("Intensity", "<u2", 12)]
_LAS_OLD = [("Flags", "u1", 14), ("Classification", "u1", 15), ("ScanAngleRank", "i1", 16), ("UserData", "u1", 17), ("PointSourceId", "<u2", 18)]
_LAS_NEW = [("Flags", "u1", 14), ("Flags2", "u1", 15), ("Classification", "u1", 16), ("UserData", "u1", 17), ("ScanAngle", "<i2", 18), ("PointSourceId", "<u2", 20), ("GpsTime", "<f8", 22)]
_LAS_TIME = {1: 20, 3: 20, 4: 20, 5: 20}
_LAS_RGB = {2: 20, 3: 28, 5: 28, 7: 30, 8: 30, 10: 30}
_LAS_SIZE = {0: 20, 1: 28, 2: 26, 3: 34, 4: 57, 5: 63, 6: 30, 7: 36, 8: 38, 9: 59, 10: 67}


def las_format(point_format: int, size: int) -> np.dtype:
    fields = _LAS_BASE + (_LAS_NEW if point_format >= 6 else _LAS_OLD)
    if point_format in _LAS_TIME:
        fields = [*fields, ("GpsTime", "<f8", _LAS_TIME[point_format])]
    if point_format in _LAS_RGB:
        at = _LAS_RGB[point_format]
        fields = [*fields, ("Red", "<u2", at), ("Green", "<u2", at + 2), ("Blue", "<u2", at + 4)]
    return np.dtype({"names": [f[0] for f in fields], "formats": [f[1] for f in fields], "offsets": [f[2] for f in fields], "itemsize": size})


def decode_las(data: bytes) -> dict:
    """Columns of an uncompressed LAS file."""
    if data[:4] != b"LASF":
        raise ValueError("not a LAS file")
    fmt = data[104]
    if fmt & 0x80 or fmt & 0x40:
        raise ValueError("compressed LAS isn't supported")
    start, size = struct.unpack_from("<I", data, 96)[0], struct.unpack_from("<H", data, 105)[0]
    scale, offset = struct.unpack_from("<3d", data, 131), struct.unpack_from("<3d", data, 155)
    table = np.frombuffer(data, las_format(fmt, size), las_points(data), start)
    flags = table["Flags"]
    bits = 4 if fmt >= 6 else 3
    out = {d: table[d] * scale[k] + offset[k] for k, d in enumerate(XYZ)}
    out |= {"Intensity": table["Intensity"].astype(np.int32), "ReturnNumber": (flags & (2**bits - 1)).astype(np.int16), "NumberOfReturns": ((flags >> bits) & (2**bits - 1)).astype(np.int16)}
    out["Classification"] = (table["Classification"] & (0xFF if fmt >= 6 else 0x1F)).astype(np.int16)
    out["ScanAngleRank"] = table["ScanAngle"] * 0.006 if fmt >= 6 else table["ScanAngleRank"].astype(float)
    out |= {"UserData": table["UserData"].astype(np.int16), "PointSourceId": table["PointSourceId"].astype(np.int32)}
    zero = np.zeros(len(table))
    out["GpsTime"] = table["GpsTime"].astype(float) if "GpsTime" in table.dtype.names else zero
    out |= {c: table[c].astype(np.int32) if c in table.dtype.names else zero.astype(np.int32) for c in ("Red", "Green", "Blue")}
    return out


_LAS_SCHEMA = "pid long, X double, Y double, Z double, Intensity int, ReturnNumber short, NumberOfReturns short, Classification short, ScanAngleRank double, UserData short, PointSourceId int, GpsTime double, Red int, Green int, Blue int"


@reader("readers.las")
def read_las(spark: SparkSession, path: str) -> DataFrame:
    return _by_file(spark, path, decode_las, _LAS_SCHEMA)


def extra_dimension(raw: Column, scale: float = 1.0, offset: float = 0.0, options: int = 0) -> Column:
    """A value of an extra dimension: scale counts with option bit 8, offset with bit 16."""
    value = raw.cast("double")
    if options & 0x08:
        value = value * scale
    if options & 0x10:
        value = value + offset
    return value


# The fields of trajectory records.
SBET = "GpsTime Y X Z XVelocity YVelocity ZVelocity Roll Pitch Azimuth WanderAngle XBodyAccel YBodyAccel ZBodyAccel XBodyAngRate YBodyAngRate ZBodyAngRate".split()
SMRMSG = "GpsTime NorthPositionRMS EastPositionRMS DownPositionRMS NorthVelocityRMS EastVelocityRMS DownVelocityRMS RollRMS PitchRMS HeadingRMS".split()


def _records(names: list[str]):
    return lambda data: {n: np.frombuffer(data, "<f8")[: len(data) // 8 // len(names) * len(names)].reshape(-1, len(names))[:, k] for k, n in enumerate(names)}


@reader("readers.sbet")
def read_sbet(spark: SparkSession, path: str, angles_as_degrees: bool = True) -> DataFrame:
    out = _by_file(spark, path, _records(SBET), ", ".join(["pid long", *[f"{n} double" for n in SBET]]))
    return out.withColumns({c: F.degrees(c) for c in ("X", "Y", "Roll", "Pitch", "Azimuth", "WanderAngle")}) if angles_as_degrees else out


@reader("readers.smrmsg")
def read_smrmsg(spark: SparkSession, path: str) -> DataFrame:
    return _by_file(spark, path, _records(SMRMSG), ", ".join(["pid long", *[f"{n} double" for n in SMRMSG]]))


@reader("readers.faux")
def faux(spark: SparkSession, count: int, mode: str = "ramp", bounds: Sequence[Sequence[float]] = ((0, 0, 0), (1, 1, 1)), seed: int = 0, number_of_returns: int = 0, mean: Sequence[float] = (0, 0, 0), stdev: Sequence[float] = (1, 1, 1)) -> DataFrame:
    """Made-up points: constant, random or uniform, ramp, normal, grid; GpsTime is the point's number."""
    low, high = ([float(v) for v in b] for b in bounds)
    base = spark.range(count).select((F.col("id") + 1).alias("pid"), F.col("id").alias("k"))
    if mode == "constant":
        xyz = [F.lit(v) for v in low]
    elif mode == "ramp":
        share = F.col("k") / F.lit(float(max(1, count - 1)))
        xyz = [share * (b - a) + a for a, b in zip(low, high, strict=True)]
    elif mode in ("random", "uniform"):
        unit = lambda axis: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(axis), "k"), 11).cast("double")) / float(1 << 53)
        xyz = [unit(n) * (b - a) + a for n, (a, b) in enumerate(zip(low, high, strict=True))]
    elif mode == "normal":
        unit = lambda axis: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(axis), "k"), 11).cast("double") + 0.5) / float(1 << 53)
        xyz = [F.sqrt(-2 * F.ln(unit(2 * n))) * F.cos(unit(2 * n + 1) * 6.283185307179586) * float(s) + float(m) for n, (m, s) in enumerate(zip(mean, stdev, strict=True))]
    elif mode == "grid":
        nx, ny = (max(1, int(b - a)) for a, b in zip(low[:2], high[:2], strict=True))
        xyz = [F.col("k") % nx + low[0], F.floor(F.col("k") / nx) % ny + low[1], F.floor(F.col("k") / (nx * ny)) + low[2]]
    else:
        raise ValueError(mode)
    out = base.select("pid", *[c.cast("double").alias(d) for c, d in zip(xyz, XYZ, strict=True)], F.col("k").cast("double").alias("GpsTime"))
    if number_of_returns:
        out = out.withColumns({"ReturnNumber": ((F.col("pid") - 1) % number_of_returns + 1).cast("short"), "NumberOfReturns": F.lit(number_of_returns).cast("short")})
    return out


@reader("readers.buffer")
def read_buffer(spark: SparkSession, frame: DataFrame) -> DataFrame:
    return frame


@reader("readers.memoryview")
def read_array(spark: SparkSession, array: np.ndarray, order: str = "row") -> DataFrame:
    """A structured array; X, Y and Z come from the index where it has none."""
    flat = array.ravel(order="C" if order == "row" else "F")
    columns = {n: np.ascontiguousarray(flat[n]) for n in array.dtype.names or ()}
    if not array.dtype.names:
        columns["Intensity"] = flat
    if "X" not in columns:
        index = np.indices(array.shape).reshape(array.ndim, -1)
        if order != "row":
            index = np.stack([i.reshape(array.shape).ravel(order="F") for i in index])
        for d, axis in zip("YX" if array.ndim == 2 else "ZYX" if array.ndim == 3 else "X", index, strict=True):
            columns[d] = axis.astype(float)
    columns = {"pid": np.arange(1, len(flat) + 1), **columns}
    return spark.createDataFrame(pa.table(columns))


@reader("readers.parquet")
def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


@reader("readers.copc")
def read_octree(spark: SparkSession, path: str, resolution: float = 0.0, spacing: float | None = None, bounds: Sequence[Sequence[float]] | None = None) -> DataFrame:
    """A dataset parted by ``level``: with a resolution only the levels down to it, a filter on partitions."""
    from plumbline.functions.geometry import box_contains
    from plumbline.operators.detail import level_for

    df = spark.read.parquet(path)
    if resolution > 0:
        df = df.where(F.col("level") <= level_for(spacing or 1.0, resolution))
    return df if bounds is None else df.where(box_contains(*bounds))


@reader("readers.ept")
def read_tiles(spark: SparkSession, path: str, tiles: Sequence[tuple[int, int]] | None = None, addons: dict[str, str] | None = None) -> DataFrame:
    """A dataset parted by tile (tx, ty), with further dimensions from side tables keyed by pid."""
    df = spark.read.parquet(path)
    if tiles is not None:
        wanted = F.lit(False)
        for a, b in tiles:
            wanted = wanted | ((F.col("tx") == a) & (F.col("ty") == b))
        df = df.where(wanted)
    for name, side in (addons or {}).items():
        df = df.drop(name).join(spark.read.parquet(side).select("pid", name), "pid", "left")
    return df


@reader("readers.tindex")
def read_index(spark: SparkSession, path: str, bounds: Sequence[Sequence[float]] | None = None, where: str | None = None) -> DataFrame:
    """The files of an index table (location, bounds) that meet the bounds, read together."""
    index = spark.read.parquet(path)
    if bounds is not None:
        for k, d in enumerate("xy"):
            index = index.where((F.col(f"max{d}") >= float(bounds[0][k])) & (F.col(f"min{d}") <= float(bounds[1][k])))
    if where:
        index = index.where(where)
    files = [r.location for r in index.select("location").collect()]  # a row a file
    if not files:
        raise FileNotFoundError("no file of the index meets the bounds")
    df = spark.read.parquet(*files)
    from plumbline.functions.geometry import box_contains

    return df if bounds is None else df.where(box_contains([b for b in bounds[0]], [b for b in bounds[1]]))


def tile_index(spark: SparkSession, *paths: str) -> DataFrame:
    """(location, count, bounds) of point files."""
    df = spark.read.parquet(*paths).withColumn("location", F.col("_metadata.file_path"))
    return df.groupBy("location").agg(F.count(F.lit(1)).alias("count"), *[f(d).alias(f"{n}{d.lower()}") for n, f in (("min", F.min), ("max", F.max)) for d in XYZ])


@reader("readers.stac")
def read_stac(spark: SparkSession, path: str, dates: Sequence[Sequence[str]] | None = None, bounds: Sequence[Sequence[float]] | None = None, ids: Sequence[str] | None = None, asset: str = "data") -> DataFrame:
    """Items of STAC JSON files or feature collections by id, box and date; their assets are read together."""
    docs = [json.loads(r[0]) for r in spark.read.text(path, wholetext=True).collect()]  # a row a catalogue file
    items = [i for d in docs for i in (d["features"] if d.get("type") == "FeatureCollection" else [d])]
    found = []
    for i in items:
        box = i.get("bbox") or [0, 0, 0, 0]
        low, high = box[:2], box[len(box) // 2 : len(box) // 2 + 2]
        when = i.get("properties", {}).get("datetime") or ""
        if ids and i.get("id") not in ids:
            continue
        if bounds is not None and any(high[k] < bounds[0][k] or low[k] > bounds[1][k] for k in (0, 1)):
            continue
        if dates and not any(a <= when <= b for a, b in dates):
            continue
        found.append(i["assets"][asset]["href"])
    frames = [READERS[reader_for(f, fallback="readers.parquet")](spark, f) for f in found]
    if not frames:
        raise FileNotFoundError("no item passes the filters")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


# --- writers ------------------------------------------------------------------


@writer("writers.parquet")
def write_parquet(df: DataFrame, path: str, **options: object) -> None:
    df.write.mode("overwrite").parquet(path)


@writer("writers.null")
def write_null(df: DataFrame, path: str = "", **options: object) -> None:
    df.write.format("noop").mode("overwrite").save()


@writer("writers.copc")
def write_octree(df: DataFrame, path: str, depth: int = 6, **options: object) -> None:
    """Parted by level, in Z order within files."""
    from plumbline.operators.detail import octree
    from plumbline.operators.transforms import with_morton

    placed = with_morton(octree(df, depth))
    placed.repartitionByRange("level", "morton").sortWithinPartitions("level", "morton").write.mode("overwrite").partitionBy("level").parquet(path)


@writer("writers.ept_addon")
def write_addon(df: DataFrame, path: str, dimension: str, **options: object) -> None:
    df.select("pid", dimension).write.mode("overwrite").parquet(path)


@writer("writers.text")
def write_text(df: DataFrame, path: str, order: str | None = None, delimiter: str = ",", write_header: bool = True, format: str = "csv", precision: int = 3, **options: object) -> None:  # noqa: A002
    """CSV with dimensions as ``name:precision``, or GeoJSON features."""
    specs = [s.strip() for s in order.split(",")] if order else [f"{c}:{precision}" if t in ("double", "float") else c for c, t in df.dtypes if c != "pid"]
    columns = []
    for s in specs:
        name, _, digits = s.partition(":")
        columns.append(F.format_string(f"%.{int(digits)}f", F.col(name).cast("double")).alias(name) if digits else F.col(name).cast("string").alias(name))
    if format == "geojson":
        others = [c for c in df.columns if c not in XYZ]
        feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(*XYZ).alias("coordinates")).alias("geometry"), F.struct(*others).alias("properties"))
        df.select(F.to_json(feature).alias("value")).write.mode("overwrite").text(path)
    else:
        df.select(*columns).write.mode("overwrite").option("header", write_header).option("sep", delimiter).csv(path)


@writer("writers.ogr")
def write_wkt(df: DataFrame, path: str, measure: str | None = None, **options: object) -> None:
    """One point a line, as WKT."""
    parts = [F.col(d).cast("string") for d in (*XYZ, *([measure] if measure else []))]
    df.select(F.concat(F.lit("POINT ZM (" if measure else "POINT Z ("), F.concat_ws(" ", *parts), F.lit(")")).alias("value")).write.mode("overwrite").text(path)


@writer("writers.gdal")
def write_raster(df: DataFrame, path: str, resolution: float, **options: object) -> None:
    from plumbline.operators.surfaces import raster

    raster(df, resolution, **options).write.mode("overwrite").parquet(path)


@writer("writers.raster")
def write_cells(df: DataFrame, path: str, **options: object) -> None:
    df.write.mode("overwrite").parquet(path)


def _one_file(header: DataFrame, body: DataFrame, path: str) -> None:
    """A header and then the body's lines in order, as one text file: the formats allow no other way.

    Tasks sort and write parts by ranges of the order; one task then copies
    them to the file, a piece at a time.  The parts go once it is done.
    """
    parts = scratch(body.sparkSession, "lines")
    header.unionByName(body).repartitionByRange("n").sortWithinPartitions("n").select("value").write.text(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            store, folder = fs.FileSystem.from_uri(parts) if "://" in parts else (fs.LocalFileSystem(), parts)
            files = sorted(f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.base_name.startswith("part-"))
            target, to = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
            target.create_dir(to, recursive=True)
            with target.open_output_stream(f"{to}/.part-00000.txt.tmp") as out:
                for name in files:
                    with store.open_input_stream(name) as part:
                        while piece := part.read(4 << 20):
                            out.write(piece)
            for old in target.get_file_info(fs.FileSelector(to)):
                if old.is_file and not old.base_name.startswith("."):
                    target.delete_file(old.path)
            target.move(f"{to}/.part-00000.txt.tmp", f"{to}/part-00000.txt")
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["id"])

    body.sparkSession.range(1).coalesce(1).mapInArrow(run, "id long").collect()
    from pyarrow import fs

    store, folder = fs.FileSystem.from_uri(parts) if "://" in parts else (fs.LocalFileSystem(), parts)
    store.delete_dir(folder)


def _lines(df: DataFrame, columns: Sequence[str], precision: int) -> DataFrame:
    shown = [F.format_string(f"%.{precision}f", F.col(c).cast("double")) if dict(df.dtypes)[c] in ("double", "float") else F.col(c).cast("string") for c in columns]
    return df.select(F.col("pid").cast("long").alias("n"), F.concat_ws(" ", *shown).alias("value"))


def _numbers(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name != "pid"]


@writer("writers.ply")
def write_ply(df: DataFrame, path: str, precision: int = 6, faces: DataFrame | None = None, **options: object) -> None:
    names = _numbers(df)
    whole = {f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)}
    props = [f"property {'int' if n in whole else 'double'} {n.lower() if n in XYZ else n}" for n in names]
    head = ["ply", "format ascii 1.0", f"element vertex {df.count()}", *props] + ([f"element face {faces.count()}", "property list uchar int vertex_indices"] if faces is not None else []) + ["end_header"]
    header = df.sparkSession.createDataFrame([(k - len(head), v) for k, v in enumerate(head)], "n long, value string")
    body = _lines(df, names, precision)
    if faces is not None:
        from plumbline.operators.order import ordinal

        places = ordinal(df.select("pid"), name="__rn").select("pid", "__rn")
        for c in "abc":
            faces = faces.join(places.select(F.col("pid").alias(c), F.col("__rn").alias(f"v{c}")), c)
        body = body.unionByName(faces.select(F.lit(2**62).alias("n"), F.concat_ws(" ", F.lit("3"), "va", "vb", "vc").alias("value")))
    _one_file(header, body, path)


@writer("writers.pcd")
def write_pcd(df: DataFrame, path: str, precision: int = 6, **options: object) -> None:
    names, n = _numbers(df), df.count()
    head = ["VERSION .7", "FIELDS " + " ".join(c.lower() if c in XYZ else c for c in names), "SIZE " + " ".join("8" for _ in names), "TYPE " + " ".join("F" for _ in names), "COUNT " + " ".join("1" for _ in names), f"WIDTH {n}", "HEIGHT 1", "VIEWPOINT 0 0 0 1 0 0 0", f"POINTS {n}", "DATA ascii"]
    header = df.sparkSession.createDataFrame([(k - len(head), v) for k, v in enumerate(head)], "n long, value string")
    _one_file(header, _lines(df, names, precision), path)


def las_bytes(columns: dict, scale: Sequence[float], offset: Sequence[float]) -> bytes:
    """A LAS 1.2 file of format 3 from columns of equal length."""
    n = len(columns["X"])
    table = np.zeros(n, las_format(3, _LAS_SIZE[3]))
    for k, d in enumerate(XYZ):
        table[d] = np.floor((columns[d] - offset[k]) / scale[k] + 0.5)
    get = lambda c: columns.get(c, np.zeros(n))
    for c in ("Intensity", "Classification", "UserData", "PointSourceId", "GpsTime", "Red", "Green", "Blue"):
        table[c] = get(c)
    table["Flags"] = (get("ReturnNumber").astype(int) & 7) | (get("NumberOfReturns").astype(int) & 7) << 3
    table["ScanAngleRank"] = np.clip(get("ScanAngleRank"), -90, 90)
    xyz = [columns[d] for d in XYZ]
    ends = [float(f(v)) if n else 0.0 for v in xyz for f in (np.max, np.min)]
    returns = [int((get("ReturnNumber") == r).sum()) for r in range(1, 6)]
    head = struct.pack("<4sHHIHH8sBB32s32sHHHIIBHI5I", b"LASF", 0, 0, 0, 0, 0, b"", 1, 2, b"", b"plumbline", 1, 2000, 227, 227, 0, 3, _LAS_SIZE[3], n, *returns)
    return head + struct.pack("<6d", *scale, *offset) + struct.pack("<6d", *ends) + table.tobytes()


def put_bytes(uri: str, name: str, data: bytes) -> None:
    """Writes a file of a task in place by renaming, so that a repeated task does no harm."""
    from pyarrow import fs

    store, folder = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
    store.create_dir(folder, recursive=True)
    with store.open_output_stream(f"{folder}/.{name}.tmp") as f:
        f.write(data)
    store.move(f"{folder}/.{name}.tmp", f"{folder}/{name}")


@writer("writers.las")
def write_las(df: DataFrame, path: str, scale_x: float = 0.001, scale_y: float = 0.001, scale_z: float = 0.001, offset_x: float | str = "auto", offset_y: float | str = "auto", offset_z: float | str = "auto", **options: object) -> None:
    """A folder of LAS files, one a partition, written by the tasks; all share scale and offset."""
    if "auto" in (offset_x, offset_y, offset_z):
        low = df.agg(*[F.min(d) for d in XYZ]).first()
    offset = [float(low[k] or 0) if o == "auto" else float(o) for k, o in enumerate((offset_x, offset_y, offset_z))]
    scale = [float(scale_x), float(scale_y), float(scale_z)]
    names = ["pid", *_numbers(df)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts = [b for b in batches if b.num_rows]
        if parts:
            table = pa.Table.from_batches(parts).sort_by("pid")
            columns = {n: table[n].to_numpy() for n in names}
            put_bytes(path, f"part-{TaskContext.get().partitionId():05d}.las", las_bytes(columns, scale, offset))
            yield pa.RecordBatch.from_arrays([pa.array([table.num_rows])], ["n"])

    df.select(*names).mapInArrow(run, "n long").agg(F.sum("n")).collect()

