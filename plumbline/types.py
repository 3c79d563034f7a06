"""Dimensions: names, storage types, and the Spark types that stand for them."""

from __future__ import annotations

from pyspark.sql import types as T

#: Storage type -> (Spark type, bytes, base).  Unsigned types widen one step.
STORAGE = {
    "int8": (T.ByteType(), 1, "signed"), "int16": (T.ShortType(), 2, "signed"), "int32": (T.IntegerType(), 4, "signed"), "int64": (T.LongType(), 8, "signed"),
    "uint8": (T.ShortType(), 1, "unsigned"), "uint16": (T.IntegerType(), 2, "unsigned"), "uint32": (T.LongType(), 4, "unsigned"), "uint64": (T.DecimalType(20, 0), 8, "unsigned"),
    "float": (T.FloatType(), 4, "floating"), "double": (T.DoubleType(), 8, "floating"),
}

# Names of standard dimensions by storage type.
DIMENSIONS = {
    name: kind
    for kind, names in {
        "double": "X Y Z GpsTime ScanAngleRank HeightAboveGround NormalX NormalY NormalZ Curvature NNDistance Eigenvalue0 Eigenvalue1 Eigenvalue2 PlaneFit RadialDensity LocalReachabilityDistance LocalOutlierFactor OptimalRadius Linearity Planarity Scattering Verticality Omnivariance SurfaceVariation Anisotropy EigenentropyOf Eigenentropy Miniball Reciprocity Density",
        "uint16": "Intensity PointSourceId Red Green Blue Infrared",
        "uint8": "ReturnNumber NumberOfReturns Classification UserData Duplicate Coplanar Rank ScanDirectionFlag EdgeOfFlightLine ScanChannel Synthetic KeyPoint Withheld Overlap ClassFlags",
        "int64": "ClusterID TreeID",
        "uint64": "OptimalKNN H3 ShotNumber",
    }.items()
    for name in names.split()
}
DIMENSIONS.pop("EigenentropyOf")

#: Custom dimensions get these ids.
FIRST_CUSTOM_ID, MOST_IDS = 512, 1024


def storage_type(field: T.StructField) -> str:
    """The field's storage type: from its metadata, the standard dimensions, or the Spark type."""
    if "pc_type" in field.metadata:
        return field.metadata["pc_type"]
    by_spark = {T.ByteType: "int8", T.ShortType: "int16", T.IntegerType: "int32", T.LongType: "int64", T.FloatType: "float", T.DoubleType: "double", T.DecimalType: "uint64"}
    return by_spark.get(type(field.dataType), "double")


def schema_summary(schema: T.StructType) -> list[dict]:
    """[{name, size, type}] of the numeric columns."""
    numeric = (T.NumericType,)
    return [{"name": f.name, "size": STORAGE[storage_type(f)][1], "type": STORAGE[storage_type(f)][2]} for f in schema.fields if isinstance(f.dataType, numeric)]


def packed_layout(schema: T.StructType) -> dict:
    """Offsets of an interleaved record: natural alignment, doubles narrowed to float, stride a multiple of the largest alignment."""
    offset, widest, fields = 0, 1, []
    for f in schema.fields:
        if not isinstance(f.dataType, T.NumericType):
            continue
        source = storage_type(f)
        kind = "float" if source == "double" else source
        size = STORAGE[kind][1]
        offset = -(-offset // size) * size
        fields.append({"name": f.name, "source": source, "type": kind, "offset": offset, "size": size})
        offset, widest = offset + size, max(widest, size)
    return {"fields": fields, "stride": -(-offset // widest) * widest}


def is_floating(kind: str) -> bool:
    return STORAGE[kind][2] == "floating"


def is_signed(kind: str) -> bool:
    return STORAGE[kind][2] == "signed"


def is_unsigned(kind: str) -> bool:
    return STORAGE[kind][2] == "unsigned"
