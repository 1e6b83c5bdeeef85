"""Canonical types and the maps from source systems into them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The canonical vocabulary and its Spark types.
SPARK_TYPES = {
    "string": "string",
    "integer": "int",
    "bigint": "bigint",
    "float": "double",
    "decimal": "decimal(38,10)",
    "date": "date",
    "timestamp": "timestamp_ntz",
    "boolean": "boolean",
    "bytes": "binary",
    "json": "string",
}

# Normalized type by (system, type, format).
TYPE_MAP = {
    ("relational", "BigInteger", ""): "bigint",
    ("relational", "Boolean", ""): "boolean",
    ("relational", "Date", ""): "date",
    ("relational", "DateTime", ""): "datetime",
    ("relational", "Float", ""): "float",
    ("relational", "Integer", ""): "integer",
    ("relational", "JSON", ""): "json",
    ("relational", "LargeBinary", ""): "binary",
    ("relational", "Numeric", ""): "float",
    ("relational", "String", ""): "string",
    ("relational", "Text", ""): "string",
    ("relational", "Time", ""): "time",
    ("relational", "Unicode", ""): "string",
    ("relational", "UnicodeText", ""): "string",
    ("relational", "Uuid", ""): "uuid",
    ("bson", "string", ""): "string",
    ("bson", "int", ""): "integer",
    ("bson", "long", ""): "bigint",
    ("bson", "double", ""): "float",
    ("bson", "decimal", ""): "decimal",
    ("bson", "bool", ""): "boolean",
    ("bson", "date", ""): "timestamp",
    ("bson", "binData", ""): "bytes",
    ("bson", "objectId", ""): "string",
    ("bson", "object", ""): "json",
    ("bson", "array", ""): "json",
    ("openapi", "integer", ""): "integer",
    ("openapi", "integer", "int32"): "integer",
    ("openapi", "integer", "int64"): "bigint",
    ("openapi", "number", ""): "float",
    ("openapi", "number", "float"): "float",
    ("openapi", "number", "double"): "decimal",
    ("openapi", "boolean", ""): "boolean",
    ("openapi", "string", ""): "string",
    ("openapi", "string", "uuid"): "string",
    ("openapi", "string", "date-time"): "timestamp",
    ("openapi", "string", "date"): "date",
    ("openapi", "string", "binary"): "bytes",
    ("openapi", "array", ""): "json",
    ("openapi", "object", ""): "json",
    ("sample", "str", ""): "string",
    ("sample", "int", ""): "integer",
    ("sample", "float", ""): "float",
    ("sample", "bool", ""): "boolean",
    ("sample", "bytes", ""): "bytes",
    ("sample", "dict", ""): "json",
    ("sample", "list", ""): "json",
}

# The relational type that a catalogue's type name stands for.
CATALOG_TYPES = {
    "smallint": "Integer", "integer": "Integer", "int": "Integer", "bigint": "BigInteger", "real": "Float", "double": "Float",
    "double precision": "Float", "numeric": "Numeric", "decimal": "Numeric", "boolean": "Boolean", "date": "Date",
    "timestamp": "DateTime", "timestamp without time zone": "DateTime", "timestamp with time zone": "DateTime", "time": "Time",
    "time without time zone": "Time", "character varying": "String", "varchar": "String", "character": "String", "char": "String",
    "text": "Text", "uuid": "Uuid", "json": "JSON", "jsonb": "JSON", "bytea": "LargeBinary", "blob": "LargeBinary",
}

# What a system's unmapped types become.
UNMAPPED = {"relational": "unknown", "bson": "string", "openapi": "string", "sample": "string"}


def type_map(spark: SparkSession) -> DataFrame:
    rows = [(*key, value) for key, value in TYPE_MAP.items()]
    return spark.createDataFrame(rows, "system string, type string, format string, normalized string")


def normalize_types(
    df: DataFrame, system: str = "system", type_col: str = "type", format_col: str = "format"
) -> DataFrame:
    """Add ``normalized_type``: exact (type, format), else the bare type, else the system's fallback.

    The map has a fixed few dozen rows, so both joins broadcast it.
    """
    known = type_map(df.sparkSession)
    exact = F.broadcast(
        known.select(
            F.col("system").alias("_s1"), F.col("type").alias("_t1"), F.col("format").alias("_f1"),
            F.col("normalized").alias("_exact"),
        )
    )
    bare = F.broadcast(
        known.where("format = ''").select(
            F.col("system").alias("_s2"), F.col("type").alias("_t2"), F.col("normalized").alias("_bare")
        )
    )
    wanted = F.coalesce(F.col(format_col), F.lit(""))
    fallback = F.lit(None).cast("string")
    for name, unmapped in UNMAPPED.items():
        fallback = F.when(F.col(system) == name, unmapped).otherwise(fallback)
    joined = df.join(
        exact, (F.col(system) == F.col("_s1")) & (F.col(type_col) == F.col("_t1")) & (wanted == F.col("_f1")), "left"
    ).join(bare, (F.col(system) == F.col("_s2")) & (F.col(type_col) == F.col("_t2")), "left")
    return joined.select(*df.columns, F.coalesce("_exact", "_bare", fallback).alias("normalized_type"))


def canonical_of(kind: T.DataType) -> str:
    """Canonical name of a Spark type; nested types collapse to json."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return "integer"
    if isinstance(kind, T.LongType):
        return "bigint"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "float"
    if isinstance(kind, T.DecimalType):
        return "decimal"
    if isinstance(kind, T.DateType):
        return "date"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.BinaryType):
        return "bytes"
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return "json"
    return "string"


def as_contract_type(normalized: Column) -> Column:
    """A normalized type as a destination type: anything outside the vocabulary is a string."""
    return F.when(normalized.isin(*SPARK_TYPES), normalized).otherwise("string")
