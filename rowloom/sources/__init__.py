"""Files as tables: reading them, loading them into an engine's table, and writing a table out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import Column, Table
from ..engine import Engine
from ..errors import Unsupported

FORMATS = ("parquet", "orc", "csv", "json", "text")

_TEXTS = {T.ByteType: "tinyint", T.ShortType: "smallint", T.IntegerType: "int", T.LongType: "bigint", T.FloatType: "float", T.DoubleType: "double", T.StringType: "text",
          T.BinaryType: "blob", T.TimestampType: "datetime", T.BooleanType: "tinyint"}


def read_files(spark: SparkSession, path: str, format: str = "parquet", schema: T.StructType | str | None = None, **options) -> DataFrame:
    """Files of one of FORMATS; a schema spares CSV and JSON the pass that would find one out."""
    if format not in FORMATS:
        raise Unsupported(f"format {format}")
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema is not None else reader).format(format).load(path)


def column_text(kind: T.DataType) -> str:
    """The column type that holds a Spark type; nested values are kept as JSON."""
    if isinstance(kind, T.ArrayType | T.MapType | T.StructType):
        return "json"
    if isinstance(kind, T.TimestampNTZType):
        return "datetime"
    if type(kind) not in _TEXTS:
        raise Unsupported(f"type {kind.simpleString()}")
    return _TEXTS[type(kind)]


def load(engine: Engine, name: str, rows: DataFrame, key: str, on_conflict: str = "error") -> int:
    """Inserts rows into a table, which is made by their schema if it is not there; returns how many are new or changed."""
    nested = [f.name for f in rows.schema if column_text(f.dataType) == "json"]
    if name not in engine.tables():
        engine.create_table(Table(name, [Column(f.name, column_text(f.dataType)) for f in rows.schema], key))
    return engine.insert(name, rows.withColumns({n: F.to_json(n) for n in nested}) if nested else rows, on_conflict)


def export(engine: Engine, name: str, path: str, format: str = "parquet", **options) -> None:
    """Writes the live rows of a table as files of one of FORMATS."""
    if format not in FORMATS:
        raise Unsupported(f"format {format}")
    engine.table(name, ttl=False).write.options(**options).format(format).save(path)
