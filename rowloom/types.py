"""Column types: MySQL type texts, their storage class and their Spark type."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

from .errors import InvalidDefinition, Unsupported

_INTEGERS = {"tinyint": T.ByteType, "smallint": T.ShortType, "mediumint": T.IntegerType, "int": T.IntegerType, "integer": T.IntegerType, "bigint": T.LongType}
_WIDER = {"tinyint": T.ShortType, "smallint": T.IntegerType, "mediumint": T.IntegerType, "int": T.LongType, "integer": T.LongType}
_TEXTS = {"tinytext", "text", "mediumtext", "longtext"}
_BLOBS = {"tinyblob", "blob", "mediumblob", "longblob"}


@dataclass(frozen=True)
class ColumnType:
    text: str
    storage: str  # INT, FLOAT, STRING, BYTES, TIMESTAMP or JSON
    spark: T.DataType

    @property
    def ordered(self) -> bool:
        """Whether an index on it serves ranges."""
        return self.storage in ("INT", "FLOAT", "TIMESTAMP")


def column_type(text: str) -> ColumnType:
    """The type a MySQL type text names; unsupported types are refused.

    Unsigned integers get the next wider Spark type, so that all their values fit.
    """
    m = re.fullmatch(r"\s*(\w+)\s*(?:\(\s*([\d\s,]+)\s*\))?\s*(unsigned)?\s*(?:zerofill)?\s*", text, re.I)
    if not m:
        raise InvalidDefinition(f"not a type: {text!r}")
    name, size, unsigned = m[1].lower(), m[2], bool(m[3])
    if name in ("bool", "boolean"):
        return ColumnType("tinyint(1)", "INT", T.ByteType())
    if name in _INTEGERS:
        kind = (T.DecimalType(20, 0) if name == "bigint" else _WIDER[name]()) if unsigned else _INTEGERS[name]()
        name = "int" if name == "integer" else name
        return ColumnType(name + (f"({size.strip()})" if size else "") + (" unsigned" if unsigned else ""), "INT", kind)
    if name in ("float", "double") and not size:
        return ColumnType(name, "FLOAT", T.FloatType() if name == "float" else T.DoubleType())
    if name in ("char", "varchar"):
        if name == "varchar" and not size:
            raise InvalidDefinition("varchar needs a length")
        return ColumnType(f"{name}({(size or '1').strip()})", "STRING", T.StringType())
    if name in _TEXTS:
        return ColumnType(name, "STRING", T.StringType())
    if name in ("binary", "varbinary"):
        return ColumnType(f"{name}({(size or '1').strip()})", "BYTES", T.BinaryType())
    if name in _BLOBS:
        return ColumnType(name, "BYTES", T.BinaryType())
    if name in ("datetime", "timestamp"):
        if size and int(size) > 0:
            raise Unsupported("fractional seconds are not kept")
        return ColumnType(name, "TIMESTAMP", T.TimestampType())
    if name == "json":
        return ColumnType("json", "JSON", T.StringType())
    raise Unsupported(f"type {text.strip()} is not supported")
