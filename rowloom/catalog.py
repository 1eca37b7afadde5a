"""Table and index definitions and the rules they must obey."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import types as T

from .errors import InvalidDefinition, Unsupported
from .types import ColumnType, column_type

MAX_COLUMNS, MAX_INDEXES, MAX_ROW_BYTES = 256, 16, 1 << 20
_OPTIONS = re.compile(r"\w+:(?=\s*\{)")  # a comment with options is a tag, a colon and a JSON object
_NAME = re.compile(r"[A-Za-z0-9_]{1,64}")

VERSION, EXPIRES, OPERATION = "_ver", "_expire_at", "_op"
TTL = "_ttl"


def check_name(name: str, reserved: bool = False) -> str:
    if not _NAME.fullmatch(name):
        raise InvalidDefinition(f"not a name: {name!r}")
    if reserved and name.startswith("_"):
        raise InvalidDefinition(f"names that begin with _ are reserved: {name}")
    return name


def options_of(comment: str | None, allowed: dict[str, type]) -> dict:
    """Options in a comment; other comments have none. Unknown fields and wrong types are errors."""
    tag = _OPTIONS.match(comment or "")
    if not tag:
        return {}
    try:
        found = json.loads(comment[tag.end() :])
    except ValueError as e:
        raise InvalidDefinition(f"options are not JSON: {comment}") from e
    if not isinstance(found, dict):
        raise InvalidDefinition("options must be an object")
    for key, value in found.items():
        if key not in allowed or not isinstance(value, allowed[key]) or isinstance(value, bool) != (allowed[key] is bool):
            raise InvalidDefinition(f"bad option {key}")
    return found


@dataclass
class Column:
    name: str
    type_text: str
    not_null: bool = False

    @property
    def type(self) -> ColumnType:
        return column_type(self.type_text)


@dataclass
class Index:
    name: str
    column: str
    unique: bool = False
    covering: list[str] = field(default_factory=list)
    asynchronous: bool = False
    kind: str = ""


@dataclass
class Table:
    """A table: columns, one primary-key column, single-column indexes, default time to live in seconds (0: none)."""

    name: str
    columns: list[Column]
    key: str
    auto_increment: bool = False
    default_ttl: int = 0
    indexes: list[Index] = field(default_factory=list)

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise InvalidDefinition(f"no column {name} in {self.name}")

    def index(self, name: str) -> Index | None:
        return next((i for i in self.indexes if i.name.lower() == name.lower()), None)

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.type.spark, not c.not_null and c.name != self.key, {"type_text": c.type_text}) for c in self.columns])

    @property
    def stored_schema(self) -> T.StructType:
        fields = [T.StructField(c.name, c.type.spark, True) for c in self.columns]
        return T.StructType([*fields, T.StructField(VERSION, T.LongType()), T.StructField(EXPIRES, T.TimestampType()), T.StructField(OPERATION, T.StringType())])

    def validate(self) -> Table:
        check_name(self.name)
        if not 1 <= len(self.columns) <= MAX_COLUMNS:
            raise InvalidDefinition(f"a table has 1 to {MAX_COLUMNS} columns")
        seen: set[str] = set()
        for c in self.columns:
            check_name(c.name, reserved=True)
            if c.name.lower() in seen:
                raise InvalidDefinition(f"column {c.name} is there twice")
            seen.add(c.name.lower())
            c.type_text = c.type.text
        key = self.column(self.key)
        self.key = key.name
        if key.type.storage not in ("INT", "STRING"):
            raise InvalidDefinition("a primary key is an integer or a string")
        if self.auto_increment and key.type.storage != "INT":
            raise InvalidDefinition("AUTO_INCREMENT needs an integer primary key")
        if self.default_ttl < 0:
            raise InvalidDefinition("default_ttl must not be negative")
        indexes, self.indexes = self.indexes, []
        for i in indexes:
            self.add_index(i)
        return self

    def add_index(self, index: Index) -> Index:
        """Checks an index and adds it; the limits hold for CREATE TABLE and CREATE INDEX alike."""
        check_name(index.name, reserved=True)
        if self.index(index.name):
            raise InvalidDefinition(f"index {index.name} is there already")
        if len(self.indexes) >= MAX_INDEXES:
            raise InvalidDefinition(f"a table has at most {MAX_INDEXES} indexes")
        column = self.column(index.column)
        if index.asynchronous and (index.unique or index.covering):
            raise InvalidDefinition("an asynchronous index is neither unique nor covering")
        for name in index.covering:
            if not self.column(name).not_null and name != self.key:
                raise InvalidDefinition(f"covering column {name} must be NOT NULL")
        index.column = column.name
        index.kind = "UNIQUE" if index.unique else "RANGE" if column.type.ordered else "EQ"
        self.indexes.append(index)
        return index

    def packed(self) -> dict:
        return asdict(self)

    @classmethod
    def unpacked(cls, x: dict) -> Table:
        x = dict(x)
        return cls(**x | {"columns": [Column(**c) for c in x["columns"]], "indexes": [Index(**i) for i in x["indexes"]]})


def table_options(comment: str | None) -> int:
    ttl = options_of(comment, {"default_ttl": int}).get("default_ttl", 0)
    if ttl < 0:
        raise InvalidDefinition("default_ttl must not be negative")
    return ttl


def index_options(comment: str | None) -> tuple[list[str], bool]:
    found = options_of(comment, {"covering": list, "async": bool})
    return found.get("covering", []), found.get("async", False)


def refuse(what: str) -> None:
    raise Unsupported(f"{what} is not supported")
