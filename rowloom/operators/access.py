"""Access paths: point, equality, range and prefix reads, ordered top-k and keyset pages, counts.

All are filters and sorts for Catalyst: equality sets and ranges reach the Parquet scan as pushed filters, a prefix as
StartsWith, an ordered read with a limit becomes a top-k, and only the projected columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Interval:
    """Bounds of a range; None is unbounded, an open bound excludes its value."""

    low: Any = None
    high: Any = None
    low_open: bool = False
    high_open: bool = False

    def condition(self, column: Column) -> Column:
        parts = []
        if self.low is not None:
            parts.append(column > self.low if self.low_open else column >= self.low)
        if self.high is not None:
            parts.append(column < self.high if self.high_open else column <= self.high)
        return reduce(lambda a, b: a & b, parts, column.isNotNull())


def project(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    """Columns by name, in the table's order whatever the order asked for; all if None."""
    if columns is None:
        return df
    wanted = {c.lower() for c in columns}
    return df.select(*[c for c in df.columns if c.lower() in wanted])


def full_scan(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return project(df, columns)


def point_get(df: DataFrame, key: str, values: Iterable, columns: Sequence[str] | None = None, descending: bool = False) -> DataFrame:
    """Rows with the given keys in key order; repeated keys count once and absent ones are passed over."""
    found = project(df.where(F.col(key).isin(*dict.fromkeys(values))), None if columns is None else [key, *columns])
    return found.orderBy(F.col(key).desc() if descending else F.col(key).asc())


def equality(df: DataFrame, column: str, values: Iterable, columns: Sequence[str] | None = None) -> DataFrame:
    return project(df.where(F.col(column).isin(*dict.fromkeys(values))), columns)


def ranges(df: DataFrame, column: str, intervals: Sequence[Interval], descending: bool = False, columns: Sequence[str] | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """Rows in any of the intervals, each once, ordered by the column and then by ``ties``."""
    if not intervals:
        return project(df.limit(0), columns)
    found = df.where(reduce(or_, [i.condition(F.col(column)) for i in intervals]))
    order = [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_first() for c in [column]] + [F.col(t) for t in ties]
    return project(found.orderBy(*order), columns)


def constant_prefix(pattern: str) -> str | None:
    """What a LIKE pattern begins with, if it is nothing but that and one % at its end."""
    m = re.fullmatch(r"([^%_\\]+)%", pattern)
    return m[1] if m else None


def prefix(df: DataFrame, column: str, start: str, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows whose column begins with ``start``, by byte order of the column and then by key."""
    return project(df.where(F.col(column).startswith(start)).orderBy(column, key), columns)


def top_k(df: DataFrame, column: str, k: int, key: str, descending: bool = False) -> DataFrame:
    return df.orderBy(F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_first(), F.col(key)).limit(k)


def keyset_page(df: DataFrame, column: str, key: str, after: tuple | None, k: int) -> DataFrame:
    """The k rows behind (value, key) in the order of both, so that rows with equal values are neither lost nor repeated."""
    if after is not None:
        value, at = after
        df = df.where((F.col(column) > value) | ((F.col(column) == value) & (F.col(key) > at)))
    return df.orderBy(column, key).limit(k)


def row_count(df: DataFrame, name: str = "n") -> DataFrame:
    """How many rows there are, reading no column."""
    return df.agg(F.count(F.lit(1)).alias(name))
