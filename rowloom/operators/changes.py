"""Row changes as plain transforms: what an insert, an update or a replacement makes of a table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import stored


def conflicts(current: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """New rows whose key a current row has."""
    return rows.join(current.select(key), key, "left_semi")


def without_conflicts(current: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """New rows that may be inserted."""
    return rows.join(current.select(key), key, "left_anti")


def insert_ignore(current: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return current.unionByName(without_conflicts(current, rows, key))


def replace(current: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Current rows, of which new rows with the same key take the place."""
    return current.join(rows.select(key), key, "left_anti").select(*current.columns).unionByName(rows.select(*current.columns))


def on_duplicate(current: DataFrame, rows: DataFrame, key: str, set_: Mapping[str, Column]) -> DataFrame:
    """Inserts new rows; where the key is taken, changes the current row by ``set_``, in which ``new.<column>`` is the new row."""
    joined = current.alias("old").join(rows.alias("new"), F.col(f"old.{key}") == F.col(f"new.{key}"), "full")
    both, only_new = F.col(f"old.{key}").isNotNull() & F.col(f"new.{key}").isNotNull(), F.col(f"old.{key}").isNull()
    return joined.select(
        *[
            F.when(both, set_[c] if c in set_ else F.col(f"old.{c}")).when(only_new, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c)
            for c in current.columns
        ]
    )


def update(current: DataFrame, where: Column, set_: Mapping[str, Column]) -> DataFrame:
    return current.select(*[F.when(where, set_[c]).otherwise(F.col(c)).alias(c) if c in set_ else F.col(c) for c in current.columns])


def delete(current: DataFrame, where: Column) -> DataFrame:
    """Rows for which the condition is not true; where it is null, a row stays."""
    return current.where(~F.coalesce(where, F.lit(False)))


def violations(rows: DataFrame, column: str) -> DataFrame:
    """Values, other than null, that more than one row has."""
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def with_next_ids(rows: DataFrame, key: str, start: int, order: list[str]) -> DataFrame:
    """Fills null keys with consecutive numbers from ``start``, in the given order.

    Rows are sorted in ranges and written once with their place in their range, so that counts and numbers speak of the
    same ranges; the sizes of the ranges are summed up, one number a range, so no task holds all rows.
    """
    missing = rows.where(F.col(key).isNull()).repartitionByRange(*order).sortWithinPartitions(*order)
    part = stored(missing.withColumn("_at", F.monotonically_increasing_id()), "numbered")  # range << 33 | place
    part = part.withColumn("_part", F.shiftright("_at", 33)).withColumn("_row", F.col("_at").bitwiseAND((1 << 33) - 1))
    sizes = part.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    filled = part.join(F.broadcast(before), "_part")  # one row a range
    filled = filled.withColumn(key, (F.lit(start) + F.col("_before") + F.col("_row")).cast(rows.schema[key].dataType))
    return rows.where(F.col(key).isNotNull()).unionByName(filled.select(*rows.columns))


def row_bytes(df: DataFrame, columns: list[str]) -> Column:
    """Bytes of a row's names and values as text; nulls are not stored."""
    parts = [F.when(F.col(c).isNull(), 0).otherwise(F.octet_length(F.col(c).cast("string")) + len(c)) for c in columns]
    return sum(parts[1:], parts[0])


def difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys whose rows are in one table only, or differ: (key, kind)."""
    a = left.select(F.col(key), F.xxhash64(*left.columns).alias("a"))
    b = right.select(F.col(key), F.xxhash64(*left.columns).alias("b"))
    both = a.join(b, key, "full")
    kind = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "orphan").when(F.col("a") != F.col("b"), "stale")
    return both.select(key, kind.alias("kind")).where("kind is not null")
