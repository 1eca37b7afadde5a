"""Tables with keys, unique values, row expiry and atomic changes over snapshots."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import EXPIRES, MAX_ROW_BYTES, OPERATION, TTL, VERSION, Index, Table
from .errors import DuplicateKey, InvalidDefinition, RowTooLarge, StaleVersion, TableError
from .functions.jsontext import canonical
from .operators import changes as C
from .operators import expiry as X
from .metrics import Metrics
from .scratch import discard, stored
from .storage import Manifest, Store, live

ATTEMPTS = 3
COMPACT_AFTER = 32  # change sets, after which a change compacts its table
GRACE = 3600.0  # seconds for which files that compaction has replaced stay
BAD = "_bad_json"


def now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc)


class Engine:
    """All tables below a folder. ``clock`` is asked once a statement, so a statement has one moment."""

    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], dt.datetime] = now):
        self.spark, self.store, self.clock, self.metrics = spark, Store(spark, root), clock, Metrics()
        self._held: dict[str, tuple[int, DataFrame]] = {}

    # definitions

    def create_table(self, table: Table) -> None:
        table.validate()
        if table.name in self.store.tables():
            raise InvalidDefinition(f"table {table.name} is there already")
        self.store.commit(table.name, Manifest(1, table.packed()))

    def drop_table(self, name: str) -> None:
        self.store.load(name)
        self.store.drop(name)

    def tables(self) -> list[str]:
        return self.store.tables()

    def definition(self, name: str) -> Table:
        return self.store.load(name).definition

    def create_index(self, name: str, index: Index) -> None:
        """Adds an index; a unique one is refused if live rows repeat a value, however many there are."""

        def change(m: Manifest) -> dict:
            table = m.definition
            table.add_index(index)
            if index.unique and not C.violations(self._live(m), index.column).isEmpty():
                raise DuplicateKey(f"{index.column} has repeated values")
            return {"table": table.packed()}

        self._commit(name, change)

    def drop_index(self, name: str, index: str) -> None:
        def change(m: Manifest) -> dict:
            table = m.definition
            found = table.index(index)
            if found is None:
                raise InvalidDefinition(f"no index {index}")
            table.indexes.remove(found)
            return {"table": table.packed()}

        self._commit(name, change)

    # reading

    def _moment(self) -> Column:
        return F.lit(self.clock())

    def _live(self, m: Manifest, moment: Column | None = None) -> DataFrame:
        rows = self.store.read(m)
        return live(rows, self._moment() if moment is None else moment) if m.expiring else rows

    def table(self, name: str, ttl: bool = True) -> DataFrame:
        """Live rows: the table's columns, and what is left of each row's time (-1: for ever) as ``_ttl``."""
        m = self.store.load(name)
        moment = self._moment()
        rows = self._live(m, moment)
        extra = [X.remaining_seconds(F.col(EXPIRES), moment).alias(TTL)] if ttl else []
        return rows.select(*m.definition.names, *extra)

    def versions(self, name: str) -> DataFrame:
        """Live rows' keys and versions: the number of the statement that wrote the row last, which only grows."""
        m = self.store.load(name)
        return self._live(m).select(m.definition.key, VERSION)

    def cached(self, name: str) -> DataFrame:
        """Live rows as ``table`` gives them, from memory as long as the snapshot is the newest; older ones are let go."""
        m, moment = self.store.load(name), self._moment()
        held = self._held.get(name)
        if held is None or held[0] != m.number:
            if held is not None:
                held[1].unpersist()
            held = self._held[name] = (m.number, self.store.read(m).persist())
            self.metrics.add("cache.misses")
        else:
            self.metrics.add("cache.hits")
        return live(held[1], moment).select(*m.definition.names, X.remaining_seconds(F.col(EXPIRES), moment).alias(TTL))

    def row_count(self, name: str) -> int:
        """Live rows; from the manifest alone where no row can have expired."""
        m = self.store.load(name)
        if m.rows is not None and not m.expiring:
            return m.rows
        return self._live(m).count()

    def data_length(self, name: str) -> int:
        return self.row_count(name) * 200

    # changes

    def _commit(self, name: str, change: Callable[[Manifest], dict], kind: str = "definition") -> Manifest:
        """Applies a change to the newest snapshot and publishes it; starts anew if someone was faster.

        What an attempt has written goes if its manifest does not come to be.
        """
        with self.metrics.timed(kind):
            for attempt in range(ATTEMPTS):
                m = self.store.load(name)
                parts: dict = {}
                try:
                    parts = change(m)
                    return self.store.commit(name, Manifest(**m.__dict__ | parts | {"number": m.number + 1}))
                except StaleVersion:
                    self.metrics.add("commit.lost")
                    self.store.forget([p for p in [parts.get("base"), *parts.get("changes", [])] if p and p not in (m.base, *m.changes)])
                    if attempt == ATTEMPTS - 1 or not parts:
                        raise
        raise AssertionError

    def _tidy(self, m: Manifest) -> None:
        """Keeps reads from joining ever more change sets with the base."""
        if len(m.changes) >= COMPACT_AFTER:
            self.compact(m.definition.name, [m.definition.key])

    def _encoded(self, rows: DataFrame, table: Table) -> DataFrame:
        """Columns in the table's types and order; absent ones are null. JSON becomes canonical, times whole seconds."""
        have = {c.lower(): c for c in rows.columns}
        unknown = set(have) - {n.lower() for n in table.names} - {TTL}
        if unknown:
            raise InvalidDefinition(f"no column {sorted(unknown)[0]} in {table.name}")
        out, bad = [], F.lit(False)
        for c in table.columns:
            value = F.col(have[c.name.lower()]) if c.name.lower() in have else F.lit(None)
            if c.type.storage == "JSON" and c.name.lower() in have:
                text, value = value.cast("string"), _canonical(value.cast("string"))
                bad = bad | (text.isNotNull() & value.isNull())
            elif c.type.storage == "TIMESTAMP":
                value = F.date_trunc("second", value.cast(T.TimestampType()))
            out.append(value.cast(c.type.spark).alias(c.name))
        out.append((F.col(have[TTL]).cast("long") if TTL in have else F.lit(None).cast("long")).alias(TTL))
        return rows.select(*out, bad.alias(BAD))

    def _check(self, rows: DataFrame, table: Table) -> None:
        """NOT NULL and the size limit, in one pass."""
        needed = [c.name for c in table.columns if c.not_null or c.name == table.key]
        broken = reduce(or_, [F.col(n).isNull() for n in needed])
        large = C.row_bytes(rows, table.names) > MAX_ROW_BYTES
        nulls, big, bad = rows.agg(F.max(broken), F.max(large), F.max(BAD)).first()
        if bad:
            raise TableError("a value is not JSON")
        if nulls:
            raise TableError("a column that is NOT NULL got a null")
        if big:
            raise RowTooLarge(f"a row has more than {MAX_ROW_BYTES} bytes")

    def _check_unique(self, rest: DataFrame, written: DataFrame, table: Table) -> None:
        """Unique values of written rows, among themselves and against the live rows that stay as they are.

        What is there already is unique, so only the written values are looked for; small writes are broadcast by size.
        """
        for i in table.indexes:
            if not i.unique:
                continue
            values = written.where(F.col(i.column).isNotNull()).select(i.column)
            if not C.violations(values, i.column).isEmpty() or not rest.select(i.column).join(values, i.column, "left_semi").isEmpty():
                raise DuplicateKey(f"duplicate value in unique index {i.name}")

    def _publish(self, m: Manifest, written: DataFrame | None, removed: DataFrame | None, **more) -> tuple[dict, int]:
        """Writes changed and deleted rows as one change set of the next version; also how many rows were changed."""
        table, parts = m.definition, []
        if written is not None:
            parts.append(written.withColumn(OPERATION, F.lit("W")))
        if removed is not None:
            gone = removed.select(F.col(table.key))
            for c in table.columns:
                if c.name != table.key:
                    gone = gone.withColumn(c.name, F.lit(None).cast(c.type.spark))
            parts.append(gone.withColumn(EXPIRES, F.lit(None).cast("timestamp")).withColumn(OPERATION, F.lit("D")))
        rows = reduce(lambda a, b: a.unionByName(b), [p.withColumn(VERSION, F.lit(m.next_version).cast("long")) for p in parts])
        path = self.store.write(table.name, rows.select(*table.stored_schema.names))
        back = self.spark.read.schema(table.stored_schema).parquet(path)
        changed, timed, deleted = back.agg(F.count_if(F.col(OPERATION) == "W"), F.count(EXPIRES), F.count_if(F.col(OPERATION) == "D")).first()
        if not changed + deleted:
            self.store.forget([path])
            return {}, 0
        out = {"changes": [*m.changes, path], "next_version": m.next_version + 1, "expiring": m.expiring or timed > 0} | more
        return out, changed if written is not None else deleted

    def insert(self, name: str, rows: DataFrame, on_conflict: str = "error", set_: Mapping[str, Column] | None = None) -> int:
        """Adds rows; returns how many rows are new or changed.

        ``on_conflict``: "error" fails on a key that a live row has, "ignore" passes such rows over, "replace" puts them
        in place of it, "update" changes the live row by ``set_``, in which ``new.<column>`` and ``old.<column>`` are
        known. Null keys of an AUTO_INCREMENT table get the next numbers. Keys repeated among the rows count as taken
        by the first of them, except that "replace" keeps one of the last version. The statement applies wholly or not.
        """
        affected = 0

        def change(m: Manifest) -> dict:
            nonlocal affected
            table, moment = m.definition, self._moment()
            fresh = self._encoded(rows, table)
            next_auto = m.next_auto
            if table.auto_increment:
                fresh = C.with_next_ids(fresh, table.key, m.next_auto, [n for n in table.names if n != table.key] or [table.key])
            fresh = stored(fresh, "rows")  # what is checked is what is written, whatever the source does
            try:
                return written(m, table, moment, fresh, next_auto)
            finally:
                discard(fresh)

        def written(m, table, moment, fresh, next_auto) -> dict:
            nonlocal affected
            if table.auto_increment:
                most = fresh.agg(F.max(table.key)).first()[0]
                next_auto = max(next_auto, int(most) + 1 if most is not None else 1)
            self._check(fresh, table)
            current = self._live(m, moment)
            repeated = not C.violations(fresh, table.key).isEmpty()
            if repeated and on_conflict in ("error", "update"):
                raise DuplicateKey("a key is there twice")
            if repeated:
                fresh = fresh.dropDuplicates([table.key])
            expires = X.expiry_of(F.col(TTL), table.default_ttl, moment).alias(EXPIRES)
            taken = C.conflicts(current, fresh, table.key)
            if on_conflict == "error":
                if not taken.isEmpty():
                    raise DuplicateKey(f"duplicate key in {name}: {taken.first()[table.key]}")
                changed = fresh.select(*table.names, expires)
            elif on_conflict == "ignore":
                changed = C.without_conflicts(current, fresh, table.key).select(*table.names, expires)
            elif on_conflict == "replace":
                changed = fresh.select(*table.names, expires)
            elif on_conflict == "update":
                both = fresh.alias("new").join(current.alias("old"), F.col(f"new.{table.key}") == F.col(f"old.{table.key}"), "left")
                known = F.col(f"old.{table.key}").isNotNull()
                columns = [F.when(known, (set_ or {}).get(n, F.col(f"old.{n}"))).otherwise(F.col(f"new.{n}")).cast(table.column(n).type.spark).alias(n) for n in table.names]
                kept = F.when(known, F.col(f"old.{EXPIRES}")).otherwise(X.expiry_of(F.col(f"new.{TTL}"), table.default_ttl, moment))
                changed = both.select(*columns, kept.alias(EXPIRES))
            else:
                raise ValueError(on_conflict)
            rest = current.join(changed.select(table.key), table.key, "left_anti")
            self._check_unique(rest, changed, table)
            there = 0 if on_conflict in ("error", "ignore") else taken.count()
            parts, affected = self._publish(m, changed, None, next_auto=next_auto)
            return parts | {"rows": None if m.rows is None else m.rows + affected - there}

        self._tidy(self._commit(name, change, "insert"))
        self.metrics.add("insert.rows", affected)
        return affected

    def update(
        self, name: str, where: Column | None, set_: Mapping[str, Column], ttl: int | None = None, narrow: Callable[[DataFrame], DataFrame] | None = None
    ) -> int:
        """Changes the live rows for which ``where`` holds; their time to live stays unless ``ttl`` is given.

        A changed key that another live row has is an error. Everything is checked before anything is written.
        ``narrow`` may take a part of the rows hit, as by an order and a limit.
        """
        affected = 0

        def change(m: Manifest) -> dict:
            nonlocal affected
            table, moment = m.definition, self._moment()
            for n in set_:
                table.column(n)
            values, bad = {table.column(n).name: v for n, v in set_.items()}, F.lit(False)
            for n, v in values.items():
                if table.column(n).type.storage == "JSON":
                    values[n] = _canonical(v.cast("string"))
                    bad = bad | (v.isNotNull() & values[n].isNull())
            current = self._live(m, moment)
            hit = current.where(where) if where is not None else current
            hit = narrow(hit) if narrow else hit
            expires = F.col(EXPIRES) if ttl is None else X.expiry_of(F.lit(ttl), table.default_ttl, moment)
            old = F.col(table.key).alias("_old")
            changed = hit.select(old, *[values[n].cast(table.column(n).type.spark).alias(n) if n in values else F.col(n) for n in table.names], expires.alias(EXPIRES), bad.alias(BAD))
            self._check(changed, table)
            removed = None
            if table.key in values:
                rest = current.join(changed.select(F.col("_old").alias(table.key)), table.key, "left_anti")
                if not C.violations(changed, table.key).isEmpty() or not C.conflicts(rest, changed, table.key).isEmpty():
                    raise DuplicateKey("the new key is taken")
                removed = changed.select(F.col("_old").alias(table.key)).join(changed.select(table.key), table.key, "left_anti")
            written = changed.select(*table.names, EXPIRES)
            rest = current.join(changed.select(F.col("_old").alias(table.key)), table.key, "left_anti")
            self._check_unique(rest, written, table)
            parts, affected = self._publish(m, written, removed)
            return parts

        self._tidy(self._commit(name, change, "update"))
        self.metrics.add("update.rows", affected)
        return affected

    def delete(self, name: str, where: Column | None = None, narrow: Callable[[DataFrame], DataFrame] | None = None) -> int:
        """Removes the live rows for which ``where`` holds; rows that have expired are not counted."""
        affected = 0

        def change(m: Manifest) -> dict:
            nonlocal affected
            hit = self._live(m)
            hit = hit.where(where) if where is not None else hit
            parts, affected = self._publish(m, None, narrow(hit) if narrow else hit)
            return parts | {"rows": None if m.rows is None else m.rows - affected}

        self._tidy(self._commit(name, change, "delete"))
        self.metrics.add("delete.rows", affected)
        return affected

    def compare_and_set(self, name: str, rows: DataFrame) -> int:
        """Writes rows if nobody else has written theirs: ``_ver`` is the version that each row was read at, null for a new row.

        One row whose live version differs makes the whole statement fail with StaleVersion; versions come from ``versions``.
        """
        affected = 0

        def change(m: Manifest) -> dict:
            nonlocal affected
            table, moment = m.definition, self._moment()
            expected = F.col(VERSION).cast("long").alias("_expected")
            keys = rows.select(F.col(table.key).cast(table.column(table.key).type.spark).alias(table.key), expected)
            fresh = stored(self._encoded(rows.drop(VERSION), table).join(keys, table.key), "rows")
            try:
                self._check(fresh, table)
                if not C.violations(fresh, table.key).isEmpty():
                    raise DuplicateKey("a key is there twice")
                current = self._live(m, moment)
                known = current.select(F.col(table.key).alias("_k"), F.col(VERSION).alias("_have"))
                both = fresh.join(known, F.col(table.key) == F.col("_k"), "left")
                if not both.where(~F.col("_expected").eqNullSafe(F.col("_have"))).isEmpty():
                    raise StaleVersion(f"a row of {name} has changed meanwhile")
                changed = fresh.select(*table.names, X.expiry_of(F.col(TTL), table.default_ttl, moment).alias(EXPIRES))
                self._check_unique(current.join(changed.select(table.key), table.key, "left_anti"), changed, table)
                there = C.conflicts(current, changed, table.key).count()
                parts, affected = self._publish(m, changed, None)
                return parts | {"rows": None if m.rows is None else m.rows + affected - there}
            finally:
                discard(fresh)

        self._tidy(self._commit(name, change, "compare_and_set"))
        self.metrics.add("compare_and_set.rows", affected)
        return affected

    # maintenance

    def compact(self, name: str, cluster_by: Sequence[str] = (), grace: float = GRACE) -> int:
        """Writes the live rows as a new base, sorted by ``cluster_by`` so that ranges skip row groups; returns their number.

        Files that it replaces are deleted by a later compaction, ``grace`` seconds on, so that readers can finish.
        """
        due: list[str] = []
        rows = 0

        def change(m: Manifest) -> dict:
            nonlocal due, rows
            current = self._live(m).withColumn(OPERATION, F.lit("W"))
            if cluster_by:
                current = current.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)
            path = self.store.write(name, current)
            written = self.spark.read.parquet(path)
            rows, timed = written.agg(F.count(F.lit(1)), F.count(EXPIRES)).first()
            due, now = self.store.due(m, grace), time.time()
            retired = [x for x in m.retired if x[0] not in due] + [[p, now] for p in [m.base, *m.changes] if p]
            return {"base": path, "changes": [], "rows": rows, "expiring": timed > 0, "retired": retired}

        self._commit(name, change, "compact")
        self.store.forget(due)
        return rows

    def drift(self, name: str) -> DataFrame:
        """(kind, detail): every key or value that breaks a rule, and what waits for compaction, by kind.

        ``key_repeated``, ``key_missing``, ``unique_repeated`` and ``count_wrong`` must not be; ``expired`` rows await
        compaction. Nothing is collected.
        """
        m = self.store.load(name)
        table, rows, moment = m.definition, self.store.read(m), self._moment()
        say = lambda df, kind, detail: df.select(F.lit(kind).alias("kind"), detail.cast("string").alias("detail"))
        key = F.col(table.key)
        parts = [
            say(C.violations(rows, table.key), "key_repeated", key),
            say(rows.where(key.isNull()), "key_missing", F.lit(None)),
            say(rows.where(F.col(EXPIRES) <= moment), "expired", key),
        ]
        for i in table.indexes:
            if i.unique:
                parts.append(say(C.violations(live(rows, moment), i.column), "unique_repeated", F.concat(F.lit(f"{i.name}: "), F.col(i.column).cast("string"))))
        if m.rows is not None and not m.expiring:
            counted = rows.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != m.rows)
            parts.append(say(counted, "count_wrong", F.concat(F.lit(f"{m.rows} noted, "), F.col("n").cast("string"))))
        return reduce(lambda a, b: a.unionByName(b), parts)

    def verify(self, name: str) -> dict[str, int]:
        """How often each kind of ``drift`` occurs, and the change sets that wait for compaction."""
        m = self.store.load(name)
        found = {r[0]: r[1] for r in self.drift(name).groupBy("kind").count().collect()}
        kinds = ["key_repeated", "key_missing", "expired", *(["unique_repeated"] if any(i.unique for i in m.definition.indexes) else []), "count_wrong"]
        return {k: found.get(k, 0) for k in kinds} | {"changes": len(m.changes)}

    def reconcile(self, name: str, other: DataFrame) -> DataFrame:
        """(key, kind) of rows in which the live table and another copy differ: missing there, orphan there, or stale."""
        table = self.definition(name)
        return C.difference(self.table(name, ttl=False), other.select(*table.names), table.key)

    def cardinality(self, name: str, columns: Sequence[str]) -> dict[str, int]:
        """About how many distinct values the columns have, by HyperLogLog sketches in one pass."""
        row = self.table(name, ttl=False).agg(*[F.hll_sketch_estimate(F.hll_sketch_agg(c, 12)).alias(c) for c in columns]).first()
        return row.asDict()


@F.pandas_udf(T.StringType())
def _canonical(column):
    """The canonical form, null for what is not JSON."""

    def one(x):
        try:
            return canonical(x)
        except ValueError:
            return None

    return column.map(lambda x: None if x is None else one(x))
