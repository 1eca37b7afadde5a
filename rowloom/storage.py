"""Snapshots: numbered manifests committed by exclusive creation, and the Parquet files they list.

A manifest holds the table's definition, one base (each live key once) and the changes since. Reading joins the base
with the latest change of each key, so filters on base columns still reach the Parquet scan; compaction writes a new
base, and what it replaces stays for a while, for those who are reading it. A manifest is written aside and then named,
so a reader never sees half of one. All files are reached through Hadoop's file systems, so a store that only Spark reads will do.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import EXPIRES, OPERATION, VERSION, Table
from .errors import NoSuchTable, StaleVersion


@dataclass
class Manifest:
    number: int
    table: dict
    base: str | None = None
    changes: list[str] = field(default_factory=list)
    next_auto: int = 1
    next_version: int = 1
    rows: int | None = 0  # live keys, as far as known without looking at expiry
    expiring: bool = False
    retired: list[list] = field(default_factory=list)  # [path, second] of files that compaction has replaced

    @property
    def definition(self) -> Table:
        return Table.unpacked(self.table)


class Store:
    """Tables below one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def tables(self) -> list[str]:
        fs, root = self._fs(), self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()]
        return sorted(n for n in names if self._numbers(n))

    def _numbers(self, name: str) -> list[int]:
        fs, path = self._fs(), self._path(name, "manifest")
        if not fs.exists(path):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(path) if s.getPath().getName()[:-5].isdigit() and s.getPath().getName().endswith(".json"))

    def load(self, name: str) -> Manifest:
        numbers = self._numbers(name)
        if not numbers:
            raise NoSuchTable(f"no table {name}")
        stream = self._fs().open(self._path(name, "manifest", f"{numbers[-1]}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Manifest(**json.loads(text))

    def commit(self, name: str, manifest: Manifest) -> Manifest:
        """Publishes a manifest under its number, whole or not at all; fails if someone else has taken that number."""
        fs, target = self._fs(), self._path(name, "manifest", f"{manifest.number}.json")
        aside = self._path(name, "manifest", f".{uuid.uuid4().hex}.tmp")
        out = fs.create(aside, False)
        try:
            out.write(bytearray(json.dumps(manifest.__dict__).encode()))
        finally:
            out.close()
        try:
            self._rename(fs, aside, target)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName() or fs.exists(target):
                raise StaleVersion(f"{name} has changed meanwhile") from e
            raise
        finally:
            fs.delete(aside, False)
        return manifest

    def _rename(self, fs, source, target) -> None:
        """Gives a file its final name unless that is taken, in one step."""
        jvm = self.spark._jvm
        if fs.getUri().getScheme() == "file":  # a rename would overwrite here, a link doesn't
            where = lambda p: jvm.java.nio.file.Paths.get(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
            jvm.java.nio.file.Files.createLink(where(target), where(source))
            return
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(source, target, options)

    def write(self, name: str, rows: DataFrame) -> str:
        path = f"{self.root}/{name}/data/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return path

    def due(self, manifest: Manifest, grace: float) -> list[str]:
        """Replaced files that no reader can still be reading."""
        return [p for p, at in manifest.retired if at + grace <= time.time()]

    def drop(self, name: str) -> None:
        self._fs().delete(self._path(name), True)

    def forget(self, paths: list[str]) -> None:
        for p in paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def read(self, manifest: Manifest) -> DataFrame:
        """Current rows with their internal columns, expired ones included."""
        table = manifest.definition
        schema = table.stored_schema
        base = self.spark.read.schema(schema).parquet(manifest.base) if manifest.base else None
        if not manifest.changes:
            return base if base is not None else self.spark.createDataFrame([], schema)
        changes = self.spark.read.schema(schema).parquet(*manifest.changes)
        return merged(base, changes, table.key)


def merged(base: DataFrame | None, changes: DataFrame, key: str) -> DataFrame:
    """Base rows no change has touched, and the latest change of each key unless it is a deletion."""
    latest = latest_versions(changes, key)
    alive = latest.where(F.col(OPERATION) != "D").select(*changes.columns)
    if base is None:
        return alive
    return base.join(latest.select(key), key, "left_anti").select(*changes.columns).unionByName(alive)


def latest_versions(rows: DataFrame, key: str, version: str = VERSION) -> DataFrame:
    """The row with the greatest version of each key: an aggregate, which sums up before the shuffle."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(whole, F.col(version)).alias("_row")).select("_row.*")


def live(rows: DataFrame, as_of) -> DataFrame:
    """Rows that have not expired at one fixed moment."""
    return rows.where(F.col(EXPIRES).isNull() | (F.col(EXPIRES) > as_of))
