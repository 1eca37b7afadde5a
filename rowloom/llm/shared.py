"""Tables in the folder that driver and executors share, and connected components over them."""

from __future__ import annotations

import contextlib
import gc
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import discard, shared_folder, stored

__all__ = ["batch_rows", "buckets_for", "connected_components", "discard", "fresh", "release_shuffles", "shared_folder", "shuffle_partitions", "small_batches", "stored"]

def fresh(columns: list[str], *names: str) -> list[str]:
    """Names for helper columns that no column has, whatever its case."""
    have = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        out.append(name)
    return out


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more, before the next large step.

    Spark's cleaner removes them when the driver collects garbage, which a long job may put off until disks are full.
    """
    for _ in range(2):  # what the first round frees may hold on to more
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)  # for the cleaner, which works beside


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 1500) -> None:
    """Bounds the Arrow batches of texts that go to Python, unless the session has its own bound.

    By default a batch has 10,000 rows, of which the JVM and the Python worker hold several copies. Plans read the setting
    when they run, so it stays for the session.
    """
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(rows))


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Inside, Arrow batches have at most ``rows`` rows; for plans over large blobs that run there and then."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets_for(docs: DataFrame, text_col: str, each: int = 32 << 20) -> int:
    """Buckets that get about ``each`` bytes of text or less, and at least as many as the session shuffles into."""
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    return max(shuffle_partitions(docs.sparkSession), -(-size // each))


def connected_components(edges: DataFrame) -> DataFrame:
    """Component of every node of ``edges`` (a, b: long): (node, component), the smallest node reachable.

    Minimum labels spread over edges and then jump along labels, so a path of n nodes takes about log n rounds.
    Only joins and pre-aggregated minima are used: a node with very many edges can be split by the skew join,
    and nothing but one count a round reaches the driver. Loops and repeated edges do no harm; nulls are dropped.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null")
    both = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(
        both.groupBy(F.col("a").alias("node"))
        .agg(F.min("b").alias("least"))
        .select("node", F.least("node", "least").alias("component")),
        "labels",
    )
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        spread = labels.join(near, "node").select(
            "node", F.col("component").alias("before"), F.least("component", "near").alias("via")
        )
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("end"))
        now = stored(
            spread.join(jump, "via").select("node", "before", F.least("via", "end").alias("component")), "labels"
        )
        moved = now.where("component < before").limit(1).count()
        discard(labels)
        labels = now
        if not moved:
            discard(both)
            return labels.select("node", "component")
