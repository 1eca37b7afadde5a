"""Windows over an event stream, and consumption of a change feed. An extension: the data model itself has no streams.

Every transform works on batch and streaming DataFrames alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, time: str = "ts", late: str | None = None) -> DataFrame:
    """Event time as a TIMESTAMP, which watermarks need, and a watermark if the stream may be late."""
    out = events.withColumn(time, F.col(time).cast("timestamp"))
    return out.withWatermark(time, late) if late else out


def tumbling(events: DataFrame, size: str, time: str = "ts", by: str = "event_type", late: str | None = None, slide: str | None = None) -> DataFrame:
    """Events a window and group; sliding windows if ``slide`` is given."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return timed(events, time, late).groupBy(window.alias("_w"), by).agg(F.count("*").alias("n")).select(F.col("_w.start").alias("w"), by, "n")


def sessions(events: DataFrame, gap: str, time: str = "ts", by: str = "user_id", late: str | None = None) -> DataFrame:
    """Sessions of each group: events no further apart than ``gap``."""
    grouped = timed(events, time, late).groupBy(F.session_window(time, gap).alias("_w"), by).agg(F.count("*").alias("n"))
    return grouped.select(by, F.col("_w.start").alias("begin"), F.col("_w.end").alias("end"), "n")


def first_seen(events: DataFrame, key: str, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    return timed(events, time, late).dropDuplicatesWithinWatermark([key])


def consume_changes(feed: DataFrame, valid: str, apply: Callable[[DataFrame], None], dead_letters: str, checkpoint: str):
    """Applies each batch's valid changes and puts the others aside as Parquet; ends when the feed is read.

    A batch may be applied again after a failure, so ``apply`` must not mind; versions in the changes see to that.
    """

    def step(batch: DataFrame, number: int) -> None:
        good = F.coalesce(F.expr(valid), F.lit(False))
        apply(batch.where(good))
        batch.where(~good).write.mode("overwrite").parquet(f"{dead_letters}/batch={number}")

    return feed.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
