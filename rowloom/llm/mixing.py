"""Mixing sources to target weights by Pareto order sampling, all in DataFrame operations.

Every source has a target size, and every document an importance: a small whole number, by default the binary digits of
its size, so that long documents are likelier than scraps. A document's expected copies are in proportion to that, but
``most`` at the most, and add up to the source's target. Their whole part is taken for certain; what is left is the
document's inclusion probability p. Documents are ranked by Pareto's variable Q = (u / (1 - u)) / (p / (1 - p)), with u
a uniform number made of id and text, and the lowest are taken until what the source has left to fill is filled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh, stored

#: Ranks are first narrowed down by sums over this many intervals, twice; so no task sees a whole source.
INTERVALS = 256

#: Rows of the sources' plan (a source and importance each, some 100 bytes) that are sent to all tasks.
FEW_PLANS = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(id_col: Column, digest: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the id, the text's digest and the seed alone."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), digest)), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def text_digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def binary_digits(size: Column) -> Column:
    return F.length(F.bin(size)).cast("long")


def source_targets(sizes: DataFrame, most: int = 3) -> DataFrame:
    """source, source_size, target for a table (source, size): one row a source, null included.

    Sources by code point, nulls last, weigh 1, 2, 3, 1, ... and share the size of all; no target exceeds ``most`` times
    its source's size, and the excess is shared again by weight. One row a source is ordered in one task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("weight", (F.row_number().over(order) - 1) % 3 + 1).withColumn("cap", most * F.col("source_size"))
    # by rising cap a weight, a source is capped if an equal share of what is left would exceed its cap
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weights = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("level", left / weights).withColumn("capped", F.col("level") * F.col("weight") > F.col("cap"))
    rest = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(whole)["level"]
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(rest * F.col("weight"))
    return per.select("source", "source_size", target.alias("target"))


def expected_copies(sizes: DataFrame, targets: DataFrame, most: int = 3) -> DataFrame:
    """_source, importance, whole, p and left for a table (source, importance, size) and its ``source_targets``.

    In a source, a document of importance b has c * b expected copies, ``most`` at the most, with c such that they add
    up to the target: from the greatest b down, b is the first that an equal share of what is left does not fill over
    ``most``. ``whole`` and ``p`` are the whole part and the rest of that; ``left`` is what ``whole`` copies leave of the
    target. A row a source and importance, so windows here are over a few numbers a source.
    """
    per = sizes.groupBy("source", "importance").agg(F.sum("size").alias("s"))
    per = per.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    own = Window.partitionBy("source")
    down = own.orderBy(F.col("importance").desc())
    above = F.coalesce(F.sum("s").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = F.sum(F.col("s") * F.col("importance")).over(down.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("above", above).withColumn("below", below)
    level = F.when(F.col("below") > 0, (F.col("target") - (most * F.col("above")).cast("double")) / F.col("below").cast("double"))
    per = per.withColumn("level", level)
    fits = F.when((F.col("s") > 0) & (F.col("level") * F.col("importance") <= most), F.struct("importance", "level"))
    per = per.withColumn("c", F.max(fits).over(own)["level"])
    copies = F.when(F.col("c").isNull() | (F.col("c") * F.col("importance") > most), F.lit(float(most))).otherwise(F.col("c") * F.col("importance"))
    per = per.withColumn("m", F.when(F.col("source_size") > 0, copies).otherwise(0.0))
    per = per.withColumn("whole", F.floor("m")).withColumn("p", F.col("m") - F.floor("m"))
    left = F.col("target") - F.sum(F.col("s") * F.col("whole")).over(own).cast("double")
    return per.select(F.col("source").alias("_source"), F.col("importance").alias("_importance"), "source_size", "target", "whole", "p", left.alias("left"))


def _drawn(docs: DataFrame, id_col: str, source_col: str, text_col: str, most: int, seed: str, importance: Column | None) -> DataFrame:
    """``pareto_mix`` with ``digest``, which with the id tells which row of ``docs`` is meant."""
    rows = docs.select(
        F.col(id_col).cast("long").alias(id_col), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"),
        text_digest(F.col(text_col)).alias("digest"),
        *([importance.cast("long").alias("importance")] if importance is not None else []),
    )
    if importance is None:
        rows = rows.withColumn("importance", binary_digits(F.col("size")))
    rows = stored(rows, "sizes")  # narrow columns, read several times below
    targets = source_targets(rows.select("source", "size"), most)
    plan = stored(expected_copies(rows.select("source", "importance", "size"), targets, most), "plan")
    # a few rows a source: sent to all tasks if they are counted to be few, else rows are dealt by source, split where hot
    few = plan.count() <= FEW_PLANS
    sent = F.broadcast if few else lambda df: df
    on = F.col("source").eqNullSafe(F.col("_source")) & (F.col("importance") == F.col("_importance"))
    ranked = rows.join(sent(plan), on).drop("_source", "_importance")
    u = uniform(F.col(id_col), F.col("digest"), seed)
    q = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    place = F.when(F.col("p") > 0, q / (1 + q)).otherwise(2.0)  # in (0, 1), in the order of q; then what isn't drawn
    ranked = ranked.withColumn("place", place)
    fine = F.least(F.floor(F.col("place") * INTERVALS * INTERVALS), F.lit(INTERVALS * INTERVALS - 1))
    ranked = ranked.withColumn("fine", fine).withColumn("coarse", F.floor(F.col("fine") / INTERVALS))
    edge = _edge(ranked, "coarse", [])
    ranked = _with_edge(ranked, sent(edge), "coarse")
    edge = _edge(ranked.where("coarse = edge_coarse"), "fine", ["before_coarse"])
    ranked = _with_edge(ranked, sent(edge), "fine")
    lower = (F.col("coarse") < F.col("edge_coarse")) | ((F.col("coarse") == F.col("edge_coarse")) & (F.col("fine") < F.col("edge_fine")))
    at_edge = (F.col("coarse") == F.col("edge_coarse")) & (F.col("fine") == F.col("edge_fine"))
    in_order = Window.partitionBy("source", "at_edge", "spread").orderBy("place", id_col, "size", "digest").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranked.withColumn("at_edge", F.coalesce(at_edge, F.lit(False)))
    ranked = ranked.withColumn("spread", F.when(F.col("at_edge"), F.lit(-1)).otherwise(F.xxhash64(id_col, "digest")))  # else a source would meet in one task
    until = F.coalesce("before_fine", F.lit(0)) + F.sum("size").over(in_order)
    nearer = (until <= F.col("left")) | (2 * F.col("left") > 2 * until - F.col("size"))
    # without an edge all that can be drawn does not fill what is left
    lower = F.when(F.col("edge_coarse").isNull(), F.col("left") > 0).otherwise(lower)
    drawn = F.coalesce(F.when(F.col("at_edge"), nearer).otherwise(lower), F.lit(False)) & (F.col("p") > 0)
    copies = F.col("whole") + drawn.cast("long")
    return ranked.withColumn("copies", copies.cast("long")).select(
        id_col, "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), "p", "digest"
    )


def pareto_mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", most: int = 3, seed: str = "mix",
    importance: Column | None = None,
) -> DataFrame:
    """How often the mix takes each document.

    Returns ``id_col``, ``source``, ``size`` (words), ``source_size``, ``target`` (the source's), ``copies``, ``taken``
    (size * copies) and ``p`` (the inclusion probability beyond whole copies), one row a row. ``importance`` is an
    expression over ``docs``: whole numbers from 1, few different ones. The choice depends on ids, texts and the seed only,
    so reruns agree. Sizes add up document by document, and the document that crosses what is left of the target is taken
    if that comes nearer to it.

    A null or empty text has size 0 and costs nothing; a null source is a source, the last one; rows that share an id, or
    have none, are told apart by their texts, and rows that repeat both rank next to each other; a source of size 0 has
    target 0; columns of ``docs`` named like a result are not read but for those named; an empty table gives no rows.
    """
    return _drawn(docs, id_col, source_col, text_col, most, seed, importance).drop("digest")


def _edge(rows: DataFrame, level: str, carried: list[str]) -> DataFrame:
    """The interval in which each source's size reaches what is left to fill, and the size before it."""
    sums = rows.where("p > 0").groupBy("source", level).agg(F.sum("size").alias("size"), F.first("left").alias("left"), *(F.first(c).alias(c) for c in carried))
    order = Window.partitionBy("source").orderBy(level).rowsBetween(Window.unboundedPreceding, 0)
    start = F.coalesce(F.col(carried[0]), F.lit(0)) if carried else F.lit(0)
    sums = sums.withColumn("until", start + F.sum("size").over(order))
    return (
        sums.where("until >= left")
        .groupBy(F.col("source").alias("_source"))
        .agg(F.min(F.struct(F.col(level).alias(f"edge_{level}"), (F.col("until") - F.col("size")).alias(f"before_{level}"))).alias("e"))
        .select("_source", "e.*")
    )


def _with_edge(rows: DataFrame, edge: DataFrame, level: str) -> DataFrame:
    return rows.join(edge, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", most: int = 3, seed: str = "mix") -> DataFrame:
    """The mix itself: ``docs`` with each row as often as ``pareto_mix`` takes it.

    Rows are told by id and text; rows that repeat both share their copies among them, so that the sum is that of
    ``pareto_mix``. Nulls, ties and empty tables are as there; all columns pass through, whatever their names.
    """
    own_id, own_digest, times, rows, number, copy = fresh(docs.columns, "_id", "_digest", "_copies", "_rows", "_number", "_copy")
    drawn = _drawn(docs, id_col, source_col, text_col, most, seed, None)
    drawn = drawn.groupBy(F.col(id_col).alias(own_id), F.col("digest").alias(own_digest)).agg(F.sum("copies").alias(times), F.count("*").alias(rows))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(own_id)) & (text_digest(F.col(text_col)) == F.col(own_digest))
    joined = docs.join(drawn.where(F.col(times) > 0), same)
    # one of n equal rows gets a share of their copies, the first ones one more
    equal = Window.partitionBy(own_id, own_digest).orderBy(F.lit(0))
    joined = joined.withColumn(number, F.when(F.col(rows) > 1, F.row_number().over(equal)).otherwise(1))
    share = F.floor(F.col(times) / F.col(rows)) + (F.col(number) <= F.col(times) % F.col(rows)).cast("long")
    joined = joined.withColumn(times, share).where(F.col(times) > 0)
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(*docs.columns)
