"""Line dedup by distinct-site spread, all in DataFrame operations.

A line (trimmed of white space, compared by a 128-bit hash) that stands on many distinct sites is boilerplate. A
HyperLogLog sketch of sites is kept for every line hash and merged by aggregation; lines whose estimate is clearly over
the threshold are taken as they are, those near it get an exact distinct count. Boilerplate is removed from all
documents but the first that has it, so no content is lost for good. A line that very many documents have is summed up
before the shuffle; where its documents meet it again, adaptive execution splits it as a skewed key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, stored

MIN_SITES = 5
LG_K = 10  # 2**10 registers: a standard error of 3.3 %
BAND = 0.15  # estimates within 15 %, over four standard errors, of the threshold are counted exactly

SPACE = r"[\x20\x09-\x0D]"

#: What names a document: its id and 128 bits of its text, since ids may be null or shared.
OWN = ["id", "t1", "t2"]


def text_keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit("second")).alias("t2")]


def line_array(text: Column) -> Column:
    return F.split(text, "\n")


def line_key(line: Column) -> Column:
    """A 128-bit hash of a trimmed line; null for a blank one."""
    trimmed = F.regexp_replace(line, rf"^{SPACE}+|{SPACE}+$", "")
    return F.when(trimmed != "", F.struct(F.xxhash64(trimmed).alias("h1"), F.xxhash64(trimmed, F.lit("second")).alias("h2")))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """h1, h2 and ``first`` (document and place of the first occurrence) of all lines that at least ``min_sites`` sites have.

    ``lines``: id, t1, t2, place, site, h1, h2; a row a line.
    """
    spread = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_agg("site", LG_K).alias("sketch"), F.min(F.struct(*OWN, "place")).alias("first"), F.count("*").alias("n")
    )
    spread = spread.where(F.col("n") >= min_sites).select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    spread = stored(spread.where(F.col("sites") >= min_sites * (1 - BAND)), "spread")
    near = spread.where(F.col("sites") < min_sites * (1 + BAND))
    counted = (
        lines.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi")
        .select("h1", "h2", "site").distinct()
        .groupBy("h1", "h2").agg(F.count("*").alias("sites"))
        .where(F.col("sites") >= min_sites).select("h1", "h2")
    )
    sure = spread.where(F.col("sites") >= min_sites * (1 + BAND))
    return sure.select("h1", "h2", "first").unionByName(near.select("h1", "h2", "first").join(counted, ["h1", "h2"], "left_semi"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text_col``, and columns ``n_lines`` and ``n_removed`` (long).

    A line is what stands between two ``\\n``; blank lines stay. A document that loses all lines gets an empty text. A
    null text stays null and has 0 lines; a null site is a site; a null id sorts first, and documents that share an id
    sort by a hash of their text; rows that repeat an id and a text are one document, so they keep the first occurrence
    together. All other columns pass through; one that has the name of a result is replaced; an empty table gives no rows.
    """
    own_id, own_t1, own_t2, dropped = fresh(docs.columns, "_id", "_t1", "_t2", "_drop")
    passed = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    lines = docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"),
        *text_keys(F.col(text_col)),
        F.coalesce(F.col(site_col).cast("string"), F.lit("\0")).alias("site"),
        F.posexplode(F.transform(line_array(F.col(text_col)), line_key)).alias("place", "key"),
    )
    lines = stored(lines.where("key is not null").select(*OWN, "place", "site", "key.*"), "lines")
    common = boilerplate(lines, min_sites).select("h1", "h2", "first")
    first = F.struct(*OWN, "place")
    drop = (
        lines.join(common, ["h1", "h2"])
        .where(~first.eqNullSafe(F.col("first")))
        .groupBy(F.col("id").alias(own_id), F.col("t1").alias(own_t1), F.col("t2").alias(own_t2))
        .agg(F.collect_set("place").alias(dropped))
    )
    t1, t2 = text_keys(F.col(text_col))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(own_id)) & (t1 == F.col(own_t1)) & (t2 == F.col(own_t2))
    joined = docs.join(drop, same, "left")
    gone = F.coalesce(F.col(dropped), F.array().cast("array<int>"))
    split = line_array(F.col(text_col))
    kept = F.filter(split, lambda _, i: ~F.array_contains(gone, i))
    return joined.select(
        *[F.when(F.size(gone) > 0, F.array_join(kept, "\n")).otherwise(F.col(text_col)).alias(c) if c == text_col else docs[c] for c in passed],
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_removed"),
    )
