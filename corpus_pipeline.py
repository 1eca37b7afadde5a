"""A cleaning pipeline over ``documents``: five stages, each one operator applied to all that the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
Between stages the rows are written to the folder that driver and executors share, and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm import language_id, line_dedup, mixing, near_dedup, sentencepieces
from rowloom.llm.shared import fresh, stored


def _apart(docs: DataFrame, *results: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns that are named like an operator's results under other names, and what they were called."""
    clashing = [c for c in docs.columns if c.lower() in results]
    names = dict(zip(fresh(docs.columns, *clashing), clashing, strict=True)) if clashing else {}
    for new, old in names.items():
        docs = docs.withColumnRenamed(old, new)
    return docs, names


def _named(docs: DataFrame, names: dict[str, str], columns: list[str]) -> DataFrame:
    """Undoes ``_apart``, and leaves the given columns."""
    new = {old: name for name, old in names.items()}
    return docs.select(*[F.col(f"`{new.get(c, c)}`").alias(c) for c in columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language. Learns from the rows that have one outside the held-out fold.

    Null texts and texts without a letter go; so does all where nothing can be learned. Null ids, repeated rows and texts
    of any length are judged by their text alone; columns pass through, whatever their names; an empty table gives none.
    """
    model = language_id.fit(docs.where(language_id.remainder("doc_id", 4) != 2))
    apart, names = _apart(docs, "lang_pred", "score")
    scored = language_id.predict(apart, model, keep=[c for c in apart.columns if c != "doc_id"])
    return _named(scored.where(~language_id.rejected(F.col("lang_pred"), F.col("score"))), names, docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes cross-site boilerplate lines from texts; documents of nothing else go. ``n_chars`` follows the text.

    A null text stays as it is, as does a blank one that has lost no line. Rows that share an id keep their own lines, the
    first occurrence of a line stays (of equal rows in each), and a null source is a source. Columns pass through.
    """
    apart, names = _apart(docs, "n_lines", "n_removed")
    cleaned = line_dedup.dedup_lines(apart)
    left = cleaned.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    length = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return _named(left.withColumn("n_chars", length), names, docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (similarity 0.8 or more), the one with the smallest id.

    Null and blank texts and rows without an id stay; of rows equal in id and text one stays; rows that share an id are
    documents of their own, and among those of one group the least text hash decides. Columns pass through.
    """
    return near_dedup.without_near_duplicates(docs, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples and repeats documents until each source has its share; a document taken twice is two rows.

    Empty texts cost nothing and are taken as their source's share says; a null source is a source; rows without an id
    are told by their texts, and ties rank by id and text. Columns pass through; an empty table gives none.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the token ids of every text, their number, and whether they decode to the text.

    A null or empty text has no ids; every row gets a row, whatever its id; columns named ids, n_tokens or round_trip are
    replaced by the results, all others pass through.
    """
    return sentencepieces.encode_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: SQL has no way to express the n-gram filters or the segmentation; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
