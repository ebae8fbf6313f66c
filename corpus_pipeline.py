"""The training-data pipeline: language ID, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs; all but the last return the
columns of ``documents``.

Defined cases, in every stage: an empty table stays empty; columns beyond those of
``documents`` are carried along; texts of any length are read whole; rows that share
a doc_id are one document to line dedup and near-dedup and rows of their own to the
others; a row with a null doc_id is kept by near-dedup and no reason to be dropped
elsewhere.  Null and empty texts are rejected by language ID, have no line and no
word after it, and pack as the end id alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairngraph.llm import langid, linededup, mixing, neardup, packing
from cairngraph.llm.catalogue import documents
from cairngraph.llm.storage import stored

#: A text whose best language has a smaller posterior is rejected; so is one without letters.
MIN_LANGUAGE_SCORE = 0.5
NULL_KEY = -(2**63)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in which a learned language is recognised; lang keeps its given value."""
    columns = docs.columns
    model = langid.train(docs.where(langid.fold(F.col("doc_id")) != langid.HELD_OUT))
    seen = langid.predict(docs, model)
    return seen.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove later matches of lines; a document none of whose lines with a word stay goes."""
    deduped = linededup.dedupe(docs)
    left = deduped.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest doc_id of each group of near-duplicates (five words, 0.8)."""
    drop = neardup.near_duplicates(docs.select("doc_id", "text")).where("not kept").select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents as the mix takes them, to whole documents (at most one a source is rounded)."""
    key = F.coalesce(F.col("doc_id"), F.lit(NULL_KEY))
    taken = (
        mixing.mix(docs)
        .groupBy(key.alias("__key"))
        .agg(F.round(F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).cast("int").alias("__copies"))
        .where("__copies > 0")
    )
    rows = docs.withColumn("__own", key).join(taken, F.col("__own") == F.col("__key"))
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise and pack what is left into sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("line_dedup", lines),
    ("near_dedup", near_dedup),
    ("mixing", mix),
    ("packing", pack),
]

#: No SQL for language models, MinHash clusters or column generation; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
