"""Queries over the driver tables, one for each training-data operator, and their oracles."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairngraph.llm import fingerprint, langid, licenses, linededup, mixing, neardup, packing, secrets, substring, topk

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(os.path.join(sf_dir, "embeddings.parquet")), F.col("vec_id") % 100 == 0)


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(documents(spark, sf_dir))


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(documents(spark, sf_dir))


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), shingle=3, percent=85)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(documents(spark, sf_dir))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op10_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(documents(spark, sf_dir))


def edited_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op3 that SQL can express."""
    return op3_fingerprint(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op6 that SQL can express."""
    return op6_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "pipeline": pipeline,
        "op1_topk": op1_topk,
        "op2_substring": op2_substring,
        "op3_fingerprint": op3_fingerprint,
        "op4_neardup": op4_neardup,
        "op5_packing": op5_packing,
        "op6_secrets": op6_secrets,
        "op7_langid": op7_langid,
        "op8_mixing": op8_mixing,
        "op9_licenses": op9_licenses,
        "op10_linededup": op10_linededup,
        "edited_text": edited_text,
        "secret_base": secret_base,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_topk": topk.oracle(),
        "op2_substring": substring.oracle(),
        "op4_neardup": neardup.oracle(3, 85),
        "op8_mixing": mixing.oracle(),
        "op9_licenses": licenses.oracle(),
        "op10_linededup": linededup.oracle(),
        "edited_text": fingerprint.edited_oracle(),
        "secret_base": secrets.base_oracle(),
    }
