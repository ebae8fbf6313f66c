"""Source snapshots: content hashes, incremental replacement, pruning, byte slices, the schema version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = "1.3.0"


def snapshot(spark: SparkSession, path: str, source: str, corpus: str) -> DataFrame:
    """Origins of the files under a path; the same content at the same place is one origin."""
    files = spark.read.format("binaryFile").load(path)
    sha = F.sha2("content", 256)
    return files.select(
        F.concat(F.lit("origin:"), F.sha2(F.concat_ws("\x00", "path", sha), 256)).alias("id"), F.col("path").alias("uri"), sha.alias("sha256"), "content",
        F.length("content").cast("long").alias("byte_length"), F.lit(source).alias("source"), F.lit(corpus).alias("corpus"), F.current_timestamp().alias("extracted_at"),
    ).dropDuplicates(["uri", "sha256"])


def origins_of(rows: DataFrame, uri: Column, text: Column) -> DataFrame:
    """(id, uri, sha256, byte_length) of texts held in a table."""
    sha = F.sha2(text.cast("binary"), 256)
    return rows.select(F.concat(F.lit("origin:"), F.sha2(F.concat_ws("\x00", uri, sha), 256)).alias("id"), uri.alias("uri"), sha.alias("sha256"), F.octet_length(text).cast("long").alias("byte_length"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(uri, status) of two snapshots (uri, sha256): new, removed, unchanged or replaced."""
    both = old.select("uri", F.col("sha256").alias("before")).join(new.select("uri", F.col("sha256").alias("after")), "uri", "full_outer")
    status = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "removed").when(F.col("before") == F.col("after"), "unchanged").otherwise("replaced")
    return both.select("uri", status.alias("status"))


def replace_touched(old: DataFrame, fresh: DataFrame, touched: DataFrame, key: str = "origin_id") -> DataFrame:
    """Rows of untouched origins as they were, rows of touched ones (key) anew."""
    return old.join(touched.select(key), key, "left_anti").unionByName(fresh)


def orphan_origins(origins: DataFrame, nodes: DataFrame) -> DataFrame:
    """Origins without a node."""
    return origins.join(nodes.select(F.col("origin_id").alias("id")), "id", "left_anti")


def current_origin(origins: DataFrame) -> DataFrame:
    """The smallest id of each (uri, source, corpus)."""
    return origins.groupBy("uri", "source", "corpus").agg(F.min("id").alias("id"))


def delete_subtree(nodes: DataFrame, edges: DataFrame, origins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes of some origins (id) and every edge at one of them."""
    gone = nodes.join(origins.select(F.col("id").alias("origin_id")), "origin_id", "left_semi").select("id")
    left = nodes.join(gone, "id", "left_anti")
    kept = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return left, kept


def source_at(content: Column, start: Column, end: Column) -> Column:
    """Bytes [start, end) of a content, the end clamped; negative or reversed bounds raise."""
    wrong = (start < 0) | (end < start)
    return F.when(wrong, F.raise_error(F.lit("span out of order"))).otherwise(F.substring(content.cast("binary"), (start + 1).cast("int"), (F.least(end, F.octet_length(content)) - start).cast("int")))


def check_version(found: str, wanted: str = SCHEMA_VERSION, policy: str = "semver-major") -> None:
    """Raise unless a stored schema version is compatible: the same major, exactly equal, or anything."""
    a, b = (tuple(int(x) for x in v.split(".")) for v in (found, wanted))
    ok = {"semver-major": a[0] == b[0], "exact": a == b, "any": True}
    if policy not in ok:
        raise ValueError(f"unknown policy {policy!r}")
    if not ok[policy]:
        raise ValueError(f"schema version {found} does not suit {wanted} under {policy}")
