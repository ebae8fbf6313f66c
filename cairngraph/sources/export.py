"""Graphs out: note pages, a drawing's JSON, node-link JSON, partitioned Parquet; and back in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SMALLEST, LARGEST, HIDDEN_LAYERS = 3, 20, ("ast",)


def note_pages(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, page): a Markdown page for each entity, with links out and in, sorted."""
    lines = lambda key, text: edges.groupBy(F.col(key).alias("name")).agg(F.array_join(F.array_sort(F.collect_list(text)), "\n").alias(f"{key}_lines"))
    out = lines("subject", F.concat(F.lit("- "), "predicate", F.lit(": [["), "object", F.lit("]]")))
    into = lines("object", F.concat(F.lit("- [["), "subject", F.lit("]] ("), "predicate", F.lit(")")))
    rows = entities.join(out, "name", "left").join(into, "name", "left")
    head = F.concat(F.lit("# "), "name", F.lit("\n\nType: "), F.coalesce("type", F.lit("unknown")), F.lit("\nMentions: "), F.col("mention_count").cast("string"))
    sections = F.concat_ws(
        "\n\n", head,
        F.when(F.col("subject_lines").isNotNull(), F.concat(F.lit("## Links\n"), "subject_lines")),
        F.when(F.col("object_lines").isNotNull(), F.concat(F.lit("## Linked from\n"), "object_lines")),
    )
    return rows.select("name", sections.alias("page"))


def colour(value: Column) -> Column:
    """A stable colour of a type or community."""
    return F.concat(F.lit("#"), F.substring(F.sha2(value.cast("string"), 256), 1, 6))


def drawing_nodes(entities: DataFrame, hidden: Sequence[str] = HIDDEN_LAYERS, membership: DataFrame | None = None) -> DataFrame:
    """(key, label, size, colour): size is the mentions within bounds; entities without a layer always show."""
    shown = entities.where(F.col("layer").isNull() | ~F.col("layer").isin(*hidden)) if hidden else entities
    group = F.coalesce("type", F.lit("unknown"))
    if membership is not None:
        shown = shown.join(membership.select(F.col("node").alias("name"), "community"), "name", "left")
        group = F.coalesce(F.when(F.col("community") != "-1", F.col("community")), group)
    size = F.greatest(F.lit(SMALLEST), F.least(F.lit(LARGEST), F.col("mention_count")))
    return shown.select(F.col("name").alias("key"), F.col("name").alias("label"), size.alias("size"), colour(group).alias("colour"))


def drawing(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON object a row, nodes and the edges between them, for line-delimited output."""
    ids = nodes.select("key")
    kept = edges.join(ids.withColumnRenamed("key", "subject"), "subject", "left_semi").join(ids.withColumnRenamed("key", "object"), "object", "left_semi")
    a = nodes.select(F.to_json(F.struct(F.lit("node").alias("is"), "key", "label", "size", "colour")).alias("value"))
    return a.unionByName(kept.select(F.to_json(F.struct(F.lit("edge").alias("is"), F.col("subject").alias("source"), F.col("object").alias("target"), F.col("predicate").alias("label"))).alias("value")))


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes as Parquet, edges partitioned by type, so that a typed hop reads its own files only."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def save_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def load_json(spark: SparkSession, path: str, node_schema: str, edge_schema: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(node_schema).json(f"{path}/nodes"), spark.read.schema(edge_schema).json(f"{path}/edges")


def read_node_link(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of one node-link JSON document ({"nodes": [...], "links" or "edges": [...]})."""
    doc = spark.read.option("multiLine", True).json(path)
    links = "links" if "links" in doc.columns else "edges"
    return doc.select(F.explode("nodes").alias("n")).select("n.*"), doc.select(F.explode(links).alias("e")).select("e.*")
