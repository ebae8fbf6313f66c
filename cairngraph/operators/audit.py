"""Coverage and orphan audits, layer comparison, evaluation: anti-joins and set arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairngraph.operators.fusion import tier_rank
from cairngraph.operators.traversal import reach


def orphans(things: DataFrame, links: DataFrame) -> DataFrame:
    """Things (id) from which no resolved link (src, resolved) goes out; a missing flag counts as resolved."""
    return things.join(links.where(F.coalesce("resolved", F.lit(True))).select(F.col("src").alias("id")), "id", "left_anti")


def coverage_gaps(things: DataFrame, links: DataFrame, floor: str = "low") -> DataFrame:
    """Things (id) into which no resolved link (dst, resolved, tier) of at least the floor's rank goes; a missing tier is high."""
    enough = tier_rank(F.coalesce("tier", F.lit("high"))) >= tier_rank(F.lit(floor))
    good = links.where(F.coalesce("resolved", F.lit(True)) & enough).select(F.col("dst").alias("id"))
    return things.join(good, "id", "left_anti")


def coverage_gaps_transitive(things: DataFrame, covered: DataFrame, down: DataFrame) -> DataFrame:
    """Things neither covered nor below something covered along the edges given."""
    return things.join(reach(covered, down).select("id"), "id", "left_anti")


def layer_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(name, status, type_a, type_b, conflict) of two layers (name, type)."""
    left, right = a.select("name", F.col("type").alias("type_a"), F.lit(True).alias("in_a")), b.select("name", F.col("type").alias("type_b"), F.lit(True).alias("in_b"))
    status = F.when(F.col("in_a").isNull(), "only_in_b").when(F.col("in_b").isNull(), "only_in_a").otherwise("in_both")
    both = left.join(right, "name", "full_outer")
    conflict = F.coalesce(F.col("type_a") != F.col("type_b"), F.lit(False))
    return both.select("name", status.alias("status"), "type_a", "type_b", conflict.alias("conflict"))


def subgraph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes (id)."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def community_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(community, status) of two membership tables (community, member)."""
    members = lambda df, c: df.groupBy("community").agg(F.array_sort(F.collect_set("member")).alias(c))
    both = members(old, "before").join(members(new, "after"), "community", "full_outer")
    status = (
        F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "removed").when(F.col("before") == F.col("after"), "unchanged").otherwise("changed")
    )
    return both.select("community", status.alias("status"))


def precision_recall(rows: DataFrame, predicted: str, gold: str) -> DataFrame:
    """Adds precision, recall, f1 from two array columns; zero where either is empty or nothing is shared."""
    p, g = F.array_distinct(predicted), F.array_distinct(gold)
    hit = F.size(F.array_intersect(p, g)).cast("double")
    found = rows.withColumn("precision", F.when(F.size(p) > 0, hit / F.size(p)).otherwise(0.0)).withColumn("recall", F.when(F.size(g) > 0, hit / F.size(g)).otherwise(0.0))
    total = F.col("precision") + F.col("recall")
    return found.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0))


def macro_mean(scored: DataFrame) -> DataFrame:
    return scored.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], F.count("*").alias("n"))
