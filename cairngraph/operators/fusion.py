"""Fusing observations into entities and edges, and maintaining what was fused.

Every fold is commutative, or ordered by an explicit ``seq``, so the result does not
depend on partitioning, and all of them combine map-side before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairngraph.sources.lineage import dealt

#: How far an extractor is trusted where a triple brings no confidence of its own.
PRIORS = {"parser": 1.0, "ast": 1.0, "regex": 0.9, "ner": 0.8, "llm": 0.6}
UNKNOWN_PRIOR = 0.5
TIERS = {"low": 0, "medium": 1, "high": 2}


def prior(extractor: Column) -> Column:
    """An extractor's prior confidence."""
    out = F.lit(UNKNOWN_PRIOR)
    for name, value in PRIORS.items():
        out = F.when(extractor == name, F.lit(value)).otherwise(out)
    return out


def tier_rank(tier: Column) -> Column:
    """low 0, medium 1, high 2, anything else -1."""
    out = F.lit(-1)
    for name, value in TIERS.items():
        out = F.when(tier == name, F.lit(value)).otherwise(out)
    return out


def tier_name(rank: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, value in TIERS.items():
        out = F.when(rank == value, F.lit(name)).otherwise(out)
    return out


def fuse_triples(triples: DataFrame) -> DataFrame:
    """One edge for each (subject, predicate, object).

    Weights add up, confidences combine by noisy-or, the highest tier stands, one resolved observation
    resolves the edge, sources are united, a slice stands only where all observations agree.  Self edges go.
    Columns read: subject, predicate, object, weight, confidence, confidence_tier, resolved, source, slice.
    """
    rows = triples.where("subject <> object")
    certain = F.max(F.when(F.col("confidence") >= 1, 1).otherwise(0)) == 1
    # 1 - prod(1 - c), as a sum of logarithms, which combines map-side
    noisy = 1 - F.exp(F.sum(F.when(F.col("confidence") < 1, F.log(1 - F.col("confidence"))).otherwise(0.0)))
    return rows.groupBy("subject", "predicate", "object").agg(
        F.sum("weight").alias("weight"),
        F.when(certain, F.lit(1.0)).otherwise(noisy).alias("confidence"),
        tier_name(F.max(tier_rank(F.col("confidence_tier")))).alias("confidence_tier"),
        F.bool_or("resolved").alias("resolved"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.when(F.count_distinct("slice") == 1, F.min("slice")).alias("slice"),
        F.count("*").alias("n_observations"),
    )


def upsert_entities(mentions: DataFrame) -> DataFrame:
    """One entity for each lower-cased name.

    First-seen casing and layer stand, the type is the first that is not the placeholder ``concept``,
    mentions are counted, sources united, an explicit test flag of the latest mention wins.
    Columns read: name, seq, type, layer, source, is_test.
    """
    typed = F.when(F.col("type") != "concept", F.struct("seq", "type"))
    layered = F.when(F.col("layer").isNotNull(), F.struct("seq", "layer"))
    flagged = F.when(F.col("is_test").isNotNull(), F.struct("seq", "is_test"))
    return (
        mentions.groupBy(F.lower("name").alias("name_lower"))
        .agg(
            F.min(F.struct("seq", "name")).alias("n"),
            F.min(typed).alias("t"),
            F.min(layered).alias("l"),
            F.max(flagged).alias("f"),
            F.count("*").alias("mention_count"),
            F.array_sort(F.collect_set("source")).alias("sources"),
        )
        .select(
            "name_lower", F.col("n.name").alias("name"), F.coalesce("t.type", F.lit("concept")).alias("type"), F.col("l.layer").alias("layer"),
            F.col("f.is_test").alias("is_test"), "mention_count", "sources",
        )
    )


def remove_by_source(entities: DataFrame, edges: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """Without a source: entities it alone asserts go, others lose it; every edge that carries it goes."""
    left = entities.withColumn("sources", F.array_remove("sources", source)).where(F.size("sources") > 0)
    return left, edges.where(~F.array_contains("sources", source))


def merge_entities(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Redirect (subject, predicate, object, weight) by (duplicate, canonical); no self edges, weights add up.

    The mapping may hold one row a duplicate; chains must be resolved beforehand.
    """
    m = mapping.select("duplicate", "canonical")
    rows = (
        edges.join(m.withColumnsRenamed({"duplicate": "d1", "canonical": "c1"}), F.col("subject") == F.col("d1"), "left")
        .join(m.withColumnsRenamed({"duplicate": "d2", "canonical": "c2"}), F.col("object") == F.col("d2"), "left")
        .select(F.coalesce("c1", "subject").alias("subject"), "predicate", F.coalesce("c2", "object").alias("object"), "weight")
    )
    return rows.where("subject <> object").groupBy("subject", "predicate", "object").agg(F.sum("weight").alias("weight"))


def undirected_max_weight(edges: DataFrame) -> DataFrame:
    """(a, b, weight) with a < b and the larger weight of the two directions."""
    rows = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "weight")
    return dealt(rows, "a", "b").groupBy("a", "b").agg(F.max("weight").alias("weight"))


def within_budget(mentions: DataFrame, key: str, order: str, size: str, budget: int, at_least_one: bool = True) -> DataFrame:
    """The newest rows of each key whose sizes fit the budget, newest first."""
    newest = W.partitionBy(key).orderBy(F.col(order).desc())
    rows = mentions.withColumn("__n", F.row_number().over(newest)).withColumn("__sum", F.sum(size).over(newest.rowsBetween(W.unboundedPreceding, 0)))
    fits = F.col("__sum") <= budget
    return rows.where(fits | (F.col("__n") == 1) if at_least_one else fits).drop("__n", "__sum")


def name_index(entities: DataFrame) -> DataFrame:
    """(key, name): lower-cased name or alias to the canonical name; a name outranks an alias, then the smaller name."""
    own = entities.select(F.lower("name").alias("key"), F.lit(0).alias("rank"), "name")
    other = entities.select(F.explode("aliases").alias("alias"), "name").select(F.lower("alias").alias("key"), F.lit(1).alias("rank"), "name")
    return own.unionByName(other).groupBy("key").agg(F.min(F.struct("rank", "name")).alias("m")).select("key", F.col("m.name").alias("name"))
