"""Entity resolution and communities.

Greedy merging is defined as a pass in order; its outcome is found by two grouped minima.  Leiden has no Spark form; connected components and a
deterministic label propagation stand in, under their own names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairngraph.operators import similar
from cairngraph.sources.lineage import cut


def alias_candidates(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(canonical, duplicate, similarity, reason) where both names of an alias row (variant, canonical) exist and differ."""
    names = entities.select(F.lower("name").alias("key"), "name")
    rows = (
        aliases.select(F.lower("variant").alias("v"), F.lower("canonical").alias("c"))
        .where("v <> c")
        .join(names.withColumnsRenamed({"key": "v", "name": "duplicate"}), "v")
        .join(names.withColumnsRenamed({"key": "c", "name": "canonical"}), "c")
    )
    return rows.select("canonical", "duplicate", F.lit(1.0).alias("similarity"), F.lit("alias").alias("reason")).distinct()


def cosine_pairs(vectors: DataFrame, group: str, threshold: float) -> DataFrame:
    """(a, b, g, similarity) with a < b of equal group: all pairs of each group, compared within it."""
    return similar.pairs(vectors, group, threshold)


def greedy_merge(pairs: DataFrame) -> DataFrame:
    """(canonical, duplicate, similarity): within each group g, distinct pairs (a, b, mentions_a, mentions_b), a < b, in order.

    The name with more mentions wins, the smaller one on a tie; what has been absorbed is not absorbed
    again, though it may still absorb others later in the order.

    As every (a, x) comes before every (x, b), no pass in order is needed.  A name that loses a pair as its larger
    name goes to the smallest ``a`` of those.  Any other goes to the first ``b`` with more mentions that has not gone
    before, that is, to one that did not lose to a smaller name than itself.
    """
    wins = F.coalesce(F.col("mentions_a") >= F.col("mentions_b"), F.lit(False))
    sides = pairs.select("g", "a", "b", "similarity", wins.alias("wins"))
    first = sides.where("wins").groupBy("g", F.col("b").alias("duplicate")).agg(F.min(F.struct(F.col("a").alias("canonical"), "similarity")).alias("m"))
    gone = first.select("g", "duplicate", F.col("m.canonical").alias("by"))
    as_b = gone.select("g", F.col("duplicate").alias("b"), F.col("by").alias("b_by"))
    as_a = gone.select("g", F.col("duplicate").alias("a"))
    rest = sides.where("NOT wins").join(as_b, ["g", "b"], "left").where("b_by IS NULL OR b_by > a").join(as_a, ["g", "a"], "left_anti")
    later = rest.groupBy("g", F.col("a").alias("duplicate")).agg(F.min(F.struct(F.col("b").alias("canonical"), "similarity")).alias("m"))
    return first.unionByName(later).select("m.canonical", "duplicate", "m.similarity")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) by alternating large-star and small-star; component is the smallest id reachable."""
    now = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(moved.unionByName(low.withColumnRenamed("m", "v")).distinct())
        found = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if found == seen:
            break
        seen = found
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def communities(membership: DataFrame, min_size: int = 3) -> DataFrame:
    """Membership with the communities below ``min_size`` in bucket -1."""
    sizes = membership.groupBy("component").agg(F.count("*").alias("n"))
    return membership.join(sizes, "component").select("node", F.when(F.col("n") >= min_size, F.col("component").cast("string")).otherwise("-1").alias("community"), "n")


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, label): each round a node takes its neighbours' heaviest label, the smallest on a tie.

    Give whole numbers as weights where ties matter: their sums do not depend on an order.
    """
    # one reading of the edges gives both directions
    links = cut(edges.where("src <> dst").select(F.inline(F.array(F.struct("src", "dst", "weight"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")))))
    labels = links.select(F.col("src").alias("node"), F.col("src").alias("label")).distinct()
    for _ in range(rounds):
        votes = links.join(labels, F.col("dst") == F.col("node")).groupBy("src", "label").agg(F.sum("weight").alias("w"))
        labels = cut(votes.groupBy(F.col("src").alias("node")).agg(F.min(F.struct((-F.col("w")).alias("w"), "label")).alias("m")).select("node", F.col("m.label").alias("label")))
    return labels


def model_backed(rows: DataFrame, text: str, call, schema: str) -> DataFrame:
    """Apply a model callable (list of texts -> list of lists of dicts) in Arrow batches; one output row each dict."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        for pdf in batches:
            found = call(pdf[text].tolist())
            yield pd.DataFrame([{**d, "row_id": i} for i, many in zip(pdf["row_id"], found) for d in many], columns=["row_id", *names])

    return rows.mapInPandas(run, f"row_id long, {schema}")
