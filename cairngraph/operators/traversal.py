"""Traversal kernel: one level-synchronous frontier loop, in set mode and in path mode.

The adjacency is read once and stored as pairs of ids; every level reads those.  Set
mode keeps a node's first hop.  A level is one equi-join of the frontier with the
adjacency and one anti-join with what is known; each level is written once and never
recomputed.  Path mode carries the nodes of every path and forbids repeated nodes, so
it is for short, bounded depths.  Operators differ only in the adjacency they hand in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairngraph.sources.lineage import cut

MAX_HOPS = 200


def forward(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "type")


def backward(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type")


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, from one reading of the edges."""
    turn = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), F.col("type").alias("type"))
    return edges.select(F.inline(F.array(turn("src", "dst"), turn("dst", "src"))))


def of_types(edges: DataFrame, types: Sequence[str] | None) -> DataFrame:
    return edges if types is None else edges.where(F.col("type").isin(*types))


def reach(seeds: DataFrame, adjacency: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(id, hop): every node within ``max_hops`` of a seed and the fewest hops to it; seeds have hop 0.

    Without a bound the loop runs to its fixpoint.
    """
    links = cut(adjacency.select("src", "dst"))
    known = cut(seeds.select("id").distinct().withColumn("hop", F.lit(0)))
    front = known
    for hop in range(1, (max_hops or MAX_HOPS) + 1):
        step = links.join(front, F.col("src") == F.col("id")).select(F.col("dst").alias("id")).distinct()
        front = cut(step.join(known, "id", "left_anti").withColumn("hop", F.lit(hop)))
        if front.isEmpty():
            return known
        known = known.unionByName(front)
    if max_hops is None:
        raise RuntimeError(f"no fixpoint within {MAX_HOPS} hops")
    return known


def reach_pairs(seeds: DataFrame, adjacency: DataFrame, max_hops: int) -> DataFrame:
    """(seed, id, hop) for many seeds at once, without the seed itself."""
    links = cut(adjacency.select("src", "dst"))
    known = cut(seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("hop")).distinct())
    front = known
    for hop in range(1, max_hops + 1):
        step = links.join(front, F.col("src") == F.col("id")).select("seed", F.col("dst").alias("id")).distinct()
        front = cut(step.join(known, ["seed", "id"], "left_anti").withColumn("hop", F.lit(hop)))
        if front.isEmpty():
            break
        known = known.unionByName(front)
    return known.where("hop > 0")


def first_paths(seeds: DataFrame, adjacency: DataFrame, max_hops: int, undirected: bool = False, targets: DataFrame | None = None) -> DataFrame:
    """(id, hop, path): a shortest path to each reachable node, the smallest array of ids among those.

    Undirected edges are stored once and read both ways.  With targets (id) the search ends when all of them are known:
    later hops would not change their rows.
    """
    links = cut(adjacency.select("src", "dst"))
    if undirected:
        turn = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
        links = links.select(F.inline(F.array(turn("src", "dst"), turn("dst", "src"))))
    wanted = None if targets is None else cut(targets.select("id").distinct())
    known = cut(seeds.select("id").distinct().select("id", F.lit(0).alias("hop"), F.array("id").alias("path")))
    front = known
    for hop in range(1, max_hops + 1):
        step = (
            links.join(front, F.col("src") == F.col("id"))
            .select(F.col("dst").alias("id"), F.array_append("path", F.col("dst")).alias("path"))
            .join(known.select("id"), "id", "left_anti")
        )
        front = cut(step.groupBy("id").agg(F.min("path").alias("path")).select("id", F.lit(hop).alias("hop"), "path"))
        if front.isEmpty():
            break
        known = known.unionByName(front)
        if wanted is not None and wanted.join(known, "id", "left_anti").isEmpty():
            break
    return known


def paths(seeds: DataFrame, adjacency: DataFrame, depth: int) -> DataFrame:
    """(hop, nodes, types): all acyclic paths of 1..depth edges from the seeds."""
    links = cut(adjacency.select("src", "dst", "type"))
    state = seeds.select(F.col("id").alias("at"), F.array("id").alias("nodes"), F.array().cast("array<string>").alias("types"))
    levels = []
    for hop in range(1, depth + 1):
        step = links.join(state, F.col("src") == F.col("at")).where(~F.array_contains("nodes", F.col("dst")))
        state = step.select(F.col("dst").alias("at"), F.array_append("nodes", F.col("dst")).alias("nodes"), F.array_append("types", F.col("type")).alias("types"))
        if hop < depth:
            state = cut(state)
        levels.append(state.select(F.lit(hop).alias("hop"), "nodes", "types"))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def path_pattern(seeds: DataFrame, edges: DataFrame, pattern: Sequence[str], fan_out: int | None = 50, directed: bool = False) -> DataFrame:
    """(seed, terminal, label, nodes): paths that follow edge types in order, nodes not repeated.

    At most ``fan_out`` paths of a seed go on after each hop, the smallest by their nodes: the bound is part
    of the operator, None lifts it.  One row for each (seed, terminal, label), with its smallest path.
    """
    state = seeds.select(F.col("id").alias("seed"), F.col("id").alias("at"), F.array("id").alias("nodes"))
    for kind in pattern:
        links = of_types(edges, [kind])
        links = forward(links) if directed else both_ways(links)
        state = (
            links.select("src", "dst").distinct()
            .join(state, F.col("src") == F.col("at"))
            .where(~F.array_contains("nodes", F.col("dst")))
            .select("seed", F.col("dst").alias("at"), F.array_append("nodes", F.col("dst")).alias("nodes"))
        )
        if fan_out is not None:
            state = state.withColumn("n", F.row_number().over(W.partitionBy("seed").orderBy("nodes"))).where(F.col("n") <= fan_out).drop("n")
    label = "/".join(pattern)
    return state.groupBy("seed", F.col("at").alias("terminal")).agg(F.min("nodes").alias("nodes")).withColumn("label", F.lit(label))


def shortest_path(edges: DataFrame, source: DataFrame, target: DataFrame, max_hops: int, undirected: bool = False) -> DataFrame:
    """(id, hop, path) of each target that can be reached."""
    return first_paths(source, edges, max_hops, undirected, target).join(target.select("id").distinct(), "id", "left_semi")


def neighbors_default(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Out-neighbours up to ``depth`` and direct predecessors, seeds left out."""
    out = reach(seeds, forward(edges), depth).select("id")
    into = edges.join(seeds.select(F.col("id").alias("seed")), F.col("dst") == F.col("seed")).select(F.col("src").alias("id"))
    return out.unionByName(into).distinct().join(seeds.select("id"), "id", "left_anti")


def neighbors_undirected(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    return reach(seeds, both_ways(edges), depth).join(seeds.select("id"), "id", "left_anti")


def neighbors_typed(edges: DataFrame, seeds: DataFrame, types: Sequence[str], depth: int, mixed: bool = True) -> DataFrame:
    """Neighbours over some edge types; mixed: each hop either way, otherwise all hops one way."""
    links = of_types(edges, types)
    if mixed:
        found = reach(seeds, both_ways(links), depth).select("id")
    else:
        found = reach(seeds, forward(links), depth).select("id").unionByName(reach(seeds, backward(links), depth).select("id")).distinct()
    return found.join(seeds.select("id"), "id", "left_anti")


def influences(edges: DataFrame) -> DataFrame:
    """What a backward cone walks: a node to its drivers, to what its drivers read, and to what connects into it."""
    drives, reads, connects = (edges.where(F.col("type") == t).select("src", "dst") for t in ("DRIVES", "READS", "CONNECTS"))
    d, r = drives.select(F.col("src").alias("driver"), F.col("dst").alias("node")), reads.select(F.col("src").alias("reader"), F.col("dst").alias("read"))
    rows = (
        d.select(F.col("node").alias("src"), F.col("driver").alias("dst"))
        .unionByName(d.join(r, F.col("driver") == F.col("reader")).select(F.col("node").alias("src"), F.col("read").alias("dst")))
        .unionByName(connects.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    )
    return rows.distinct().withColumn("type", F.lit("INFLUENCED_BY"))


def influenced(edges: DataFrame) -> DataFrame:
    """What a forward cone walks: a node to its readers, to what they drive, and over connections either way."""
    drives, reads, connects = (edges.where(F.col("type") == t).select("src", "dst") for t in ("DRIVES", "READS", "CONNECTS"))
    r, d = reads.select(F.col("src").alias("reader"), F.col("dst").alias("node")), drives.select(F.col("src").alias("driver"), F.col("dst").alias("driven"))
    rows = (
        r.select(F.col("node").alias("src"), F.col("reader").alias("dst"))
        .unionByName(r.join(d, F.col("reader") == F.col("driver")).select(F.col("node").alias("src"), F.col("driven").alias("dst")))
        .unionByName(connects)
        .unionByName(connects.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    )
    return rows.distinct().withColumn("type", F.lit("INFLUENCES"))


def cone_of_influence(edges: DataFrame, target: DataFrame) -> DataFrame:
    """Fixpoint of everything that can influence the target, the target included."""
    return reach(target, influences(edges))


def forward_cone(edges: DataFrame, source: DataFrame) -> DataFrame:
    return reach(source, influenced(edges))


def reachability(nodes: DataFrame, edges: DataFrame, root: DataFrame) -> DataFrame:
    """Nodes under a root over instantiations and what is bound into them; empty where the root is unknown."""
    down = edges.where("type = 'INSTANTIATES'").select("src", "dst")
    bound = edges.where("type = 'BOUND_INTO'").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reach(root.join(nodes.select("id"), "id", "left_semi"), down.unionByName(bound).withColumn("type", F.lit("UNDER")))


def ordered_children(edges: DataFrame) -> DataFrame:
    """(src, children) by ordinal of PARENT_OF edges."""
    rows = edges.where("type = 'PARENT_OF'").groupBy("src").agg(F.array_sort(F.collect_list(F.struct("ordinal", "dst"))).alias("c"))
    return rows.select("src", F.transform("c", lambda x: x["dst"]).alias("children"))
