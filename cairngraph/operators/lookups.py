"""Small named lookups over graph frames: one join each, whole frames at a time.

Nodes have id and name (and path, direction where they are asked for), edges have
src, dst and type, and ``props``, a map of strings, where a property decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def find_by_name(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, id): for each wanted name the node of that path, else the only one whose path ends in ``.name``, else null.

    Every path is keyed by itself and by what follows each of its dots, so both cases are one equi-join.
    """
    parts = F.split("path", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct((i == 1).alias("exact"), F.array_join(F.slice(parts, i, F.size(parts)), ".").alias("name")))
    keyed = nodes.select("id", F.explode(tails).alias("k")).select("id", "k.exact", "k.name")
    names = wanted.select("name").distinct()
    hits = keyed.join(names, "name").groupBy("name").agg(
        F.min(F.when(F.col("exact"), F.col("id"))).alias("whole"), F.min(F.when(~F.col("exact"), F.col("id"))).alias("tail"), F.count(F.when(~F.col("exact"), F.lit(1))).alias("n")
    )
    found = F.coalesce("whole", F.when(F.col("n") == 1, F.col("tail")))
    return names.join(hits.select("name", found.alias("id")), "name", "left")


def _names(edges: DataFrame, kind: str, key: str, other: str, nodes: DataFrame) -> DataFrame:
    """(key, name): the names of the nodes at the other end of edges of a type."""
    named = nodes.select(F.col("id").alias(other), "name")
    return edges.where(F.col("type") == kind).select(key, other).join(named, other).select(key, "name")


def instances_of(edges: DataFrame) -> DataFrame:
    """(module, instances): the sorted sources of each module's ``OF_MODULE`` edges."""
    return edges.where("type = 'OF_MODULE'").groupBy(F.col("dst").alias("module")).agg(F.sort_array(F.collect_set("src")).alias("instances"))


def port_connections(edges: DataFrame) -> DataFrame:
    """(instance, port, src): ``CONNECTS`` edges by the instance their property names."""
    return edges.where("type = 'CONNECTS'").select(F.col("props")["instance"].alias("instance"), F.col("dst").alias("port"), "src").where("instance IS NOT NULL")


def modports_of(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(interface, modports): sorted names at the end of ``HAS_MODPORT`` edges."""
    rows = _names(edges, "HAS_MODPORT", "src", "dst", nodes)
    return rows.groupBy(F.col("src").alias("interface")).agg(F.sort_array(F.collect_set("name")).alias("modports"))


def package_of(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(typedef, package): the name of the owner at the start of a ``HAS_TYPEDEF`` edge, the smallest of several."""
    return _names(edges, "HAS_TYPEDEF", "dst", "src", nodes).groupBy(F.col("dst").alias("typedef")).agg(F.min("name").alias("package"))


def param_overrides(edges: DataFrame, kind: str = "OVERRIDES") -> DataFrame:
    """(instance, params): a map of parameter name to value, the smallest value of a name that is set twice."""
    rows = edges.where(F.col("type") == kind).groupBy("src", "dst").agg(F.min("value").alias("value"))
    return rows.groupBy(F.col("src").alias("instance")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("dst", "value")))).alias("params"))


def sensitivity_of(edges: DataFrame) -> DataFrame:
    """(block, signal, edge) of ``SENSITIVE_TO`` edges, the edge from their property."""
    return edges.where("type = 'SENSITIVE_TO'").select(F.col("src").alias("block"), F.col("dst").alias("signal"), F.col("props")["edge"].alias("edge")).distinct()


def ports_by_direction(nodes: DataFrame, direction: str) -> DataFrame:
    return nodes.where(F.col("direction") == direction).select("id", "name")


def reads_of(edges: DataFrame) -> DataFrame:
    """(reader, signal) of ``READS`` edges."""
    return edges.where("type = 'READS'").select(F.col("src").alias("reader"), F.col("dst").alias("signal")).distinct()


def find_drivers(edges: DataFrame) -> DataFrame:
    """(signal, driver) of ``DRIVES`` edges."""
    return edges.where("type = 'DRIVES'").select(F.col("dst").alias("signal"), F.col("src").alias("driver")).distinct()


def queryable_nodes(nodes: DataFrame, kinds: list[str]) -> DataFrame:
    return nodes.where(F.col("kind").isin(*kinds) & F.col("name").isNotNull())


def subtree_text(tokens: DataFrame) -> DataFrame:
    """(id, text): the tokens (id, position, text) of each declaration in order, joined by a space."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "text")))
    return tokens.groupBy("id").agg(F.array_join(F.transform(ordered, lambda t: t["text"]), " ").alias("text"))


def _dimensions(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(text, F.lit(r"\[[^\]]*\]"), F.lit(0)), "")


def width_of(tokens: DataFrame, names: DataFrame) -> DataFrame:
    """(id, data_type, packed_dim, unpacked_dim): what stands before and after the name (id, name) in a declaration."""
    rows = subtree_text(tokens).join(names.select("id", "name"), "id")
    declared = F.trim(F.substring_index("text", "=", 1))
    before = F.expr("trim(substring_index(substring_index(text, '=', 1), name, 1))")
    after = F.expr("substring(trim(substring_index(text, '=', 1)), length(substring_index(trim(substring_index(text, '=', 1)), name, 1)) + length(name) + 1)")
    held = F.contains(declared, F.col("name"))
    return rows.where(held).select("id", F.trim(F.regexp_replace(before, r"\s*\[[^\]]*\]\s*", " ")).alias("data_type"), _dimensions(before).alias("packed_dim"), _dimensions(after).alias("unpacked_dim"))


def default_value_of(tokens: DataFrame) -> DataFrame:
    """(id, value): what stands after the first ``=`` of a declaration that has one."""
    rows = subtree_text(tokens).where(F.contains("text", F.lit("=")))
    return rows.select("id", F.expr("trim(substring(text, instr(text, '=') + 1))").alias("value"))
