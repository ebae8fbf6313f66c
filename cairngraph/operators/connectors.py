"""Connectors: edges and roles derived across sources.

A connector is a function of the graph frames that returns rows to add.  Role tags
follow first-writer-wins: a connector never overwrites a role set by one before it,
so the order of registration matters.
"""

from __future__ import annotations

import builtins
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairngraph.functions.text import whole_tokens
from cairngraph.operators.traversal import reach_pairs
from cairngraph.sources.lineage import cut


@dataclass(frozen=True)
class Connector:
    """name; sources that must be present; nodes, edges -> new edges (src, dst, type)."""

    name: str
    requires: tuple[str, ...]
    synthesize: Callable[[DataFrame, DataFrame], DataFrame]


class Registry:
    """Named functions; the same function may register again, another one may not."""

    def __init__(self) -> None:
        self._items: dict[str, object] = {}

    def register(self, name: str, item: object) -> None:
        if self._items.setdefault(name, item) is not item:
            raise ValueError(f"{name!r} is registered already")

    def get(self, name: str) -> object:
        if name not in self._items:
            raise KeyError(f"unknown: {name!r}; known: {sorted(self._items)}")
        return self._items[name]

    def names(self) -> list[str]:
        return list(self._items)


def extract(builders: Registry, source: str, corpus: str, paths: Sequence[str], **options) -> DataFrame | None:
    """Run a source's builder over paths; no path is no work."""
    build = builders.get(source)
    return build(corpus, list(paths), **options) if paths else None


def run_connectors(connectors: Registry, nodes: DataFrame, edges: DataFrame, only: Sequence[str] | None = None) -> DataFrame:
    """All edges with those of the connectors added, in order; a source that is required and absent raises."""
    present = {r["source"] for r in nodes.select("source").distinct().collect()}
    for name in only if only is not None else connectors.names():
        connector = connectors.get(name)
        if missing := set(connector.requires) - present:
            raise ValueError(f"{name} needs sources {sorted(missing)}")
        edges = edges.unionByName(connector.synthesize(nodes, edges)).distinct()
    return edges


def self_references(nodes: DataFrame) -> DataFrame:
    """A CONTAINS loop at every semantic node."""
    return nodes.where("category = 'semantic'").select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit("CONTAINS").alias("type"))


def code_references(snippets: DataFrame, names: DataFrame) -> DataFrame:
    """(src, dst, type, ref_text): snippets (id, corpus, kind, text) that name a declaration (id, corpus, name).

    Inline code must equal the name; a fence must hold it as a whole token.
    """
    keyed = names.select(F.col("id").alias("dst"), "corpus", F.col("name").alias("ref_text"))
    inline = snippets.where("kind = 'inline'").select(F.col("id").alias("src"), "corpus", F.trim("text").alias("ref_text"))
    fenced = snippets.where("kind = 'fence'").select(F.col("id").alias("src"), "corpus", F.explode(whole_tokens(F.col("text"))).alias("ref_text"))
    return inline.unionByName(fenced).join(keyed, ["corpus", "ref_text"]).select("src", "dst", F.lit("REFERENCES").alias("type"), "ref_text").distinct()


#: canonical decorator -> (kind it may stand on, role)
DECORATORS = {
    "property": ("PyFunction", "property"),
    "builtins.property": ("PyFunction", "property"),
    "dataclass": ("PyClass", "dataclass"),
    "dataclasses.dataclass": ("PyClass", "dataclass"),
    "pytest.fixture": ("PyFunction", "fixture"),
}
BUILTINS = tuple(sorted(n for n in dir(builtins) if not n.startswith("_")))
DESCRIPTORS = ("property", "cached_property", "functools.cached_property", "builtins.property")


def canonical(decorator: Column, aliases: Column) -> Column:
    """A decorator's text without its call, its first segment replaced by what the file imported it as."""
    bare = F.trim(F.substring_index(decorator, "(", 1))
    head = F.substring_index(bare, ".", 1)
    return F.concat(F.coalesce(F.try_element_at(aliases, head), head), F.substring(bare, F.length(head) + 1, F.lit(1 << 20)))


def decorator_roles(declarations: DataFrame) -> DataFrame:
    """(id, role) of declarations (id, kind, decorators, aliases): the outermost known decorator that suits the kind."""
    table = F.create_map(*[F.lit(x) for name, (kind, role) in DECORATORS.items() for x in (f"{kind}:{name}", role)])
    rows = declarations.select("id", "kind", "aliases", F.posexplode("decorators").alias("pos", "d"))
    roles = rows.withColumn("role", F.try_element_at(table, F.concat_ws(":", "kind", canonical(F.col("d"), F.col("aliases"))))).where("role IS NOT NULL")
    return roles.groupBy("id").agg(F.min_by("role", "pos").alias("role"))


def property_descriptors(declarations: DataFrame) -> DataFrame:
    """(id, role) of functions under a property decorator."""
    hit = F.exists("decorators", lambda d: canonical(d, F.col("aliases")).isin(*DESCRIPTORS))
    return declarations.where((F.col("kind") == "PyFunction") & hit).select("id", F.lit("property-descriptor").alias("role"))


def base_edges(classes: DataFrame) -> DataFrame:
    """(src, dst, type) from each class (id, name, qualname, bases) to the classes its bases name, in full or by their last part."""
    bases = classes.select(F.col("id").alias("src"), F.explode("bases").alias("base"))
    keys = classes.select(F.col("id").alias("dst"), F.explode(F.array_distinct(F.array("name", "qualname"))).alias("base"))
    full = bases.join(keys, "base").select("src", "dst")
    tail = bases.withColumn("base", F.substring_index("base", ".", -1)).join(keys, "base").select("src", "dst")
    return full.unionByName(tail).where("src <> dst").distinct().withColumn("type", F.lit("EXTENDS"))


def method_roles(classes: DataFrame, methods: DataFrame, method: str, role: str, chase_bases: bool = True, max_hops: int = 50) -> DataFrame:
    """(id, role) of the classes that declare a method (class_id, name), or whose ancestors do."""
    own = methods.where(F.col("name") == method).select(F.col("class_id").alias("id")).distinct()
    if not chase_bases:
        return own.withColumn("role", F.lit(role))
    above = reach_pairs(classes.select("id"), base_edges(classes), max_hops)
    inherited = above.join(own, "id").select(F.col("seed").alias("id"))
    return own.unionByName(inherited).distinct().withColumn("role", F.lit(role))


def metaclass_roles(classes: DataFrame, tagged: DataFrame) -> DataFrame:
    """(id, role) of classes (id, name, metaclass) whose metaclass has been tagged (id, role)."""
    metas = classes.select("id", F.col("name").alias("metaclass")).join(tagged, "id").select("metaclass", "role")
    return classes.select("id", F.substring_index("metaclass", ".", -1).alias("metaclass")).join(metas, "metaclass").groupBy("id").agg(F.min("role").alias("role"))


def add_roles(known: DataFrame, found: DataFrame) -> DataFrame:
    """Roles (id, role) with new ones added where there is none yet."""
    return known.unionByName(found.join(known.select("id"), "id", "left_anti"))


def of_type_edges(signals: DataFrame, types: DataFrame) -> DataFrame:
    """(src, dst, type): typed signals (id, type_name) to type nodes (id, name), or to ``_unresolved.<name>``."""
    # stored, so that its size is known: a small index leaves the signals, of few types each with very many, where they are
    index = cut(types.groupBy("name").agg(F.min("id").alias("dst")))
    joined = signals.join(index, F.col("type_name") == F.col("name"), "left")
    return joined.select(F.col("id").alias("src"), F.coalesce("dst", F.concat(F.lit("_unresolved."), F.col("type_name"))).alias("dst"), F.lit("OF_TYPE").alias("type"))


def checks_edges(assertions: DataFrame, signals: DataFrame) -> DataFrame:
    """(src, dst, type, name): assertions (id, scope, name) to signals (id, path, name).

    The scope-qualified path first, then a bare name that is unambiguous; no sentinel, no self edge.
    """
    bare = signals.groupBy("name").agg(F.min("id").alias("bare_id"), F.count("*").alias("n")).where("n = 1").select(F.col("name").alias("bare"), "bare_id")
    full = signals.groupBy("path").agg(F.min("id").alias("full_id"))
    joined = assertions.join(full, F.concat_ws(".", "scope", "name") == F.col("path"), "left").join(bare, F.col("name") == F.col("bare"), "left")
    rows = joined.select(F.col("id").alias("src"), F.coalesce("full_id", "bare_id").alias("dst"), F.lit("CHECKS").alias("type"), "name")
    return rows.where("dst IS NOT NULL AND dst <> src")




def resolve_captures(captures: DataFrame, locals_: DataFrame, module_names: DataFrame, imports: DataFrame, exports: DataFrame) -> DataFrame:
    """(capture_id, resolution, target): where a captured name comes from.

    captures: capture_id, uri, scope, name; locals_: uri, scope, name of enclosing functions; module_names: uri,
    name, id; imports: uri, name, module, item (null for a whole module); exports: module, item, id.
    Nearest wins: an enclosing scope, an import of a name exported in the corpus, a module import, the module, a builtin.
    """
    local = locals_.select("uri", "scope", "name").distinct().withColumn("is_local", F.lit(True))
    own = module_names.groupBy("uri", "name").agg(F.min("id").alias("own_id"))
    named = imports.where("item IS NOT NULL").join(exports, ["module", "item"]).groupBy("uri", "name").agg(F.min("id").alias("import_id"))
    whole = imports.where("item IS NULL").groupBy("uri", "name").agg(F.min("module").alias("module"))
    rows = captures.join(local, ["uri", "scope", "name"], "left").join(named, ["uri", "name"], "left").join(whole, ["uri", "name"], "left").join(own, ["uri", "name"], "left")
    kind = (
        F.when(F.col("is_local"), "local-in-enclosing").when(F.col("import_id").isNotNull(), "cross-file-import").when(F.col("module").isNotNull(), "module-import")
        .when(F.col("own_id").isNotNull(), "module-level").when(F.col("name").isin(*BUILTINS), "builtin").otherwise("unresolved")
    )
    return rows.withColumn("resolution", kind).select(
        "capture_id", "resolution",
        F.when(F.col("resolution") == "cross-file-import", F.col("import_id")).when(F.col("resolution") == "module-import", F.col("module")).when(F.col("resolution") == "module-level", F.col("own_id")).alias("target"),
    )
