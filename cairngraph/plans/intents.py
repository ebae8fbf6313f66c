"""Typed intents, the read-only guard and a small pattern language, planned into DataFrames.

The pattern language is a chain of typed hops:

    MATCH (a:Kind)-[:TYPE|TYPE]->(b)<-[:TYPE]-(c:Kind) WHERE a.name = 'x' AND b.kind IN ['p', 'q']
    RETURN [DISTINCT] a.id AS one, count(b.id) AS n ORDER BY n DESC LIMIT 10
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from difflib import get_close_matches

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairngraph.operators import traversal
from cairngraph.sources.tables import NODE_FIELDS

FILTERABLE = ("kind", "category", "name", "source", "corpus", "origin_id")
FORBIDDEN = ("create", "merge", "delete", "detach", "set", "remove", "drop", "copy", "alter")


class AmbiguousAnchor(ValueError):
    """More than one node answers to an anchor."""


class ReadOnlyViolation(ValueError):
    """A query holds a writing keyword."""


class PatternError(ValueError):
    """A query names something unknown, or cannot be parsed; ``suggestion`` is the nearest known name."""

    def __init__(self, kind: str, name: str, known: tuple[str, ...] = ()) -> None:
        near = get_close_matches(name, known, n=1, cutoff=0.4)
        self.kind, self.name, self.suggestion = kind, name, near[0] if near else None
        super().__init__(f"{kind}: {name}" + (f" (did you mean {near[0]}?)" if near else ""))


@dataclass(frozen=True)
class Anchor:
    """A node by id, or by kind and name."""

    id: str | None = None
    kind: str | None = None
    name: str | None = None

    def __post_init__(self) -> None:
        if (self.id is None) == (self.kind is None or self.name is None):
            raise ValueError("an anchor is an id, or a kind and a name")

    def find(self, nodes: DataFrame) -> DataFrame:
        """The anchor's id, no row where there is none; more than one raises."""
        rows = nodes.where(F.col("id") == self.id) if self.id is not None else nodes.where((F.col("kind") == self.kind) & (F.col("name") == self.name))
        found = rows.select("id").limit(2).collect()
        if len(found) > 1:
            raise AmbiguousAnchor(f"{self.kind} {self.name}")
        return nodes.sparkSession.createDataFrame([(r["id"],) for r in found], "id string")


@dataclass(frozen=True)
class FilterIntent:
    """Nodes by equality; ``limit`` is part of the intent, in order of id."""

    where: dict[str, str] = field(default_factory=dict)
    limit: int = 100

    def __post_init__(self) -> None:
        if not 1 <= self.limit <= 10_000:
            raise ValueError("limit must lie in 1..10000")
        if bad := set(self.where) - set(FILTERABLE):
            raise ValueError(f"cannot filter by {sorted(bad)}")

    def plan(self, nodes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
        for name, value in self.where.items():
            nodes = nodes.where(F.col(name) == value)
        return nodes.select(*NODE_FIELDS).orderBy("id").limit(self.limit)


@dataclass(frozen=True)
class TraverseIntent:
    """Acyclic paths from an anchor over edge types."""

    anchor: Anchor
    types: tuple[str, ...] | None = None
    direction: str = "fwd"
    depth: int = 1
    limit: int = 200

    def __post_init__(self) -> None:
        if not 1 <= self.depth <= 8 or self.direction not in ("fwd", "rev", "both"):
            raise ValueError("depth must lie in 1..8, direction be fwd, rev or both")

    def plan(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        turn = {"fwd": traversal.forward, "rev": traversal.backward, "both": traversal.both_ways}[self.direction]
        found = traversal.paths(self.anchor.find(nodes), turn(traversal.of_types(edges, self.types)), self.depth)
        return found.orderBy("hop", "nodes").limit(self.limit)


@dataclass(frozen=True)
class NeighborhoodIntent:
    """The undirected ball around an anchor."""

    anchor: Anchor
    radius: int = 1
    limit: int = 500

    def __post_init__(self) -> None:
        if not 1 <= self.radius <= 4:
            raise ValueError("radius must lie in 1..4")

    def plan(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        return traversal.reach(self.anchor.find(nodes), traversal.both_ways(edges), self.radius).orderBy("hop", "id").limit(self.limit)


def assert_read_only(text: str) -> str:
    """The text, or ReadOnlyViolation; comments and quoted strings do not count."""
    bare = re.sub(r"/\*.*?\*/|//[^\n]*", " ", text, flags=re.S)
    bare = re.sub(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"", "''", bare)
    if found := re.search(rf"\b({'|'.join(FORBIDDEN)})\b", bare, re.I):
        raise ReadOnlyViolation(found[1].upper())
    return text


FIRST = re.compile(r"\s*\((\w+)(?::(\w+))?\)")
HOP = re.compile(r"\s*(<)?-\[:([\w|]+)\]-(>)?\s*\((\w+)(?::(\w+))?\)")
CLAUSES = re.compile(r"^\s*MATCH\s+(?P<match>.+?)(?:\s+WHERE\s+(?P<where>.+?))?\s+RETURN\s+(?P<distinct>DISTINCT\s+)?(?P<ret>.+?)(?:\s+ORDER\s+BY\s+(?P<order>.+?))?(?:\s+LIMIT\s+(?P<limit>\d+))?\s*;?\s*$", re.I | re.S)
ITEM = re.compile(r"^(?:(?P<fn>count|collect|min|max|sum)\s*\(\s*(?P<d>distinct\s+)?)?(?P<var>\w+)\.(?P<prop>\w+)\s*\)?(?:\s+AS\s+(?P<alias>\w+))?$", re.I)
TEST = re.compile(r"^(\w+)\.(\w+)\s*(=|<>|IN)\s*(.+)$", re.I | re.S)


def run_pattern(text: str, nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = (), types: tuple[str, ...] = ()) -> DataFrame:
    """Plan a pattern query as a chain of equi-joins.

    kinds and types: the known names, for errors with suggestions; empty means unchecked.  Attributes are joined
    only for variables that WHERE, RETURN or a kind ask about; hops carry ids alone.
    """
    assert_read_only(text)
    m = CLAUSES.match(text)
    if not m:
        raise PatternError("syntax", text)
    first = FIRST.match(m["match"])
    if not first:
        raise PatternError("syntax", m["match"])
    variables = {first[1]: first[2]}
    order, at, hops = [first[1]], first.end(), []
    while at < len(m["match"].rstrip()):
        hop = HOP.match(m["match"], at)
        if not hop or (hop[1] and hop[3]) or hop[4] in variables:
            raise PatternError("syntax", m["match"][at:])
        hops.append((order[-1], hop[4], hop[2].split("|"), "rev" if hop[1] else "fwd" if hop[3] else "both"))
        variables[hop[4]] = hop[5]
        order.append(hop[4])
        at = hop.end()
    for kind in filter(None, variables.values()):
        if kinds and kind not in kinds:
            raise PatternError("unknown_label", kind, kinds)
    tests: dict[str, list[Column]] = {v: [] for v in variables}
    used: dict[str, set[str]] = {v: set() for v in variables}

    def prop(var: str, name: str) -> str:
        if var not in variables:
            raise PatternError("unknown_variable", var, tuple(variables))
        if name not in NODE_FIELDS:
            raise PatternError("unknown_property", name, NODE_FIELDS)
        used[var].add(name)
        return name

    for part in re.split(r"\s+AND\s+", m["where"] or "", flags=re.I) if m["where"] else []:
        t = TEST.match(part.strip())
        if not t:
            raise PatternError("syntax", part)
        values = [a or b for a, b in re.findall(r"'([^']*)'|(-?\d+)", t[4])]
        column = F.col(prop(t[1], t[2])).cast("string")
        tests[t[1]].append({"=": lambda c, v: c == v[0], "<>": lambda c, v: c != v[0], "IN": lambda c, v: c.isin(*v)}[t[3].upper()](column, values))
    items = []
    for part in m["ret"].split(","):
        i = ITEM.match(part.strip())
        if not i:
            raise PatternError("syntax", part)
        prop(i["var"], i["prop"])
        items.append((i["fn"], bool(i["d"]), f"{i['var']}_{i['prop']}", i["alias"] or f"{i['var']}_{i['prop']}"))

    def side(var: str) -> DataFrame | None:
        need = used[var] - {"id"}
        if not need and not variables[var] and not tests[var]:
            return None
        rows = nodes if not variables[var] else nodes.where(F.col("kind") == variables[var])
        for test in tests[var]:
            rows = rows.where(test)
        return rows.select(F.col("id").alias(f"{var}_id"), *[F.col(c).alias(f"{var}_{c}") for c in sorted(need)])

    state = side(order[0])
    if state is None:
        state = nodes.select(F.col("id").alias(f"{order[0]}_id"))
    for source, target, kinds_of, direction in hops:
        for kind in kinds_of:
            if types and kind not in types:
                raise PatternError("unknown_edge", kind, types)
        turn = {"fwd": traversal.forward, "rev": traversal.backward, "both": traversal.both_ways}[direction]
        links = turn(traversal.of_types(edges, kinds_of)).select(F.col("src").alias(f"{source}_id"), F.col("dst").alias(f"{target}_id"))
        state = state.join(links, f"{source}_id")
        if (right := side(target)) is not None:
            state = state.join(right, f"{target}_id")
    plain = [(c, a) for fn, _, c, a in items if not fn]
    calls = {"min": F.min, "max": F.max, "sum": F.sum, "collect": lambda c: F.array_sort(F.collect_list(c))}
    folds = []
    for fn, once, c, a in items:
        if fn and fn.lower() == "count":
            folds.append((F.count_distinct(c) if once else F.count(c)).alias(a))
        elif fn:
            folds.append(calls[fn.lower()](c).alias(a))
    if folds:
        out = state.groupBy(*[F.col(c).alias(a) for c, a in plain]).agg(*folds)
    else:
        out = state.select(*[F.col(c).alias(a) for c, a in plain])
    out = out.select(*[a for *_, a in items])
    if m["distinct"]:
        out = out.distinct()
    if m["order"]:
        keys = [k.strip().split() for k in m["order"].split(",")]
        out = out.orderBy(*[F.col(k[0].replace(".", "_")).desc() if k[-1].upper() == "DESC" else F.col(k[0].replace(".", "_")) for k in keys])
    return out.limit(int(m["limit"])) if m["limit"] else out
