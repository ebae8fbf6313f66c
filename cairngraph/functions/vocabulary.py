"""A declarative vocabulary of node and edge types, and checks against it."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class VocabularyError(ValueError):
    """All that is wrong, together."""

    def __init__(self, problems: list[str]) -> None:
        self.problems = problems
        super().__init__("; ".join(problems))


@dataclass(frozen=True)
class EdgeType:
    name: str
    sources: tuple[str, ...] = ()
    targets: tuple[str, ...] = ()


@dataclass(frozen=True)
class Vocabulary:
    """Node types with the phase that activates them, edge types with what they may join (nothing listed: anything)."""

    nodes: dict[str, int] = field(default_factory=dict)
    edges: dict[str, EdgeType] = field(default_factory=dict)
    legacy: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def read(text: str) -> Vocabulary:
        """From JSON: {"nodes": {name: phase}, "edges": {name: {"sources": [], "targets": []}}, "legacy": {old: new}}."""
        raw = json.loads(text)
        edges = {n: EdgeType(n, tuple(e.get("sources", ())), tuple(e.get("targets", ()))) for n, e in raw.get("edges", {}).items()}
        unknown = [f"edge {n} joins unknown type {t}" for n, e in edges.items() for t in (*e.sources, *e.targets) if t not in raw.get("nodes", {})]
        if unknown:
            raise VocabularyError(unknown)
        return Vocabulary(dict(raw.get("nodes", {})), edges, dict(raw.get("legacy", {})))

    def active(self, phase: int) -> set[str]:
        return {n for n, p in self.nodes.items() if p <= phase}

    def check_edge_types(self, names: Sequence[str]) -> None:
        if bad := [f"unknown edge type {n!r}" for n in names if n not in self.edges]:
            raise VocabularyError(bad)

    def check_patterns(self, patterns: Sequence[Sequence[str]]) -> list[str]:
        """Warnings for hops that share no node type; unknown types raise."""
        self.check_edge_types([n for p in patterns for n in p])
        out = []
        for p in patterns:
            for a, b in zip(p, p[1:]):
                ends, starts = set(self.edges[a].targets) | set(self.edges[a].sources), set(self.edges[b].sources) | set(self.edges[b].targets)
                if ends and starts and not ends & starts:
                    out.append(f"{a} and {b} share no node type")
        return out

    def violations(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        """(src, dst, type, reason): edges of unknown type or with an end the type does not allow."""
        spark = edges.sparkSession
        rules = spark.createDataFrame([(e.name, list(e.sources), list(e.targets)) for e in self.edges.values()], "type string, sources array<string>, targets array<string>")
        kinds = nodes.select("id", "kind")
        rows = (
            edges.select("src", "dst", "type").join(F.broadcast(rules.withColumn("known", F.lit(True))), "type", "left")  # the vocabulary: a few hundred rows
            .join(kinds.withColumnsRenamed({"id": "src", "kind": "src_kind"}), "src", "left")
            .join(kinds.withColumnsRenamed({"id": "dst", "kind": "dst_kind"}), "dst", "left")
        )
        allowed = lambda kind, listed: (F.size(listed) == 0) | F.array_contains(listed, F.coalesce(kind, F.lit("")))
        reason = F.when(F.col("known").isNull(), "unknown type").when(~allowed("src_kind", "sources"), "source not allowed").when(~allowed("dst_kind", "targets"), "target not allowed")
        return rows.withColumn("reason", reason).where("reason IS NOT NULL").select("src", "dst", "type", "reason")

    def modernise(self, nodes: DataFrame) -> DataFrame:
        """Nodes with legacy kinds renamed."""
        if not self.legacy:
            return nodes
        table = F.create_map(*[F.lit(x) for pair in self.legacy.items() for x in pair])
        return nodes.withColumn("kind", F.coalesce(F.try_element_at(table, F.col("kind")), F.col("kind")))
