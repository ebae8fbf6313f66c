"""The one-line query form, canned queries and golden questions.

``role=module name=top`` filters (all terms hold); ``from=a,b via=T,U depth=3 direction=rev`` walks.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairngraph.operators import traversal as T

FILTERS = {"role": "role", "kind": "kind", "name": "name", "path": "path", "file": "file", "id": "id"}


@dataclass
class Line:
    filters: dict[str, str] = field(default_factory=dict)
    start: tuple[str, ...] = ()
    via: tuple[str, ...] = ()
    depth: int = 1
    direction: str = "fwd"


def parse(text: str) -> Line:
    """A query line; anything unknown raises ValueError."""
    if not text.strip():
        raise ValueError("empty query")
    out = Line()
    for token in text.split():
        key, sep, value = token.partition("=")
        if not sep:
            raise ValueError(f"not key=value: {token}")
        if key == "from":
            out.start = tuple(x for x in value.split(",") if x)
        elif key == "via":
            out.via = tuple(x for x in value.split(",") if x)
        elif key == "depth":
            if not value.isdigit():
                raise ValueError(f"depth is no number: {value}")
            out.depth = int(value)
        elif key == "direction":
            if value not in ("fwd", "rev"):
                raise ValueError(f"direction is fwd or rev, not {value}")
            out.direction = value
        elif key in FILTERS:
            out.filters[key] = value
        else:
            raise ValueError(f"unknown key: {key}")
    return out


def select(nodes: DataFrame, filters: dict[str, str | Sequence[str]]) -> DataFrame:
    """Nodes by equality, or membership for a list; a column that is not there matches nothing."""
    for key, value in filters.items():
        column = key.removesuffix("_in")
        if column not in nodes.columns:
            return nodes.where(F.lit(False))
        nodes = nodes.where(F.col(column).isin(*value)) if not isinstance(value, str) else nodes.where(F.col(column) == value)
    return nodes


def walk(nodes: DataFrame, edges: DataFrame, start: Sequence[str], via: Sequence[str], depth: int, direction: str = "fwd") -> tuple[DataFrame, DataFrame]:
    """(ids with hops, edges walked) from several nodes over some types."""
    seeds = nodes.where(F.col("id").isin(*start)).select("id")
    links = T.of_types(edges, via or None)
    found = T.reach(seeds, T.forward(links) if direction == "fwd" else T.backward(links), depth)
    near, far = ("src", "dst") if direction == "fwd" else ("dst", "src")
    walked = links.join(found.where(F.col("hop") < depth).select(F.col("id").alias(near)), near, "left_semi").join(found.select(F.col("id").alias(far)), far, "left_semi")
    return found, walked


def run_line(text: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The ids a query line stands for."""
    line = parse(text)
    if line.start and line.via:
        return walk(nodes, edges, line.start, line.via, line.depth, line.direction)[0].select("id")
    return select(nodes, line.filters).select("id")


def run_canned(spec: dict, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of a canned query: filter, reverse_traverse, multi_anchor_traverse or path."""
    kind = spec["kind"]
    if kind == "filter":
        return select(nodes, spec["where"]).select("id")
    if kind in ("reverse_traverse", "multi_anchor_traverse"):
        direction = "rev" if kind == "reverse_traverse" else spec.get("direction", "fwd")
        return walk(nodes, edges, spec["from"], spec["via"], spec.get("depth", 1), direction)[0].select("id")
    if kind == "path":
        ends = lambda key: nodes.where(F.col("id") == spec[key]).select("id")
        found = T.shortest_path(T.forward(T.of_types(edges, spec["via"])), ends("from"), ends("to"), spec.get("depth", 8))
        return found.select(F.explode("path").alias("id"))
    raise ValueError(f"unknown kind of query: {kind}")


GOLDEN = "id string, question string, gold_entities array<string>, gold_answer string, category string, tags array<string>"
NEEDED = ("id", "question", "gold_entities", "gold_answer")


def golden_questions(spark: SparkSession, text: str) -> DataFrame:
    """Golden questions from a JSON list; a missing key or a repeated id raises."""
    rows, seen = json.loads(text), set()
    for n, row in enumerate(rows):
        if missing := [k for k in NEEDED if k not in row]:
            raise ValueError(f"question {n} lacks {missing}")
        if row["id"] in seen:
            raise ValueError(f"question id {row['id']!r} comes twice")
        seen.add(row["id"])
    return spark.createDataFrame([(r["id"], r["question"], r["gold_entities"], r["gold_answer"], r.get("category"), r.get("tags", [])) for r in rows], GOLDEN)


def evaluate(golden: DataFrame, predictions: DataFrame) -> DataFrame:
    """Precision, recall and F1 of predictions (id, predicted) for each question; a question without one counts as empty."""
    from cairngraph.operators.audit import precision_recall

    rows = golden.join(predictions, "id", "left").withColumn("predicted", F.coalesce("predicted", F.array().cast("array<string>")))
    return precision_recall(rows, "predicted", "gold_entities")
