"""Lookups, substring matches, the durable edge store and the guards around them."""

import pytest
from pyspark.sql import functions as F

from cairngraph.operators import lookups, retrieval
from cairngraph.sources import lineage
from cairngraph.streaming.ingest import EdgeStore


def test_find_by_name(spark):
    nodes = spark.createDataFrame([("1", "top.a.x"), ("2", "top.b.x"), ("3", "top.b.y"), ("4", "y"), ("5", None)], "id string, path string")
    wanted = spark.createDataFrame([("top.a.x",), ("x",), ("a.x",), ("b.y",), ("y",), ("op.a.x",), ("",)], "name string")
    got = {r.name: r.id for r in lookups.find_by_name(nodes, wanted).collect()}
    assert got == {"top.a.x": "1", "x": None, "a.x": "1", "b.y": "3", "y": "4", "op.a.x": None, "": None}


def test_lookups_of_nothing(spark):
    nodes = spark.createDataFrame([], "id string, name string, kind string, direction string, path string")
    edges = spark.createDataFrame([], "src string, dst string, type string, props map<string,string>, value string")
    for found in (
        lookups.instances_of(edges), lookups.port_connections(edges), lookups.modports_of(edges, nodes), lookups.package_of(edges, nodes), lookups.param_overrides(edges),
        lookups.sensitivity_of(edges), lookups.reads_of(edges), lookups.find_drivers(edges), lookups.ports_by_direction(nodes, "in"), lookups.queryable_nodes(nodes, ["A"]),
    ):
        assert found.count() == 0


def test_direction_reads_and_drivers(spark):
    nodes = spark.createDataFrame([("1", "a", "Port", "in"), ("2", "b", "Port", "out"), ("3", None, "Port", None)], "id string, name string, kind string, direction string")
    edges = spark.createDataFrame([("p", "s", "READS"), ("p", "s", "READS"), ("q", "s", "DRIVES")], "src string, dst string, type string")
    assert [r.id for r in lookups.ports_by_direction(nodes, "in").collect()] == ["1"]
    assert sorted(r.id for r in lookups.queryable_nodes(nodes, ["Port"]).collect()) == ["1", "2"]
    assert [tuple(r) for r in lookups.reads_of(edges).collect()] == [("p", "s")] and [tuple(r) for r in lookups.find_drivers(edges).collect()] == [("s", "q")]


def test_substring_names_of_any_length(spark):
    queries = spark.createDataFrame([(1, "The ALU of a CPU"), (2, "x"), (3, ""), (4, None), (5, "naïve Été")], "query_id long, text string")
    names = spark.createDataFrame([(n,) for n in ("a", "al", "alu", "alu of", "CPU", "X", "été", "zz", "", "the alu of a cpu!")], "name string")
    got = sorted(tuple(r) for r in retrieval.match_substring(queries, names).collect())
    texts = {1: "the alu of a cpu", 2: "x", 3: "", 5: "naïve été"}
    want = sorted((q, n) for q, t in texts.items() for n in ("a", "al", "alu", "alu of", "CPU", "X", "été", "zz", "the alu of a cpu!") if n.lower() in t)
    assert got == want


def rows(spark, *triples):
    return spark.createDataFrame([(s, "p", o, 1.0, f"d{i}") for i, (s, o) in enumerate(triples)], "subject string, predicate string, object string, weight double, source string")


def test_edge_store_survives_a_restart(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    first = EdgeStore(spark, path)
    assert first.last == -1 and first.edges.count() == 0
    first.merge(rows(spark, ("a", "b"), ("a", "c")), 0)
    first.merge(rows(spark, ("a", "b")), 1)
    again = EdgeStore(spark, path)  # another driver
    assert again.last == 1
    again.merge(rows(spark, ("a", "b")), 1)  # the same batch once more
    again.merge(rows(spark, ("x", "y")), 2)
    want = {("a", "b"): 2.0, ("a", "c"): 1.0, ("x", "y"): 1.0}
    assert {(r.subject, r.object): r.weight for r in again.edges.collect()} == want
    again.compact()
    assert EdgeStore(spark, path).last == 2
    again.merge(rows(spark, ("x", "y")), 2)  # folded already
    assert {(r.subject, r.object): r.weight for r in EdgeStore(spark, path).edges.collect()} == want
    again.merge(rows(spark, ("x", "y")), 3)
    assert EdgeStore(spark, path).edges.where("subject = 'x'").first().weight == 2.0


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, name, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        lineage.shared(Session())


def test_width_and_default(spark):
    text = {"1": "logic signed [7:0] data [3:0] [1:0] = 8'h3", "2": "wire w"}
    tokens = spark.createDataFrame([(i, n, t) for i, line in text.items() for n, t in enumerate(line.split(" "))], "id string, position int, text string").orderBy(F.col("position").desc())
    names = spark.createDataFrame([("1", "data"), ("2", "w")], "id string, name string")
    assert sorted(tuple(r) for r in lookups.width_of(tokens, names).collect())[0] == ("1", "logic signed", "[7:0]", "[3:0][1:0]")
    assert [tuple(r) for r in lookups.default_value_of(tokens).collect()] == [("1", "8'h3")]
