"""Operators on the seven-node graph whose answers are known by hand, and on small literal tables."""

import pytest
from pyspark.sql import functions as F

from cairngraph.functions import text as X
from cairngraph.operators import audit, fusion, resolution, retrieval
from cairngraph.operators import traversal as T
from cairngraph.plans import intents as I
from cairngraph.sources import lifecycle
from cairngraph.sources.tables import NODE_FIELDS
from cairngraph.streaming import ingest

NODES = [("M1", "Module", "top"), ("X1", "Module", "other"), ("pA", "Port", "pA"), ("pB", "Port", "pB"), ("pC", "Port", "pC"), ("B1", "Block", "b"), ("F1", "Function", "f")]
EDGES = [("M1", "pA", "HAS_PORT"), ("M1", "pB", "HAS_PORT"), ("M1", "F1", "HAS_FUNCTION"), ("pA", "B1", "DRIVES"), ("B1", "pB", "DRIVES"), ("pB", "pC", "READS"), ("M1", "F1", "CALLS")]


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame(NODES, "id string, kind string, name string")
    for c in NODE_FIELDS:
        if c not in nodes.columns:
            nodes = nodes.withColumn(c, F.lit(None).cast("string"))
    return nodes.select(*NODE_FIELDS).cache(), spark.createDataFrame(EDGES, "src string, dst string, type string").cache()


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def one(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_filter_intent(graph):
    assert ids(I.FilterIntent({"kind": "Port"}).plan(graph[0])) == ["pA", "pB", "pC"]
    with pytest.raises(ValueError):
        I.FilterIntent({"colour": "red"})
    with pytest.raises(ValueError):
        I.FilterIntent({}, 0)


def test_anchor(graph, spark):
    nodes, _ = graph
    assert ids(I.Anchor(kind="Module", name="top").find(nodes)) == ["M1"]
    assert ids(I.Anchor(id="nothing").find(nodes)) == []
    with pytest.raises(I.AmbiguousAnchor):
        I.Anchor(kind="Module", name="top").find(nodes.withColumn("name", F.lit("top")))
    with pytest.raises(ValueError):
        I.Anchor(id="a", kind="b", name="c")


def test_traverse_and_ball(graph):
    nodes, edges = graph
    found = I.TraverseIntent(I.Anchor(id="M1"), ("HAS_PORT",)).plan(nodes, edges).collect()
    assert sorted(r["nodes"][-1] for r in found) == ["pA", "pB"]
    assert {"pA", "pB", "F1"} <= set(ids(I.NeighborhoodIntent(I.Anchor(id="M1"), 1).plan(nodes, edges)))


def test_neighbours_by_mode(graph, spark):
    _, edges = graph
    assert ids(T.neighbors_default(edges, one(spark, "pB"), 2)) == ["B1", "M1", "pC"]
    assert ids(T.neighbors_undirected(edges, one(spark, "pC"), 1)) == ["pB"]
    assert ids(T.neighbors_typed(edges, one(spark, "B1"), ["DRIVES"], 2)) == ["pA", "pB"]
    assert ids(T.neighbors_typed(edges, one(spark, "B1"), ["DRIVES"], 2, mixed=False)) == ["pA", "pB"]


def test_cones(graph, spark):
    _, edges = graph
    assert ids(T.cone_of_influence(edges, one(spark, "pB"))) == ["B1", "pA", "pB"]
    assert ids(T.forward_cone(edges, one(spark, "pC"))) == ["pB", "pC"]


def test_cycle_ends(spark):
    ring = spark.createDataFrame([("a", "b", "E"), ("b", "c", "E"), ("c", "a", "E")], "src string, dst string, type string")
    assert {(r.id, r.hop) for r in T.reach(one(spark, "a"), ring).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert len(T.paths(one(spark, "a"), ring, 5).collect()) == 2


def test_shortest_path_and_pattern(graph, spark):
    _, edges = graph
    found = T.shortest_path(edges, one(spark, "M1"), one(spark, "pC"), 8).collect()
    assert [(r.hop, r.path) for r in found] == [(2, ["M1", "pB", "pC"])]
    rows = T.path_pattern(one(spark, "M1"), edges, ["HAS_PORT", "DRIVES"]).collect()
    assert {(r.terminal, tuple(r.nodes)) for r in rows} == {("B1", ("M1", "pA", "B1"))}


def test_pattern_queries(graph):
    nodes, edges = graph
    rows = I.run_pattern("MATCH (m:Module)-[:HAS_PORT]->(p:Port) WHERE m.name = 'top' RETURN p.name AS port ORDER BY port", nodes, edges)
    assert [r.port for r in rows.collect()] == ["pA", "pB"]
    back = I.run_pattern("MATCH (p:Port)<-[:HAS_PORT|HAS_FUNCTION]-(m) RETURN m.id AS m, count(DISTINCT p.id) AS n", nodes, edges)
    assert [(r.m, r.n) for r in back.collect()] == [("M1", 2)]
    with pytest.raises(I.PatternError) as e:
        I.run_pattern("MATCH (p:Prt)-[:HAS_PORT]->(q) RETURN p.id", nodes, edges, kinds=("Port", "Module"))
    assert e.value.suggestion == "Port"


@pytest.mark.parametrize("text", ["MATCH (a) DELETE a", "match (a) set a.x = 1", "CREATE (a)"])
def test_writes_are_refused(text):
    with pytest.raises(I.ReadOnlyViolation):
        I.assert_read_only(text)


def test_quoted_keywords_pass():
    assert I.assert_read_only("MATCH (a:K) WHERE a.name = 'delete me' RETURN a.id // drop")


def test_fuse(spark):
    rows = [("a", "p", "b", 1.0, 0.5, "low", False, "s1", "x"), ("a", "p", "b", 2.0, 0.5, "high", True, "s2", "x"), ("a", "p", "a", 9.0, 1.0, "low", True, "s1", None)]
    t = spark.createDataFrame(rows, "subject string, predicate string, object string, weight double, confidence double, confidence_tier string, resolved boolean, source string, slice string")
    (r,) = fusion.fuse_triples(t).collect()
    assert (r.weight, round(r.confidence, 9), r.confidence_tier, r.resolved, r.sources, r.slice, r.n_observations) == (3.0, 0.75, "high", True, ["s1", "s2"], "x", 2)


def test_upsert(spark):
    rows = [("Foo", 1, "concept", None, "s1", None), ("FOO", 2, "Module", "ast", "s2", True), ("foo", 3, "Port", "text", "s1", False)]
    (r,) = fusion.upsert_entities(spark.createDataFrame(rows, "name string, seq long, type string, layer string, source string, is_test boolean")).collect()
    assert (r.name, r.type, r.layer, r.is_test, r.mention_count, r.sources) == ("Foo", "Module", "ast", False, 3, ["s1", "s2"])


def test_remove_by_source_drops_shared_edges(spark):
    e = spark.createDataFrame([("a", ["s1"]), ("b", ["s1", "s2"])], "name string, sources array<string>")
    left, edges = fusion.remove_by_source(e, e, "s1")
    assert [(r.name, r.sources) for r in left.collect()] == [("b", ["s2"])] and edges.count() == 0


def test_budget_keeps_one(spark):
    rows = spark.createDataFrame([("k", 1, 5), ("k", 2, 50)], "key string, seq int, size int")
    assert [r.seq for r in fusion.within_budget(rows, "key", "seq", "size", 10).collect()] == [2]
    assert fusion.within_budget(rows, "key", "seq", "size", 10, at_least_one=False).count() == 0


def test_audits(spark):
    things = one(spark, "t1", "t2", "t3")
    links = spark.createDataFrame([("t1", "m1", True, "low"), ("t2", "m2", False, "high"), ("t1", "m3", None, None)], "src string, dst string, resolved boolean, tier string")
    assert ids(audit.orphans(things, links)) == ["t2", "t3"]
    modules = one(spark, "m1", "m2", "m3")
    assert ids(audit.coverage_gaps(modules, links)) == ["m2"] and ids(audit.coverage_gaps(modules, links, "medium")) == ["m1", "m2"]
    down = spark.createDataFrame([("m1", "m2")], "src string, dst string")
    assert ids(audit.coverage_gaps_transitive(modules, one(spark, "m1"), down)) == ["m3"]


def test_greedy_merge_order(spark):
    pairs = spark.createDataFrame([("a", "b", "g", 0.9, 1, 5), ("a", "c", "g", 0.9, 1, 1), ("b", "c", "g", 0.9, 5, 1)], "a string, b string, g string, similarity double, mentions_a int, mentions_b int")
    assert {(r.canonical, r.duplicate) for r in resolution.greedy_merge(pairs).collect()} == {("b", "a"), ("a", "c")}


def test_components_and_communities(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (7, 7)], "src int, dst int")
    found = resolution.connected_components(edges)
    assert {(r.node, r.component) for r in found.collect()} == {(2, 2), (3, 2), (4, 2), (5, 2), (8, 8), (9, 8)}
    assert {r.community for r in resolution.communities(found).collect()} == {"2", "-1"}


def test_prose_rules(spark):
    text = "# Skipped Header\nTensorFlow is a machine learning framework. RAG uses dense vectors. Tools such as NumPy, Pandas. A Thing is a subset of bigger things here."
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    names = X.extract_entities(docs, spark.createDataFrame([("THE",)], "word string"))
    found = {(r.name, r.type) for r in names.collect()}
    assert ("TensorFlow", "technology") in found and ("RAG", "acronym") in found
    facts = {(r.subject, r.predicate, r.object) for r in X.extract_relations(docs, names).collect()}
    assert ("TensorFlow", "is_a", "machine learning framework") in facts and ("RAG", "uses", "dense vectors") in facts
    assert any(p == "subset_of" for _, p, _ in facts)


def test_expand_and_context(spark, graph):
    _, edges = graph
    seeds = spark.createDataFrame([(1, "B1")], "query_id int, id string")
    assert [r.term for r in retrieval.expand(seeds, edges, 5).orderBy("rank").collect()] == ["pA", "pB"]
    lines = {r.src: r.context for r in retrieval.context_lines(edges, 1).collect()}
    assert lines["M1"] == "M1 --[CALLS]--> F1"


def test_source_at(spark):
    df = spark.createDataFrame([("héllo",)], "t string").select(lifecycle.source_at(F.col("t"), F.lit(0), F.lit(99)).alias("b"))
    assert bytes(df.first().b) == "héllo".encode()
    with pytest.raises(Exception, match="span out of order"):
        spark.createDataFrame([("x",)], "t string").select(lifecycle.source_at(F.col("t"), F.lit(2), F.lit(1))).collect()


def test_schema_versions():
    lifecycle.check_version("1.0.0")
    with pytest.raises(ValueError):
        lifecycle.check_version("2.0.0")
    with pytest.raises(ValueError):
        lifecycle.check_version("1.0.0", policy="exact")


def test_snapshot_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one")
    assert lifecycle.snapshot(spark, str(tmp_path / "in"), "s", "c").first().byte_length == 3
    triples = spark.createDataFrame([("a", "p", "b", 1.0, "s1"), ("a", "p", "b", 2.0, "s2"), ("a", "p", "a", 1.0, "s1")], "subject string, predicate string, object string, weight double, source string")
    triples.repartition(2).write.parquet(str(tmp_path / "t"))
    store = ingest.EdgeStore(spark)
    store.run(spark.readStream.schema(triples.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "t")), str(tmp_path / "ck"))
    (r,) = store.edges.collect()
    assert (r.weight, r.n_observations, r.sources) == (3.0, 2, ["s1", "s2"])
    store.merge(triples, 0)  # an old batch again
    assert store.edges.first().weight == 3.0
