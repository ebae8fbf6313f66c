"""Steps whose tasks must not grow with the input, on small tables with a small task size."""

import re

import pytest

from cairngraph.operators import connectors, fusion, retrieval
from cairngraph.operators import traversal as T
from cairngraph.sources import lineage


@pytest.fixture
def table(spark, tmp_path, monkeypatch):
    """Rows as a file that needs more tasks than the session has shuffle partitions."""

    def write(rows, schema, name="t"):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    monkeypatch.setattr(lineage, "TASK_BYTES", 16)
    return write


def partitions(df):
    """Tasks of each exchange by keys."""
    return [int(n) for n in re.findall(r"Exchange hashpartitioning\(.*, (\d+)\), ", df._jdf.queryExecution().executedPlan().toString())]


def test_match_query_is_in_bounded_tasks(spark, table):
    names = [(f"w{i % 3} term{i:03d}", i % 5 + 1) for i in range(60)]
    index = retrieval.term_index(spark.createDataFrame(names, "name string, mention_count long"))
    asked = [(q, f"find w{q % 4}x w1 term{q:03d}") for q in range(8)] + [(20, "w99"), (20, "none"), (21, None), (22, "term001"), (22, "term002 term001")]
    # words of under 3 characters are in no index
    found = retrieval.match_query(index, table(asked, "query_id long, text string"), 2, 3)
    counts = dict(names)
    terms = {q: {n for a, t in asked if a == q and t for n in counts for w in t.split() if len(w) > 2 and w in n.split()} for q, _ in asked}
    order = lambda ns: sorted(ns, key=lambda n: (-counts[n], n))
    rows = sorted((r.query_id, r.rank, r.term, r.is_fallback) for r in found.collect())
    expected = [(q, i + 1, n, False) for q in terms if terms[q] for i, n in enumerate(order(terms[q])[:2])]
    expected += [(q, i + 1, n, True) for q, _ in asked if not terms[q] for i, n in enumerate(order(counts)[:3])]
    assert rows == sorted(expected)
    assert any(n > 4 for n in partitions(found))


def test_degrees_are_in_bounded_tasks(spark, monkeypatch):
    from cairngraph.plans import catalogue
    from cairngraph.sources.tables import driver_edges

    monkeypatch.setattr(lineage, "TASK_BYTES", 10_000)
    sf = "/root/testdata/sf0.001"
    assert all(n > 4 for n in partitions(driver_edges(spark, sf)))
    assert all(n > 4 for n in partitions(catalogue.queries()["edge_degree_stats"](spark, sf)))


def test_context_lines_take_one_exchange(spark, table):
    edges = table([("a", "t", f"b{i:02d}") for i in range(30)] * 2, "src string, type string, dst string")
    found = retrieval.context_lines(edges, 2)
    (n,) = partitions(found)
    assert n > 4
    assert [r.context for r in found.collect()] == ["a --[t]--> b00; a --[t]--> b01"]


def test_expand_leaves_seeds_out_in_bounded_tasks(spark, table):
    edges = table([("a", "b"), ("b", "c"), ("a", "c"), ("d", "a")], "src string, dst string")
    found = retrieval.expand(spark.createDataFrame([(1, "a"), (1, "b"), (2, "b")], "query_id int, id string"), edges, 5)
    assert sorted((r.query_id, r["rank"], r.term) for r in found.collect()) == [(1, 1, "c"), (1, 2, "d"), (2, 1, "a"), (2, 2, "c")]
    assert any(n > 4 for n in partitions(found))


def test_typed_signals_stay_where_they_are(spark):
    """Two type names over many signals: no exchange of the signals, whatever the plan thinks of the types' source."""
    signals = spark.range(1000).selectExpr("CAST(id AS STRING) AS id", "IF(id % 2 = 0, 'x', 'y') AS type_name")
    types = spark.range(5_000_000).selectExpr("CAST(id AS STRING) AS id", "'x' AS name")
    found = connectors.of_type_edges(signals, types)
    assert partitions(found) == []
    assert {(int(r.src) % 2, r.dst) for r in found.collect()} == {(0, "0"), (1, "_unresolved.y")}


def test_shortest_path_ends_with_its_targets(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "T") for i in range(9)], "src string, dst string, type string")
    one = lambda i: spark.createDataFrame([(i,)], "id string")
    hops, cut = [], T.cut
    T.cut = lambda df: hops.append(df.columns) or cut(df)
    try:
        (r,) = T.shortest_path(edges, one("n3"), one("n1"), 8, undirected=True).collect()
        assert (r.hop, r.path) == (2, ["n3", "n2", "n1"])
        assert sum("hop" in c for c in hops) == 3  # the seed and two hops
        assert T.shortest_path(edges, one("n3"), one("n1"), 8).collect() == []
    finally:
        T.cut = cut


def test_undirected_weights_are_in_bounded_tasks(spark, table):
    found = fusion.undirected_max_weight(table([("a", "b", 1), ("b", "a", 3), ("c", "c", 9)], "src string, dst string, weight int"))
    assert [tuple(r) for r in found.collect()] == [("a", "b", 3)]
    assert all(n > 4 for n in partitions(found))


def test_relations_read_their_texts_once(spark):
    from cairngraph.functions import text as X

    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    texts = ["A Cat is a small animal here. Dogs\tinclude many good breeds.", "Some pets such as Cats, Dogs and Birds.", "Nothing to find in this one, Sir."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    facts = X.extract_relations(docs.mapInArrow(counted, docs.schema), docs.selectExpr("doc_id", "'' AS name"))
    got = {(r.doc_id, r.predicate, r.subject) for r in facts.collect()}
    assert {(0, "is_a", "A Cat"), (0, "uses", "Dogs"), (1, "is_a", "Cats")} <= got and {d for d, _, _ in got} == {0, 1}
    assert read.value == len(texts)


def test_references_split_their_texts_once(spark, monkeypatch):
    from cairngraph.functions import text as X
    from cairngraph.plans import catalogue

    calls, whole = [], X.whole_tokens
    monkeypatch.setattr(X, "whole_tokens", lambda text: calls.append(1) or whole(text))
    catalogue.queries()["doc_reference_join"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1
