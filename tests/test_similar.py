"""Similar vectors in cells, and what is made of their pairs."""

import random

import numpy as np

from cairngraph.operators import resolution, similar


def merged_in_order(rows):
    """The definition of ``greedy_merge``, pair by pair."""
    gone, out = set(), set()
    for a, b, g, s, m, n in sorted(rows):
        keep, drop = (a, b) if m >= n else (b, a)
        if (g, b) not in gone and (g, drop) not in gone:
            gone.add((g, drop))
            out.add((keep, drop, s))
    return out


def test_greedy_merge_without_a_pass_in_order(spark):
    rng = random.Random(3)
    rows = []
    for g in range(40):
        mentions = [rng.randint(1, 3) for _ in range(12)]
        rows += [(g * 100 + a, g * 100 + b, g, rng.random(), mentions[a], mentions[b]) for a in range(12) for b in range(a + 1, 12) if rng.random() < 0.3]
    merged = resolution.greedy_merge(spark.createDataFrame(rows, "a int, b int, g int, similarity double, mentions_a int, mentions_b int"))
    assert {tuple(r) for r in merged.select("canonical", "duplicate", "similarity").collect()} == merged_in_order(rows)
    assert "FlatMapGroups" not in merged._jdf.queryExecution().executedPlan().toString()


def test_similar_pairs_in_cells(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(i % 3), (rng.normal(size=3) + 0.7).astype("float32").tolist()) for i in range(150)]
    rows += [(150, 0, rows[0][2]), (151, 0, [0.0, 0.0, 0.0]), (152, None, [1.0, 1.0, 1.0]), (153, 0, [1.0, 1.0]), (154, 0, [1.0, 1.0]), (155, 0, None), (156, 1, [None, 1.0, 1.0]), (157, 7, [1.0, 0.0, 0.0]), (0, 0, [1.0, 1.0, 1.0])]
    want = {}
    for i, g, v in rows:
        for j, h, w in rows:
            if i < j and g == h is not None and v and w and len(v) == len(w) and None not in v + w and any(v) and any(w):
                dots = [sum(x * y for x, y in zip(p, q)) for p, q in ((v, w), (v, v), (w, w))]
                if (s := dots[0] / (dots[1] ** 0.5 * dots[2] ** 0.5)) >= 0.9:
                    want.setdefault((i, j, g), []).append(round(s, 9))
    df = spark.createDataFrame(rows, "id long, label int, embedding array<float>")
    for block in (8192, 16):
        got = {}
        for r in similar.pairs(df, "label", 0.9, block).collect():
            got.setdefault((r.a, r.b, r.g), []).append(round(r.similarity, 9))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
        edges = spark.createDataFrame([(a, b) for a, b, _ in want], "src long, dst long")
        members = lambda df: {tuple(r) for r in resolution.connected_components(df).collect()}
        assert members(similar.links(df, "label", 0.9, block)) == members(edges)


def test_similar_vectors_are_not_listed_to_find_components(spark):
    """300 copies of one vector are 44850 pairs, but 299 links."""
    df = spark.createDataFrame([(i, 0, [1.0, 2.0]) for i in range(300)], "id long, label int, embedding array<float>")
    assert similar.pairs(df, "label", 0.3).count() == 44850
    assert similar.links(df, "label", 0.3).count() == 299


def test_label_propagation_reads_its_edges_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [(1, 2, 5), (2, 3, 5), (1, 3, 5), (7, 8, 1)]
    edges = spark.createDataFrame(rows, "src long, dst long, weight long")
    labels = resolution.label_propagation(edges.mapInArrow(counted, edges.schema), 2)
    # 1 and 2 hear 2 and 1 first, 3 hears 1; then everyone but 1 hears 1 at least as loud
    assert dict(labels.collect()) == {1: 1, 2: 1, 3: 1, 7: 7, 8: 8}
    assert read.value == len(rows)
