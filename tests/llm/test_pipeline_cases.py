"""Every stage on nulls, empty and very long texts, repeated rows, null ids, an extra column, and on an empty table."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    words = [f"{a}{b}{c}" for a in ("na", "te", "ro", "mi", "su", "ka") for b in ("n", "s", "t", "ra", "el") for c in ("ab", "cd", "ef", "gh", "ij", "kl", "mn", "op", "qr", "st", "uv", "wx")]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    one = make(120)
    rows = [(1, one, "en", "a", 3), (2, one, "en", "b", 3), (2, one, "en", "b", 3), (3, one + " more", "en", None, 3), (4, make(40_000), "en", "a", 3), (None, make(90), None, None, None)]
    rows += [(None, None, "en", "a", 0), (5, None, None, "a", 0), (6, "", "en", "a", 0), (7, " \n\t\n", "en", None, 0), (8, "word", "fr", "c", 4), (9, "x" * 200_000, "en", "c", 4)]
    rows += [(10 + i, make(60), "en", f"s{i % 3}", 9) for i in range(30)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("k1", F.lit("extra")).repartition(3)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_cases(spark, docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    rows = stage(spark, docs, "").collect()
    assert rows
    empty = stage(spark, docs.where("false"), "")
    assert empty.count() == 0
    if name != "packing":
        assert empty.columns == docs.columns == list(rows[0].asDict())
        assert {r.k1 for r in rows} == {"extra"}
    held = {r.doc_id for r in rows}
    if name == "language_id":  # no text or no letter: rejected; a null id is no reason
        assert not held & {5, 6, 7} and {1, 2, 3, 4, None} <= held
    if name == "line_dedup":  # copies lose their lines, and with them their place; rows of one doc_id are one document
        assert 1 in held and 2 not in held and None in held
    if name == "near_dedup":
        assert 1 in held and not held & {2, 3} and {5, 6, 7, None} <= held
    if name == "mixing":  # documents without words are never taken
        assert not held & {5, 6, 7} and len(rows) <= 3 * docs.count()
    if name == "packing":
        assert held == {r.doc_id for r in docs.collect()}
