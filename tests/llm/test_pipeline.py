"""The pipeline's stages against brute force, and the query registry."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute
import corpus_pipeline

from cairngraph.llm import catalogue, mixing

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of every stage."""
    docs, out = catalogue.documents(spark, SF), []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF).cache()
        after.count()
        out.append((name, docs, after))
        docs = after
    return {name: (a, b) for name, a, b in out}


def texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns_stay(stages):
    for name, (before, after) in stages.items():
        if name != "packing":
            assert after.columns == before.columns


def test_language_keeps_clean_documents(stages):
    before, after = stages["language_id"]
    assert after.count() == before.where("text rlike '[A-Za-z]'").count()


def test_line_stage(stages):
    before, after = stages["line_dedup"]
    want = {d: t for d, t in brute.line_removal(texts(before)).items() if brute.WORDS.search(t or "")}
    assert dict(texts(after)) == want


def test_near_stage(stages):
    before, after = stages["near_dedup"]
    want = brute.near_components(texts(before), 5, 80)
    assert {d for d, _ in texts(after)} == {d for d, (_, c) in want.items() if c == d}


def test_mixing_stage(stages):
    before, after = stages["mixing"]
    targets = {(r.source_size, r.target) for r in mixing.mix(before).collect()}
    words = sum(len(brute.WORDS.findall(t)) for _, t in texts(after))
    longest = max(len(brute.WORDS.findall(t)) for _, t in texts(before))
    assert abs(words - sum(t for _, t in targets)) <= longest * len(targets)


def test_packing_stage(stages):
    before, after = stages["packing"]
    assert after.where("start = 0").count() == before.count()


def test_every_operator_is_registered():
    names = list(catalogue.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
