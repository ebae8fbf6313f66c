"""The Markdown queries read documents beside their literal notes."""

from cairngraph.plans import catalogue


def test_markdown_queries_read_documents(spark, tmp_path):
    rows = [(1, "# Own\nsee `delta`\n## Own", "en", "s", 1), (9, "plain", "en", "s", 1), (10, None, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    found = catalogue.queries()
    heads = sorted(tuple(r) for r in found["md_headings"](spark, str(tmp_path)).collect())
    assert heads == [(1, 0, 1, "Intro", "intro"), (1, 0, 1, "Own", "own"), (1, 2, 2, "Own", "own-1"), (1, 6, 2, "Usage", "usage"), (1, 7, 1, "Intro", "intro-1")]
    code = sorted(tuple(r) for r in found["md_inline_code"](spark, str(tmp_path)).collect())
    assert code == [(1, 1, "alpha"), (1, 1, "delta"), (1, 8, "beta"), (2, 0, "gamma")]
