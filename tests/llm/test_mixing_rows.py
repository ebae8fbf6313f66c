"""Repeated rows of the mix, against its oracle SQL."""

import duckdb
import pytest

from cairngraph.llm import mixing

ROWS = [(1, "a b c", "s"), (1, "a b c", "s"), (2, None, "s"), (2, None, "s"), (2, "", "s"), (3, " \t", "s"), (3, " \t", "s")]
ROWS += [(None, None, "s")] * 3 + [(None, "", "t"), (None, "", "t"), (None, "d e", "t"), (None, "d e", "t"), (4, None, None), (4, None, None), (5, "f g h i", "t")]


@pytest.mark.parametrize("rows", [ROWS, [(7, None, "s")] * 4, [r for r in ROWS if r[1] not in ("a b c", "d e", "f g h i")]])
def test_repeated_empty_and_null_id_rows_stay(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(map(str, (tuple(r) for r in mixing.mix(df.repartition(3)).collect())))
    con = duckdb.connect()
    con.sql("CREATE TABLE documents(doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    want = con.sql(mixing.oracle()).fetchall()
    assert len(got) == len(rows)
    assert got == sorted(map(str, want))
