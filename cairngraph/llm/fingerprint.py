"""Document fingerprints by a threshold-scaled sketch.

A sketch keeps every shingle hash below a fixed fraction of the hash range.  The
rule is per hash, so the sketch of a union is the union of sketches, and the
share of A's kept hashes that B also keeps estimates the containment of A in B
whatever the two lengths.  A text none of whose hashes is kept would have an
empty sketch; it keeps its smallest hash instead, so that equal short texts still
agree and different ones do not.

Defined cases: a null text counts as empty; a text without words has the empty
fingerprint; texts of fewer words than the shingle length are one shingle; equal
fingerprints have likeness 1 and an empty one has likeness 0 to any other.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairngraph.llm.storage import small_batches
from cairngraph.llm.textbatch import U64, word_slices

SHINGLE, FRACTION, HEX = 5, 1 / 8, 10
ROWS_PER_RANGE, MAX_RANGES = 250, 20_000


def sketches(texts: pa.Array, shingle: int = SHINGLE, fraction: float = FRACTION) -> list[np.ndarray]:
    """The sorted distinct kept hashes of each text, cut to 40 bits."""
    limit = U64(int(fraction * 2**64) - 1)
    shift = U64(64 - 4 * HEX)
    out: list[np.ndarray] = []
    for i, j, words in word_slices(texts):
        doc, value = words.shingles(shingle)
        keep = value <= limit
        n = j - i
        has = np.zeros(n, bool)
        has[doc[keep]] = True
        bare = np.flatnonzero(~has & (words.count > 0))
        if len(bare):
            first, last = np.searchsorted(doc, bare), np.searchsorted(doc, bare, side="right")
            least = [a + int(np.argmin(value[a:b])) for a, b in zip(first, last)]
            keep[least] = True
        doc, value = doc[keep], value[keep] >> shift
        order = np.lexsort((value, doc))
        doc, value = doc[order], value[order]
        if len(doc):
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
            doc, value = doc[new], value[new]
        out += np.split(value, np.searchsorted(doc, np.arange(1, n)))
    return out


def encode(sketch: np.ndarray) -> str:
    """Ten hexadecimal digits a hash, ascending."""
    return sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - HEX // 2 :].tobytes().hex()


def decode(fingerprint: str) -> np.ndarray:
    return np.array([int(fingerprint[i : i + HEX], 16) for i in range(0, len(fingerprint), HEX)], U64)


def merge(a: str, b: str) -> str:
    """The fingerprint of two texts taken together (as sets of shingles)."""
    both = np.union1d(decode(a), decode(b))
    kept = both[both < U64(int(FRACTION * 2 ** (4 * HEX)))]
    return encode(kept if len(kept) else both[:1])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated containment of the sketch with fewer hashes in the other."""
    if len(a) == len(b) and (a == b).all():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """Add ``fingerprint``, ``n_kept`` to any table with a text column; all other columns stay."""

    @F.pandas_udf("struct<fingerprint string, n_kept long>")
    def sketch(column: pd.Series) -> pd.DataFrame:
        found = sketches(pa.array(column, pa.string(), from_pandas=True), shingle, fraction)
        return pd.DataFrame({"fingerprint": [encode(x) for x in found], "n_kept": [len(x) for x in found]})

    made = docs.withColumn("__sketch", sketch(F.col(text)))
    return made.withColumns({"fingerprint": F.col("__sketch.fingerprint"), "n_kept": F.col("__sketch.n_kept")}).drop("__sketch")


def in_order(docs: DataFrame) -> DataFrame:
    """Documents in ranges of doc_id, each range followed by the first row of the next one.

    Returns (range, ahead, key, doc_id, text) sorted by the first four within each partition; ahead marks
    the row lent from the next range (after the last: from the first).  One shuffle of the texts; what
    the driver sees is one number a range, of at most ``MAX_RANGES``.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(-(2**63))).alias("key"))
    n = rows.count()
    parts = max(1, min(MAX_RANGES, math.ceil(n / ROWS_PER_RANGE)))
    bounds = rows.approxQuantile("key", [i / parts for i in range(1, parts)], 1 / (4 * parts)) if n and parts > 1 else []
    edges = np.unique(np.array(bounds, np.float64)).astype(np.int64)

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, key.to_numpy(), side="right").astype(np.int32))

    heads = sorted(tuple(r) for r in rows.select("key", range_of("key").alias("range")).groupBy("range").agg(F.min("key")).collect())
    before = {head: heads[i - 1][0] for i, (_, head) in enumerate(heads)}

    @F.pandas_udf("array<struct<range:int,ahead:boolean>>")
    def places(key: pd.Series) -> pd.Series:
        own = np.searchsorted(edges, key.to_numpy(), side="right").tolist()
        return pd.Series([[(r, False), (before[k], True)] if k in before else [(r, False)] for r, k in zip(own, key.tolist())])

    placed = rows.withColumn("place", F.explode(places("key")))
    return (
        placed.select("place.range", "place.ahead", "key", "doc_id", "text")
        .repartition(F.col("range"))
        .sortWithinPartitions("range", "ahead", "key", "text")
    )


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_kept long"


def edited_fingerprints(docs: DataFrame, shingle: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """Fingerprint every text and the text whose last quarter gives way to the start of the next document.

    Equal doc_ids are ordered by text; null ones come first.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows still without the row that follows
        for batch in batches:
            table = pa.Table.from_batches([batch])
            at = 0
            for rows in _pieces(table):
                held += rows
                at += len(rows)
                yield from _emit(held, shingle, fraction)
                held = held[-1:]

    small_batches(docs.sparkSession)
    return in_order(docs).mapInArrow(pairs, SCHEMA)


def _pieces(table: pa.Table, limit: int = 1 << 20) -> Iterator[list[tuple]]:
    """Rows as tuples, about a megabyte of text at a time."""
    rows: list[tuple] = []
    size = 0
    names = ("range", "ahead", "doc_id", "text")
    for batch in table.to_batches(max_chunksize=256):
        for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names)):
            rows.append(row)
            size += len(row[3])
            if size >= limit:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def _emit(rows: list[tuple], shingle: int, fraction: float) -> Iterator[pa.RecordBatch]:
    """Results of all rows but the last, which waits for its successor, and but the lent ones."""
    own = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
    if not own:
        return
    texts = [r[3] for r in rows]
    edited = [texts[i][: len(texts[i]) - len(texts[i]) // 4] + texts[i + 1][: len(texts[i]) // 4] for i in own]
    whole, changed = sketches(pa.array(texts, pa.string()), shingle, fraction), sketches(pa.array(edited, pa.string()), shingle, fraction)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([rows[i][2] for i in own], pa.int64()),
            pa.array([len(texts[i]) for i in own], pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]),
            pa.array([encode(whole[i]) for i in own]),
            pa.array([encode(x) for x in changed]),
            pa.array([likeness(whole[i], x) for i, x in zip(own, changed)]),
            pa.array([likeness(whole[i], whole[i + 1]) for i in own]),
            pa.array([len(whole[i]) for i in own], pa.int64()),
        ],
        names=[c.split()[0] for c in SCHEMA.split(", ")],
    )


def edited_oracle() -> str:
    """Lengths and edited texts in DuckDB SQL."""
    return """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
e AS (SELECT doc_id, t, len(t) // 4 AS cut, coalesce(lead(t) OVER (ORDER BY doc_id NULLS FIRST, t), first(t) OVER (ORDER BY doc_id NULLS FIRST, t)) AS following FROM d)
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_chars, sha256(left(t, len(t) - cut) || left(following, cut)) AS edited_sha256 FROM e"""
