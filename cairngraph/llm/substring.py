"""Substring dedup: repeated windows of words, found with an FM-index per shard.

A word goes if a window of ``WINDOW`` consecutive words that covers it also starts
in a document with a smaller doc_id.  Windows are judged on the input.

1. Winnowing: every window picks its smallest k-gram as anchor, so equal windows
   pick equal anchors; consecutive windows with one anchor form a piece of at most
   92 words (about one piece every 22 words), with a 128-bit hash of its words.
2. Pieces whose anchor occurs in one document only are dropped.  Equal pieces are
   one class with its smallest doc_id, by an aggregation that combines map-side:
   whole copies, however many, never meet again as pairs.
3. What is left to compare are different classes around one anchor: passages whose
   surroundings differ.  Their words are indexed in shards of about ``SHARD_WORDS``
   words, dealt by anchor: in each, an FM-index over a wavelet matrix; the shard's
   pieces are streamed against it by backward search, the matching statistics give
   every place with a match of WINDOW words, and the suffix interval's smallest
   doc_id says whether an earlier document holds it.
4. An anchor with more than ``HOT`` classes (a very common passage in ever other
   surroundings) would be one large shard.  Its windows are compared by a 128-bit
   hash each and a map-side minimum instead, which is as exact and stays linear.
5. Removed ranges meet their documents in one join; kept words are hashed there.

In the index a word is its 31-bit hash: two texts are taken for equal only if all
50 words' hashes agree.

Defined cases: null text has no words; documents of fewer than WINDOW words lose
nothing and remove nothing; rows with the same doc_id are one document and do not
remove words of each other; a null doc_id sorts first; words are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairngraph.llm.fmindex import FMIndex
from cairngraph.llm.storage import small_batches, stored
from cairngraph.llm.textbatch import U64, Words, mix, word_slices

WINDOW, GRAM, SHARD_WORDS, HOT = 50, 8, 400_000, 2048
NULL_KEY = -(2**63)
_SEED = 0x5851F42D4C957F2D


def pieces_of(words: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(doc, first window, number of windows, anchor, h1, h2) of every piece; windows count words from the text's start."""
    n, wide = len(words), window - gram + 1
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U64, U64, U64))
    if n < window:
        return none
    grams = words.windows(gram)
    place = np.arange(n, dtype=U64)
    least = (grams & ~U64((1 << 20) - 1)) | (place & U64((1 << 20) - 1))  # slices have fewer than 2**20 words, or one text
    if n > 1 << 20:
        least = None
    width = 1
    if least is not None:
        while 2 * width <= wide:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[: n - wide + 1], least[wide - width : wide - width + n - wide + 1])
        chosen = (least & U64((1 << 20) - 1)).astype(np.int64)
    else:  # a single text of a million words or more: the same choice with whole places
        key, at = grams & ~U64((1 << 20) - 1), np.arange(n)
        while width < wide:
            step = min(width, wide - width)
            take = key[step:] < key[:-step]
            key, at = np.where(take, key[step:], key[:-step]), np.where(take, at[step:], at[:-step])
            width += step
        chosen = at[: n - wide + 1]
    start = np.arange(n - window + 1)
    chosen = chosen[: n - window + 1]
    inside = start + window <= words.first[1:][words.doc[start]]
    start, chosen = start[inside], chosen[inside]
    if not len(start):
        return none
    doc = words.doc[start]
    new = np.ones(len(start), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(start)))
    first, anchor = start[at], chosen[at]
    h1, h2 = _range_hash(words.hash, first, count + window - 1, 0), _range_hash(words.hash, first, count + window - 1, _SEED)
    return doc[at], first - words.first[doc[at]], count, mix(grams[anchor]), mix(h1 + (anchor - first).astype(U64)), h2


def _range_hash(hashes: np.ndarray, first: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """A hash of ``size`` words from each place on."""
    from cairngraph.llm.textbatch import _WORD_BASE, inverse, powers

    value = mix(hashes + U64(seed)) if seed else hashes
    total = np.zeros(len(value) + 1, U64)
    np.cumsum(value * powers(_WORD_BASE, len(value)), out=total[1:])
    return mix((total[first + size] - total[first]) * powers(inverse(_WORD_BASE), len(value))[first] + size.astype(U64))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("doc"), F.xxhash64("text").alias("tag"), "text")


def anchored(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, tag, first, count, anchor, h1, h2): the pieces of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, words in word_slices(batch.column(2)):
                doc, first, count, anchor, h1, h2 = pieces_of(words, window)
                rows = pa.array(doc + i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int16))]
                    + [pa.array(x.view(np.int64)) for x in (anchor, h1, h2)],
                    names=["doc", "tag", "first", "count", "anchor", "h1", "h2"],
                )

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, "doc long, tag long, first int, count short, anchor long, h1 long, h2 long")


def _with_words(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """Add to each wanted piece (doc, tag, anchor, h1, h2, first, count) the 31-bit hashes of its words."""
    listed = wanted.groupBy("doc", "tag").agg(F.collect_list(F.struct("anchor", "h1", "h2", "first", "count")).alias("want"))
    joined = docs.join(listed, ["doc", "tag"]).select("doc", "text", "want")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, wants = batch.column(0).to_pylist(), batch.column(2)
            for i, j, words in word_slices(batch.column(1)):
                short = (words.hash >> U64(33)).astype("<i4")
                rows: list[tuple] = []
                for d in range(i, j):
                    base = words.first[d - i]
                    for w in wants[d].as_py():
                        a = base + w["first"]
                        rows.append((doc_ids[d], w["anchor"], w["h1"], w["h2"], w["count"], short[a : a + w["count"] + window - 1].tobytes()))
                columns = list(zip(*rows)) if rows else [[]] * 6
                kinds = [pa.int64()] * 4 + [pa.int16(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc", "anchor", "h1", "h2", "count", "words"])

    small_batches(docs.sparkSession)
    return joined.mapInArrow(run, "doc long, anchor long, h1 long, h2 long, count short, words binary")


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """[from, to) of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


FOUND = "anchor long, h1 long, h2 long, a int, b int"


def _by_index(pieces: DataFrame, shards: int, window: int) -> DataFrame:
    """Windows [a, b) of each piece that an earlier document holds, by an FM-index over each shard's pieces."""

    def search(rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda r: (r[1], r[2], r[3]))
        labels = np.array([r[0] for r in rows])
        sequences = [np.frombuffer(r[5], "<i4").astype(np.int64) for r in rows]
        index = FMIndex(sequences, labels)
        length, low, high, first = index.matching_statistics(sequences, window)
        owner = np.repeat(np.arange(len(rows)), [len(s) for s in sequences])
        hit = np.flatnonzero(length >= window)
        earlier = np.zeros(len(length), bool)
        earlier[hit] = index.least_label(low[hit], high[hit]) < labels[owner[hit]]
        out = []
        for k in np.unique(owner[earlier]):
            for a, b in _runs(earlier[first[k] : first[k] + len(sequences[k])]):
                out.append((rows[k][1], rows[k][2], rows[k][3], a, b))
        columns = list(zip(*out)) if out else [[]] * 5
        kinds = [pa.int64()] * 3 + [pa.int32()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["anchor", "h1", "h2", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for shard, *row in zip(*columns):
                if shard != now:
                    if len(rows) > 1:
                        yield search(rows)
                    now, rows = shard, []
                rows.append(tuple(row))
        if len(rows) > 1:
            yield search(rows)

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int")).repartition("shard").sortWithinPartitions("shard")
    return dealt.select("shard", "doc", "anchor", "h1", "h2", "count", "words").mapInArrow(run, FOUND)


def _by_hash(pieces: DataFrame, window: int) -> DataFrame:
    """The same for pieces of very common anchors: a 128-bit hash of every window, and its smallest document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, anchor, h1, h2 = (batch.column(k).to_numpy() for k in range(4))
            values = [np.frombuffer(w.as_buffer(), "<i4").astype(np.int64).astype(U64) for w in batch.column(5)]
            if not values:
                continue
            size = np.array([len(v) for v in values])
            flat, base = np.concatenate(values), np.concatenate([[0], np.cumsum(size)[:-1]])
            count = size - window + 1
            row = np.repeat(np.arange(len(size)), count)
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            place, wide = base[row] + at, np.full(len(row), window)
            w1, w2 = _range_hash(mix(flat), place, wide, 0), _range_hash(mix(flat), place, wide, _SEED)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (doc[row], anchor[row], h1[row], h2[row], at.astype(np.int32), w1.view(np.int64), w2.view(np.int64))],
                names=["doc", "anchor", "h1", "h2", "at", "w1", "w2"],
            )

    windows = pieces.select("doc", "anchor", "h1", "h2", "count", "words").mapInArrow(run, "doc long, anchor long, h1 long, h2 long, at int, w1 long, w2 long")
    least = windows.groupBy("w1", "w2").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").drop("most")
    return windows.join(least, ["w1", "w2"]).where("least < doc").select("anchor", "h1", "h2", F.col("at").alias("a"), (F.col("at") + 1).alias("b"))


def removed_ranges(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, tag, low, high): words [low, high) to remove; ranges may overlap.  docs: as made by ``_keyed``."""
    every = stored(anchored(docs, window), "pieces")
    # Stored, so that the join below has two plain exchanges and a hub's rows can be split.
    spread = stored(every.groupBy("anchor").agg(F.min("doc").alias("d0"), F.max("doc").alias("d1")).where("d0 < d1").select("anchor"), "shared-anchors")
    shared = stored(every.join(spread, "anchor"), "shared-pieces")
    classes = stored(shared.groupBy("anchor", "h1", "h2").agg(F.min("doc").alias("least")), "piece-classes")
    known = shared.join(classes, ["anchor", "h1", "h2"])
    copies = known.where("doc > least").select("doc", "tag", F.col("first").alias("low"), (F.col("first") + F.col("count") + F.lit(window - 1)).cast("int").alias("high"))
    # Classes around one anchor that differ, each by a piece of its first document.
    sizes = classes.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    firsts = stored(known.where("doc = least").join(sizes, "anchor").select("doc", "tag", "first", "count", "anchor", "h1", "h2", "n"), "first-pieces")
    one = firsts.groupBy("anchor", "h1", "h2").agg(F.min("doc").alias("doc"), F.min(F.struct("tag", "first")).alias("at"), F.min("count").alias("count"), F.min("n").alias("n"))
    wanted = one.select("doc", "at.tag", "at.first", "count", "anchor", "h1", "h2", "n")
    hot = sizes.where(F.col("n") > HOT).select("anchor")
    words = stored(_with_words(docs, wanted.drop("n"), window).join(hot.withColumn("hot", F.lit(True)), "anchor", "left"), "piece-words")
    total = words.where("hot is null").agg(F.sum(F.length("words"))).first()[0] or 0
    found = stored(_by_index(words.where("hot is null"), max(1, -(-total // (4 * SHARD_WORDS))), window).unionByName(_by_hash(words.where("hot"), window)), "found")
    parts = firsts.join(found, ["anchor", "h1", "h2"]).select("doc", "tag", (F.col("first") + F.col("a")).alias("low"), (F.col("first") + F.col("b") + F.lit(window - 1)).cast("int").alias("high"))
    return copies.unionByName(parts)


def strip(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with ``kept`` (the words that stay, joined by a space), ``n_words`` and ``n_removed``."""
    keys = _keyed(docs)
    ranges = removed_ranges(keys, window).groupBy(F.col("doc").alias("__of_doc"), F.col("tag").alias("__of_tag")).agg(F.collect_list(F.struct("low", "high")).alias("__ranges"))
    columns = [c for c in docs.columns if c not in ("kept", "n_words", "n_removed")]
    rows = docs.select(*[F.col(f"`{c}`") for c in columns], F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("__doc"), F.xxhash64("text").alias("__tag"))
    joined = rows.join(ranges, (F.col("__doc") == F.col("__of_doc")) & (F.col("__tag") == F.col("__of_tag")), "left").drop("__doc", "__tag", "__of_doc", "__of_tag")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, ranges_of = batch.column(batch.schema.get_field_index("text")), batch.column(batch.schema.get_field_index("__ranges"))
            others = batch.select(columns)
            for i, j, words in word_slices(text):
                kept, n_removed = [], []
                data = words.data.tobytes()
                for d in range(i, j):
                    a, b = words.first[d - i], words.first[d - i + 1]
                    stay = np.ones(b - a, bool)
                    for r in ranges_of[d].as_py() or ():
                        stay[r["low"] : r["high"]] = False
                    at = a + np.flatnonzero(stay)
                    kept.append(b" ".join([data[s:e] for s, e in zip(words.start[at].tolist(), words.end[at].tolist())]).decode())
                    n_removed.append(int(b - a - len(at)))
                yield pa.RecordBatch.from_arrays(
                    [*others.slice(i, j - i).columns, pa.array(kept, pa.string()), pa.array(words.count.astype(np.int64)), pa.array(n_removed, pa.int64())],
                    names=[*columns, "kept", "n_words", "n_removed"],
                )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in columns)
    small_batches(docs.sparkSession)
    return joined.mapInArrow(run, f"{fields}, kept string, n_words long, n_removed long")


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256)."""
    return strip(docs.select("doc_id", "text")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def oracle(window: int = WINDOW) -> str:
    """The same rows in DuckDB SQL: every window's words, joined and hashed."""
    return f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
place AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - {window - 1})) AS i FROM d WHERE len(w) >= {window}),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {window - 1}], ' ')) AS h FROM place),
earliest AS (SELECT h, min(doc_id) AS f FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, i + k AS pos FROM win JOIN earliest USING (h), range({window}) AS t(k) WHERE f < doc_id),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS pos FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY pos) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id"""
