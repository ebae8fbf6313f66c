"""MinHash near-duplicates: universal hash minima, banding, signature and full verification, components.

1. One pass over the texts: shingle sets, minima of ``bands * rows`` universal
   (multiply-add) hashes, kept as a signature of 32 bits each, one key a band, and a
   128-bit key of the whole set.
2. Documents with equal sets collapse to the one with the smallest doc_id, by an
   aggregation that combines map-side; copies never meet again as pairs.
3. First pass, linear: each document meets the smallest document of its buckets, one
   pair a document.  The share of equal minima estimates their Jaccard index; pairs
   that could be near (see below) are verified on full sets.  Components are taken
   over verified links only.
4. Second pass, only for buckets that still hold several components.  By the triangle
   inequality of the Jaccard distance, a document below 2t - 1 from the smallest one
   of its bucket is linked with none that is within t of it.  Estimates, with a margin
   of ``MARGIN`` (four standard deviations), cut the bucket into those near its
   smallest document and those not verified with it.  Each part that holds several
   components is verified on full sets, in blocks of about ``BLOCK_DOCS`` documents: a
   task takes two blocks and multiplies their incidence matrices, so no pair is ever
   emitted, only a spanning forest of the links it found.
5. Components over the links of both passes.

Bands are chosen so that a pair at the threshold escapes all of them with a
chance below ``MISS``.

Defined cases: null texts and texts without words have the empty set and link
with nothing; fewer words than the shingle length are one shingle; rows with the
same doc_id are one document; a null doc_id has a null component and is kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairngraph.llm.graphs import components
from cairngraph.llm.storage import concluded, small_batches, stored
from cairngraph.llm.textbatch import U64, mix, word_slices

MISS, MARGIN, BLOCK_DOCS, BLOCK_SHINGLES, COLUMNS = 1e-5, 0.15, 256, 1 << 18, 4096


def banding(threshold: float) -> tuple[int, int]:
    """(bands, rows): rows by the threshold, and enough bands for ``MISS``."""
    rows = 6 if threshold >= 0.83 else 5 if threshold >= 0.7 else 3
    return math.ceil(math.log(MISS) / math.log(1 - threshold**rows)), rows


def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    a = mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
    return a, mix(np.arange(n + 1, 2 * n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


def _sorted_sets(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (doc, value), by doc and then value."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


def signatures(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, bands, minima): the set's size, its 128-bit key, its band keys and its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _family(bands * rows)
        for batch in batches:
            ids = batch.column(0)
            for i, j, words in word_slices(batch.column(1), lower=True, limit=1 << 19):
                n = j - i
                doc, value = _sorted_sets(*words.shingles(shingle))
                size = np.bincount(doc, minlength=n)
                has = np.flatnonzero(size)
                starts = np.searchsorted(doc, has)
                keys, minima = np.zeros((bands, n), U64), np.zeros((n, bands * rows), "<u4")
                k1, k2 = np.zeros(n, U64), np.zeros(n, U64)
                if len(has):
                    k1[has] = np.add.reduceat(mix(value), starts)
                    k2[has] = np.add.reduceat(mix(value ^ U64(0xA0761D6478BD642F)), starts)
                    for band in range(bands):
                        key = np.full(len(has), band + 1, U64)
                        for h in range(band * rows, band * rows + rows):
                            least = mix(np.minimum.reduceat(value * a[h] + b[h], starts))
                            minima[has, h] = least.astype(np.uint32)
                            key = mix(key ^ least) + U64(h)
                        keys[band, has] = key
                flat = pa.array(np.ascontiguousarray(keys.T).view(np.int64).ravel())
                listed = pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, n), pa.array(size.astype(np.int64)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), listed, pa.array([x.tobytes() for x in minima], pa.binary())],
                    names=["doc_id", "n_shingles", "k1", "k2", "bands", "minima"],
                )

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, minima binary")


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(all columns but text, set): each text's sorted distinct shingle hashes as little-endian 64-bit integers."""
    kept = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            others = batch.select(kept)
            for i, j, words in word_slices(text, lower=True):
                doc, value = _sorted_sets(*words.shingles(shingle))
                parts = [x.tobytes() for x in np.split(value, np.searchsorted(doc, np.arange(1, j - i)))]
                yield pa.RecordBatch.from_arrays([*others.slice(i, j - i).columns, pa.array(parts, pa.binary())], names=[*kept, "set"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, f"{fields}, set binary")


def link_forest(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """(member, root) of the groups that links of 100 * |A & B| >= percent * |A | B| form among the sets."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(1, 0)] if 100 * both >= percent * (size.sum() - both) and both else []
    value, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), size)
    shared = count > 1  # what only one set has is in no intersection
    column = np.cumsum(shared) - 1
    keep = shared[at]
    owner, at = owner[keep], column[at[keep]]
    both = np.zeros((n, n), np.float32)
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    for low in range(0, int(shared.sum()), COLUMNS):
        x, y = np.searchsorted(at, (low, low + COLUMNS))
        block = np.zeros((n, COLUMNS), np.float32)
        block[owner[x:y], at[x:y] - low] = 1
        both += block @ block.T
    both = both.astype(np.int64)
    linked = (100 * both >= percent * (size[:, None] + size[None, :] - both)) & (both > 0)
    forest, seen = [], np.zeros(n, bool)
    for root in range(n):
        if seen[root]:
            continue
        seen[root] = True
        front = np.array([root])
        while len(front):
            front = np.flatnonzero(linked[front].any(axis=0) & ~seen)
            seen[front] = True
            forest += [(int(x), root) for x in front]
    return forest


def _verified(placed: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v) of the forests of every (cluster, i, j) task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        ids: list[int] = []
        sets: list[np.ndarray] = []

        def done() -> pa.RecordBatch:
            forest = link_forest(sets, percent) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays(
                [pa.array([ids[x] for x, _ in forest], pa.int64()), pa.array([ids[r] for _, r in forest], pa.int64())], names=["u", "v"]
            )

        for batch in batches:
            key = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            for k, doc, value in zip(key, batch.column(3).to_pylist(), batch.column(4)):
                if k != now:
                    if len(sets) > 1:
                        yield done()
                    now, ids, sets = k, [], []
                ids.append(doc)
                sets.append(np.frombuffer(value.as_buffer(), U64))
        if len(sets) > 1:
            yield done()

    # A task may hold many small clusters; a large one never sits in a single task.
    dealt = placed.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    return dealt.select("cluster", "i", "j", "doc_id", "set").mapInArrow(run, "u long, v long")


def _with_both(edges: DataFrame, of: DataFrame, column: str) -> DataFrame:
    """Edges (u, v) with a column of the table (rep, column) for either end."""
    side = lambda end: of.select(F.col("rep").alias(end), F.col(column).alias(f"of_{end}"))
    return edges.join(side("u"), "u").join(side("v"), "v").select("u", "v", "of_u", "of_v")


def estimates(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """(u, v, estimate): the share of minima that agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u4").reshape(len(batch), -1) for k in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((one == two).mean(axis=1) if len(batch) else [], pa.float64())], names=["u", "v", "estimate"])

    return _with_both(edges, classes, "minima").mapInArrow(run, "u long, v long, estimate double")


def verified_pairs(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges (u, v) with 100 * |A & B| >= percent * |A | B| on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for one, two in zip(batch.column(2), batch.column(3)):
                one, two = np.frombuffer(one.as_buffer(), U64), np.frombuffer(two.as_buffer(), U64)
                both = len(np.intersect1d(one, two, assume_unique=True))
                linked.append(both > 0 and 100 * both >= percent * (len(one) + len(two) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(linked, pa.bool_())), batch.column(1).filter(pa.array(linked, pa.bool_()))], names=["u", "v"])

    return _with_both(edges, sets, "set").mapInArrow(run, "u long, v long")


def _second_pass(keyed: DataFrame, classes: DataFrame, sets: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Links within buckets (key, least, rep) that the first pass has left in several components.  Pairs without an estimate count as near and not verified."""
    found = stored(components(links), "first-components").withColumnsRenamed({"node": "rep"})
    placed = keyed.join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    several = stored(placed.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1").select("key"), "open-buckets")
    rows = stored(placed.join(several, "key"), "open-members")
    stars = rows.where("rep <> least").select(F.col("rep").alias("u"), F.col("least").alias("v")).distinct()
    known = links.select("u", "v").distinct().withColumn("linked", F.lit(True))
    judged = stored(estimates(stars, classes.where("sets = 1")).join(known, ["u", "v"], "left").select("u", "v", "estimate", F.coalesce("linked", F.lit(False)).alias("linked")), "open-stars")
    near = 2 * percent / 100 - 1 - MARGIN
    members = rows.join(judged.withColumnsRenamed({"u": "rep", "v": "least"}), ["rep", "least"], "left")
    is_near, is_rest = F.col("estimate").isNull() | (F.col("estimate") >= near), (F.col("rep") != F.col("least")) & ~F.coalesce("linked", F.lit(False))
    parts = members.select("key", "rep", "component", F.explode(F.array_compact(F.array(F.when(is_near, F.lit(0)), F.when(is_rest, F.lit(1))))).alias("part"))
    parts = stored(parts, "open-parts")
    sizes = classes.select("rep", "n")
    groups = (
        parts.join(sizes, "rep")
        .groupBy("key", "part")
        .agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("docs"), F.sum("n").alias("shingles"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64("rep")).alias("xor"))
        .where("c0 < c1")
        # The same documents meet in many bands: one group of each kind is enough.
        .groupBy("docs", "shingles", "sum", "xor")
        .agg(F.min(F.struct("key", "part")).alias("g"))
        .select("g.key", "g.part", F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    )
    dealt = parts.join(stored(groups, "open-groups"), ["key", "part"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # Where there is more than one block, a block meets itself in each of its pairs.
    pairs = "transform(sequence(0, blocks - 1), b -> struct(least(b, block) as i, greatest(b, block) as j))"
    cells = dealt.withColumn("pair", F.explode(F.expr(f"if(blocks = 1, array(struct(0 as i, 0 as j)), filter({pairs}, p -> p.i <> p.j))")))
    cluster = F.xxhash64("key", "part").alias("cluster")
    full = cells.join(sets, "rep").select(cluster, "pair.i", "pair.j", F.col("rep").alias("doc_id"), "set")
    return _verified(full, percent)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of a table with doc_id and text."""
    return concluded(docs.sparkSession, lambda: _near_duplicates(docs, shingle, percent), "near-duplicates")


def _near_duplicates(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    bands, rows = banding(percent / 100)
    signed = stored(signatures(docs, shingle, bands, rows), "minhash")
    known = signed.where("n_shingles > 0 and doc_id is not null")
    # One document a set; its band keys come along as those of any member: equal sets have equal keys.
    one = known.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("minima").alias("minima"))
    classes = stored(one, "minhash-classes")
    # A document can have two sets (repeated ids): its least size and one of its signatures stand for both.
    reps = stored(classes.groupBy("rep").agg(F.min("n").alias("n"), F.first("minima").alias("minima"), F.count("*").alias("sets")), "minhash-reps")
    every = classes.select("rep", F.explode("bands").alias("key"))
    buckets = stored(every.groupBy("key").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most").select("key", "least"), "buckets")
    keyed = stored(every.join(buckets, "key").distinct(), "bucket-members")
    # First pass: one pair a document.
    stars = stored(keyed.where("rep <> least").groupBy(F.col("rep").alias("u")).agg(F.min("least").alias("v")), "stars")
    wanted = keyed.select("rep").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(wanted, "rep")
    sets = stored(shingle_sets(texts, shingle), "near-sets")
    near = estimates(stars, reps.where("sets = 1")).where(F.col("estimate") >= 2 * percent / 100 - 1 - MARGIN).select("u", "v")
    # Of a document with several sets no signature speaks for all.
    twofold = stars.join(reps.where("sets > 1").select(F.col("rep").alias("u")), "u", "left_semi").unionByName(stars.join(reps.where("sets > 1").select(F.col("rep").alias("v")), "v", "left_semi"))
    links = stored(verified_pairs(near.unionByName(twofold).distinct(), sets, percent), "links")
    more = stored(_second_pass(keyed, reps, sets, links, percent), "more-links")
    found = components(links.unionByName(more))
    resolved = classes.join(found, F.col("rep") == F.col("node"), "left").select("k1", "k2", F.coalesce("component", "rep").alias("class_component"))
    # Rows sharing a doc_id are one document: take the least component of its sets.
    out = signed.select("doc_id", "n_shingles", "k1", "k2").join(resolved, ["k1", "k2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("class_component")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def oracle(shingle: int = 5, percent: int = 80) -> str:
    """The same rows in DuckDB SQL: all shared shingles counted, links followed to a fixpoint."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(generate_series(1, greatest(1, len(w) - {shingle - 1})), lambda i: array_to_string(w[i:i + {shingle - 1}], ' '))) END AS s FROM d),
item AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
link AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM item a JOIN item b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
sym AS MATERIALIZED (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(node, other) AS (SELECT a, a FROM sym UNION SELECT reach.node, sym.b FROM reach JOIN sym ON sym.a = reach.other),
found AS (SELECT node, min(other) AS c FROM reach GROUP BY node)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept FROM sets LEFT JOIN found ON doc_id = node"""
