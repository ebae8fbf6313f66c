"""Mixing sources to target weights with a low-discrepancy schedule.

Golden-ratio points (n * phi modulo 1, in exact integers) fall through the
cumulative target shares (exact integers too), so every prefix of the schedule
holds each source in its share to within a few slots.  A slot's rank within its
source names the block of equal token count it takes from that source's stream: the
source's documents in shuffled (hashed) order, repeated up to ``MAX_REPEATS`` times.
What the mix takes is what the drawn slots take and nothing else: a source comes as
near its target as its slots do, and no further.

Targets: weights 1, 2, 3, repeating over sources in code-point order, null last,
share out the total; a target stops at ``MAX_REPEATS`` times its source's size,
and the excess is shared again by weight.  That ends where target = min(cap,
level * weight), found in one pass over the sources sorted by size / weight.

Scale: documents are placed in their source's stream by a two-level running sum,
over hashed buckets and then within a bucket, so a source that holds a third of
all rows spreads over as many tasks as the others; the number of buckets grows with
the table.  Only numbers are shuffled, never texts.  The schedule has at most
``SLOTS`` slots whatever the input; the block length grows instead.  Single-task
windows run over sources or groups of slots only.

Defined cases: null text has size 0; a document of size 0 is never taken; an
empty table gives no rows, one without words targets and takes of 0; repeated
rows are documents of their own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairngraph.llm.storage import stored

SLOTS, MAX_REPEATS, BUCKET_BITS, BUCKET_DOCS = 1 << 20, 3, 12, 4096
#: 2**32 / phi to the nearest odd integer.
GOLDEN, RANGE, CELLS = 2654435769, 1 << 32, 1 << 10
WIDE, EXACT = "decimal(19,0)", "decimal(38,0)"


def size_of(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shuffled(key: Column) -> Column:
    """60 bits of the key's md5: the order in which a source's documents are taken."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """From (source, size): a row for each source with its rank, size, weight, target and the total of all."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything, ranked = W.partitionBy(), W.orderBy(F.col("source").asc_nulls_last())
    # size / weight without a division: 6 / weight is whole for weights 1, 2 and 3
    tight = W.orderBy(F.col("source_size") * (F.lit(6) / F.col("weight")).cast("long"), "rank")
    before = tight.rowsBetween(W.unboundedPreceding, -1)
    placed = (
        by_source.withColumn("rank", F.row_number().over(ranked))
        .withColumn("weight", ((F.col("rank") - 1) % 3 + 1).cast("long"))
        .withColumn("place", F.row_number().over(tight))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("rest", F.col("total") - F.coalesce(F.sum(MAX_REPEATS * F.col("source_size")).over(before), F.lit(0)))
        .withColumn("rest_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("share", (F.col("rest") * F.col("weight")).cast("double") / F.col("rest_weight").cast("double"))
        .withColumn("is_free", F.col("share") <= (MAX_REPEATS * F.col("source_size")).cast("double"))
    )
    level = F.min(F.when(F.col("is_free"), F.struct("place", "rest", "rest_weight"))).over(everything)
    return (
        placed.withColumn("level", level)
        .withColumn(
            "target",
            F.when(
                F.col("place") >= F.col("level.place"),
                (F.col("level.rest") * F.col("weight")).cast("double") / F.col("level.rest_weight").cast("double"),
            ).otherwise((MAX_REPEATS * F.col("source_size")).cast("double")),
        )
        # the same as a fraction of the total, in whole numbers
        .withColumn(
            "part",
            F.when(F.col("place") >= F.col("level.place"), F.expr(f"cast(level.rest as {WIDE}) * weight")).otherwise(
                F.expr(f"cast({MAX_REPEATS} * source_size as {WIDE}) * level.rest_weight")
            ).cast(EXACT),
        )
        .withColumn("whole", F.expr(f"cast(cast(total as {WIDE}) * level.rest_weight as {EXACT})"))
        .select("source", "rank", "source_size", "weight", "target", "total", "part", "whole")
    )


def schedule(targets: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(slot, rank, block, block_size): the order in which the mix takes each source's blocks.

    Block b of a source is words [b * block_size, (b + 1) * block_size) of its stream.  Slots that fall to a
    source whose repeats are used up take nothing.
    """
    spark = targets.sparkSession
    upto = F.sum("part").over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, 0)).cast(EXACT)
    shares = (
        targets.where("target > 0")
        .withColumn("upto", upto)
        .withColumn("high", F.expr(f"(upto * cast({RANGE} as decimal(10,0))) div nullif(whole, 0)"))
        .withColumn("low", F.coalesce(F.lag("high").over(W.orderBy("rank")), F.lit(0)))
        .withColumn("block_size", F.expr(f"cast(ceil(total / {slots}) as long)"))
        .withColumn("blocks", F.expr(f"({MAX_REPEATS} * source_size + block_size - 1) div block_size"))
        .select("rank", "low", "high", "total", "block_size", "blocks")
    )
    width = RANGE // CELLS
    cells = shares.where("low < high").withColumn("cell", F.explode(F.expr(f"sequence(low div {width}, (high - 1) div {width})")))
    points = (
        spark.range(slots)
        .select(F.col("id").alias("slot"), (F.col("id") * F.lit(GOLDEN) % F.lit(RANGE)).alias("point"))
        .withColumn("cell", F.expr(f"point div {width}"))
    )
    placed = (
        points.join(cells, "cell")
        .where("point >= low and point < high and slot * block_size < total")
        .select("slot", "rank", "block_size", "blocks", F.shiftright("slot", 12).alias("group"))
    )
    before = (
        placed.groupBy("rank", "group")
        .count()
        .select("rank", "group", F.coalesce(F.sum("count").over(W.partitionBy("rank").orderBy("group").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    )
    inside = F.row_number().over(W.partitionBy("rank", "group").orderBy("slot")) - 1
    return (
        placed.withColumn("inside", inside)
        .join(before, ["rank", "group"])
        .withColumn("block", F.col("before") + F.col("inside"))
        .where("block < blocks")
        .select("slot", "rank", "block", "block_size")
    )


def streams(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Each document's place in its source's stream: adds ``start``, and the columns of its source.

    sizes: (doc_id, source, size, h), h as made by ``shuffled``.
    """
    bits = max(BUCKET_BITS, math.ceil(math.log2(max(1, sizes.count() / BUCKET_DOCS))))
    rows = sizes.withColumn("bucket", F.shiftright("h", 60 - bits))
    buckets = (
        rows.groupBy("source", "bucket")
        .agg(F.sum("size").alias("bucket_size"))
        .withColumn("before", F.coalesce(F.sum("bucket_size").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .join(targets.withColumnRenamed("source", "its_source"), F.col("source").eqNullSafe(F.col("its_source")))
        .drop("its_source", "bucket_size")
        .withColumnsRenamed({"source": "b_source", "bucket": "b_bucket"})
    )
    inside = W.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    return (
        rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(buckets, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
        .withColumn("start", F.col("before") + F.col("inside"))
        .select("doc_id", "source", "size", "rank", "source_size", "target", "total", "start")
    )


def pieces(placed: DataFrame, order: DataFrame) -> DataFrame:
    """The mix itself: each slot's pieces of documents.

    Adds slot, first_word and n_words to the columns of ``streams``; a document that no slot takes keeps
    one row with a null slot and 0 words.
    """
    none = "array(cast(null as long))"
    # A source's blocks are drawn in their order: its slots take the first ``upto`` words of its stream.
    drawn = order.groupBy("rank").agg(F.count("*").alias("n"), F.first("block_size").alias("block_size")).withColumnRenamed("rank", "d_rank")
    laps = (
        placed.join(drawn, F.col("rank") == F.col("d_rank"), "left")
        .withColumn("upto", F.expr(f"coalesce(least(n * block_size, {MAX_REPEATS} * source_size), 0L)"))
        .withColumn("lap", F.explode(F.expr(f"if(size > 0 and upto > 0, sequence(0L, (upto - 1) div source_size), {none})")))
    )
    spans = (
        laps.withColumn("low", F.expr("lap * source_size + start"))
        .withColumn("high", F.expr("least(low + size, upto)"))
        .withColumn("block", F.explode(F.expr(f"if(low < high, sequence(low div block_size, (high - 1) div block_size), {none})")))
    )
    taken = order.select(F.col("rank").alias("s_rank"), F.col("block").alias("s_block"), "slot")
    words = F.expr("least(high, (block + 1) * block_size) - greatest(low, block * block_size)")
    return (
        spans.join(taken, (F.col("rank") == F.col("s_rank")) & (F.col("block") == F.col("s_block")), "left")
        .withColumn("first_word", F.expr("greatest(low, block * block_size) - low"))
        .withColumn("n_words", F.when(F.col("slot").isNotNull(), words).otherwise(F.lit(0)))
        .select("doc_id", "source", "size", "rank", "source_size", "target", "start", "slot", "first_word", "n_words")
    )


def plan(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The pieces of the mix of a table with doc_id, source and text; sorting by slot and start gives its order."""
    sizes = stored(
        docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), shuffled(F.col("doc_id")).alias("h")), "mix-sizes"
    )
    targets = stored(source_targets(sizes), "mix-targets")
    return pieces(streams(sizes, targets), stored(schedule(targets, slots), "mix-schedule"))


def mix(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, source_size, target, taken, n_slots, first_slot) of every document.

    n_slots: pieces of the document in the mix; first_slot: the first slot that takes of it, -1 where none does.
    """
    return (
        plan(docs, slots)
        .groupBy("rank", "start", "doc_id", "size", "source_size", "target")
        .agg(F.sum("n_words").alias("taken"), F.count("slot").alias("n_slots"), F.coalesce(F.min("slot"), F.lit(-1)).alias("first_slot"), F.count("*").alias("n"))
        # Documents of size 0 do not advance start, and have one piece each: repeated ones share a group.
        .withColumn("nth", F.explode(F.expr("sequence(1L, if(size = 0, n, 1L))")))
        .select("doc_id", "size", "source_size", "target", "taken", "n_slots", "first_slot")
    )


def oracle(slots: int = SLOTS) -> str:
    """The same rows in DuckDB SQL: every slot's point drawn, the slots of each source numbered, its stream cut there."""
    return f"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
by_source AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source)),
placed AS (
  SELECT *, row_number() OVER (ORDER BY source_size * (6 // weight), source NULLS LAST) AS place, CAST(sum(source_size) OVER () AS HUGEINT) AS total,
    sum(source_size) OVER () - coalesce(sum({MAX_REPEATS} * source_size) OVER before, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS rest_weight
  FROM by_source WINDOW before AS (ORDER BY source_size * (6 // weight), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT place AS from_place, rest AS level_rest, rest_weight AS level_weight FROM placed
  WHERE CAST(rest * weight AS DOUBLE) / CAST(rest_weight AS DOUBLE) <= CAST({MAX_REPEATS} * source_size AS DOUBLE) ORDER BY place LIMIT 1),
targets AS (
  SELECT source, rank, source_size, total, greatest(1, (total + {slots} - 1) // {slots}) AS bs,
    CASE WHEN place >= from_place THEN CAST(level_rest * weight AS DOUBLE) / CAST(level_weight AS DOUBLE) ELSE CAST({MAX_REPEATS} * source_size AS DOUBLE) END AS target,
    CAST(CASE WHEN place >= from_place THEN level_rest * weight ELSE {MAX_REPEATS} * source_size * level_weight END AS HUGEINT) AS part, total * level_weight AS whole
  FROM placed CROSS JOIN level),
bounds AS (SELECT rank, CAST(sum(part) OVER (ORDER BY rank) * {RANGE} // whole AS BIGINT) AS high, bs, total FROM targets WHERE whole > 0),
shares AS (SELECT rank, coalesce(lag(high) OVER (ORDER BY rank), 0) AS low, high, bs, total FROM bounds),
slots AS (
  SELECT rank, s AS slot, row_number() OVER (PARTITION BY rank ORDER BY s) - 1 AS block
  FROM range({slots}) t(s) JOIN shares ON s * {GOLDEN} % {RANGE} >= low AND s * {GOLDEN} % {RANGE} < high AND s * bs < total),
sources AS (SELECT t.*, least(coalesce(n, 0) * bs, {MAX_REPEATS} * source_size) AS upto FROM targets t LEFT JOIN (SELECT rank, count(*) AS n FROM slots GROUP BY rank) USING (rank)),
streams AS (
  SELECT row_number() OVER () AS r, s.doc_id, s.size, t.rank, t.source_size, t.target, t.upto, t.bs,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sizes s JOIN sources t ON s.source IS NOT DISTINCT FROM t.source),
span AS (SELECT r, lap * source_size + start AS low, least(lap * source_size + start + size, upto) AS high, bs FROM streams CROSS JOIN range({MAX_REPEATS}) l(lap)),
took AS (SELECT r, sum(high - low) AS taken, sum((high - 1) // bs - low // bs + 1) AS n FROM span WHERE low < high GROUP BY r)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, CAST(coalesce(n, 0) AS BIGINT) AS n_slots, CAST(CASE WHEN taken > 0 THEN slot ELSE -1 END AS BIGINT) AS first_slot
FROM streams LEFT JOIN took USING (r) LEFT JOIN slots ON streams.rank = slots.rank AND streams.start // bs = slots.block"""
