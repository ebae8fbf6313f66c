"""Similar vectors of one group: every pair is compared, in cells of two blocks, by matrix products.

A group is dealt into blocks of about ``BLOCK`` vectors and each two blocks meet in one cell.  A task holds the two
blocks of a cell and a strip of products, whatever the size of the group.  Products only screen: a pair that comes
close to the threshold is summed up again in the order of its dimensions, so that a similarity does not depend on
the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 8192
STRIP = 256
CHUNK = 1 << 16
#: More than the rounding of a product of unit vectors.
SLACK = 1e-7
MOST_PARTITIONS = 5000


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def cells(vectors: DataFrame, group: str, block: int = BLOCK) -> DataFrame:
    """(cell, diagonal, second, g, id, embedding, norm), the rows of a cell together.

    Vectors of no length, of unknown group or with null elements are in no pair, as are two of different dimensions.
    """
    kind = dict(vectors.dtypes)["embedding"]
    embedding = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    normed = (
        vectors.select("id", F.col(group).alias("g"), embedding.alias("embedding"))
        .withColumn("norm", F.sqrt(dot("embedding", "embedding")))
        .where("norm > 0 AND g IS NOT NULL AND id IS NOT NULL")
        .withColumn("d", F.size("embedding"))
    )
    blocks = F.ceil(F.col("n") / block)
    sizes = normed.groupBy("g", "d").agg(F.count("*").alias("n"))
    rows, several = sizes.agg(F.sum("n"), F.sum(F.when(F.col("n") > block, blocks * (blocks + 1) / 2))).first()
    # only groups of more than a block are listed, so there are at most as many as blocks
    large = sizes.where(F.col("n") > block).select("g", "d", blocks.alias("blocks"))
    placed = normed.join(F.broadcast(large), ["g", "d"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = placed.withColumn("own", F.pmod(F.xxhash64("id", "embedding"), F.col("blocks")))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cell = F.concat_ws("/", "d", F.least("own", "other"), F.greatest("own", "other"), F.col("g").cast("string"))
    flat = dealt.select(cell.alias("cell"), (F.col("own") == F.col("other")).alias("diagonal"), (F.col("own") > F.col("other")).alias("second"), "g", "id", "embedding", "norm")
    count = min(MOST_PARTITIONS, 3 * int(several or 0) + (rows or 0) // block + 1)
    return flat.repartition(count, "cell").sortWithinPartitions("cell")


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """One table a cell, from rows in which cells follow each other."""
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cell = batch.column(batch.schema.get_field_index("cell"))
        turns = np.flatnonzero(pc.not_equal(cell.slice(1), cell.slice(0, len(cell) - 1)).to_numpy(zero_copy_only=False)) + 1
        bounds = [0, *turns.tolist(), len(cell)]
        for start, end in zip(bounds, bounds[1:]):
            if held and cell[start].as_py() != now:
                yield pa.Table.from_batches(held)
                held = []
            now = cell[start].as_py()
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def _column(table: pa.Table, name: str) -> pa.Array:
    return pa.concat_arrays(table.column(name).chunks)


def _hits(table: pa.Table, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of the smaller id, row of the larger id, similarity) of a cell's pairs.  NaN is above every threshold, as in SQL."""
    n = table.num_rows
    ids, norm = _column(table, "id").to_numpy(zero_copy_only=False), _column(table, "norm").to_numpy()
    vec = _column(table, "embedding").flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64)
    second = _column(table, "second").to_numpy(zero_copy_only=False).astype(bool)
    diagonal = table.column("diagonal")[0].as_py()
    left = np.flatnonzero(~second)
    right = left if diagonal else np.flatnonzero(second)
    with np.errstate(all="ignore"):
        unit = vec / norm[:, None]
        unit[~np.isfinite(norm)] = np.nan
        others = unit[right]
        for k in range(0, len(left), STRIP):
            first = k if diagonal else 0
            x, y = np.nonzero(~(unit[left[k : k + STRIP]] @ others[first:].T < threshold - SLACK))
            if diagonal:
                x, y = x[y > x], y[y > x]
            x, y = left[k + x], right[first + y]
            for at in range(0, len(x), CHUNK):
                a, b = x[at : at + CHUNK], y[at : at + CHUNK]
                total = np.zeros(len(a))
                for i in range(vec.shape[1]):
                    total += vec[a, i] * vec[b, i]
                similarity = total / (norm[a] * norm[b])
                keep = ~(similarity < threshold) & (ids[a] != ids[b])
                a, b, similarity = a[keep], b[keep], similarity[keep]
                if len(a):
                    lower = ids[a] < ids[b]
                    yield np.where(lower, a, b), np.where(lower, b, a), similarity


def pairs(vectors: DataFrame, group: str, threshold: float, block: int = BLOCK) -> DataFrame:
    """(a, b, g, similarity) of all pairs with a < b of equal group at or above the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _tables(batches):
            ids, g = _column(table, "id"), _column(table, "g")
            for a, b, similarity in _hits(table, threshold):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b)), g.take(pa.array(a)), pa.array(similarity)], ["a", "b", "g", "similarity"])

    kinds = dict(vectors.dtypes)
    return cells(vectors, group, block).mapInArrow(run, f"a {kinds['id']}, b {kinds['id']}, g {kinds[group]}, similarity double")


def _join_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The root of every row once rows a and b are joined."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up


def links(vectors: DataFrame, group: str, threshold: float, block: int = BLOCK) -> DataFrame:
    """(src, dst): edges with the same connected components as ``pairs``, at most one for each vector of a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _tables(batches):
            ids, root = _column(table, "id"), np.arange(table.num_rows)
            for a, b, _ in _hits(table, threshold):
                root = _join_roots(root, a, b)
            nodes = np.flatnonzero(root != np.arange(len(root)))
            for at in range(0, len(nodes), CHUNK):
                some = nodes[at : at + CHUNK]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(some)), ids.take(pa.array(root[some]))], ["src", "dst"])

    kind = dict(vectors.dtypes)["id"]
    return cells(vectors, group, block).mapInArrow(run, f"src {kind}, dst {kind}")
