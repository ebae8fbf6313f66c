"""Exact top-k search by multi-resolution segment statistics.

A vector's coordinates are cut into segments; for each, the mean and the deviation
(root of the summed squared differences from the mean) are kept.  By
Cauchy-Schwarz, over every segment of length L,

    q . x <= L * mean(q) * mean(x) + dev(q) * dev(x),

an upper bound of the inner product and, with the norms, a lower bound of the
distance.  Finer segments give tighter bounds.  A candidate block is bounded for
all queries at the coarsest resolution by one small matrix product; candidates
that cannot reach the current k-th score go, the rest are bounded again at each
finer resolution, and survivors get their exact integer score.

Scale: vectors are packed into chunks during the scan.  Queries (a stated share of
the rows) and candidates form a grid of (candidate block, query block) cells.  Every
query block first meets one candidate block, which gives each of its queries a k-th
score to beat; these go along to all cells.  There, a query that the envelope of the
block's statistics cannot lift to its score skips the cell, and only candidates that
reach it are returned, so that the window that merges them sees few rows a query.
Block counts grow with the table, cells stay bounded.

Defined cases: vectors that are null or hold a null or non-finite component take
no part, nor do rows with a null vec_id; scores compare only vectors of equal
length; a query's own row is every row with its vec_id; repeated query rows with
equal vectors are one query, repeated candidate rows are candidates each; scores
beyond a 64-bit integer are compared exactly and returned clamped; an empty table
gives no rows; ties go to the smaller vec_id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairngraph.llm.storage import stored

SCALE, LEVELS, CHUNK, CELL_CANDIDATES, CELL_QUERIES = 1024, (4, 16), 512, 8192, 2048
EXACT = float(1 << 52)
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def quantised(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x), x as double: int64 where the products stay exact, else Python integers."""
    values = np.floor(scale * vectors)
    if np.abs(values).max(initial=0) ** 2 * max(1, values.shape[1]) < EXACT:
        return values.astype(np.int64)
    return np.array([[int(v) for v in row] for row in values], dtype=object)


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(L) * mean and deviation of each segment, side by side: rows multiply to the upper bound."""
    edges = np.unique(np.linspace(0, x.shape[1], segments + 1).astype(int))[:-1]
    if not len(edges):
        return np.zeros((len(x), 0))
    size = np.diff(np.append(edges, x.shape[1]))
    mean = np.add.reduceat(x, edges, axis=1) / size
    square = np.add.reduceat((x - np.repeat(mean, size, axis=1)) ** 2, edges, axis=1)
    return np.hstack([mean * np.sqrt(size), np.sqrt(square)])


def search_block(q_ids: np.ndarray, q: np.ndarray, x_ids: np.ndarray, x: np.ndarray, k: int, levels: tuple[int, ...] = LEVELS, floors: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(query row, vec_id, score) of the k best of a block for each query, ties to the smaller id.

    floors: a score for each query that k candidates are known to reach; smaller ones are left out.
    """
    floors = np.full(len(q), -np.inf) if floors is None else floors
    out: list[tuple[int, int, int]] = []
    if q.dtype == object or x.dtype == object or float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1]) >= EXACT:
        for i in range(len(q)):
            scores = [(-sum(int(a) * int(b) for a, b in zip(q[i], row)), int(v)) for v, row in zip(x_ids, x) if v != q_ids[i]]
            out += [(i, v, max(LOW, min(HIGH, -s))) for s, v in sorted(scores)[:k]]
        return out
    order = np.argsort(x_ids, kind="stable")
    x_ids, x, q = x_ids[order], x[order].astype(np.float64), q.astype(np.float64)
    # Rounding slack of the bounds, far below one unit of score for any table that passes EXACT.
    slack = 1e-9 * np.linalg.norm(q, axis=1) * float(np.linalg.norm(x, axis=1).max(initial=0)) + 0.25
    stats = [(segment_statistics(q, n), segment_statistics(x, n)) for n in levels]
    # The best that any row within the block's envelope could score.
    top, bottom = (f(stats[0][1], axis=0, initial=b) if len(x) else np.zeros(stats[0][1].shape[1]) for f, b in ((np.max, -np.inf), (np.min, np.inf)))
    hopeful = np.flatnonzero(np.maximum(stats[0][0] * top, stats[0][0] * bottom).sum(axis=1) + slack >= floors)
    coarse = np.full((len(q), len(x)), -np.inf)
    coarse[hopeful] = stats[0][0][hopeful] @ stats[0][1].T
    probe = min(len(x), 4 * k)
    for i in hopeful:
        bound = coarse[i] + slack[i]
        seed = np.argpartition(-bound, probe - 1)[:probe] if probe else np.zeros(0, int)
        seed = seed[x_ids[seed] != q_ids[i]]
        known = np.sort(x[seed] @ q[i])[::-1]
        reach = max(floors[i], known[k - 1] if len(known) >= k else -np.inf)
        alive = np.flatnonzero((bound >= reach) & (x_ids != q_ids[i]))
        for query_stats, block_stats in stats[1:]:
            alive = alive[block_stats[alive] @ query_stats[i] + slack[i] >= reach]
        score = x[alive] @ q[i]
        alive, score = alive[score >= reach], score[score >= reach]
        best = np.lexsort((alive, -score))[:k]  # rows are in id order
        out += [(int(i), int(x_ids[a]), int(s)) for a, s in zip(alive[best], score[best])]
    return out


CHUNK_SCHEMA = "dim int, part int, chunk int, is_query boolean, ids binary, vectors binary"


def _chunks(rows: DataFrame, is_query: Column) -> DataFrame:
    """Pack valid vectors as doubles, CHUNK rows of one length together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        held: dict[tuple[int, bool], list[tuple[int, bytes]]] = {}

        def emit(key: tuple[int, bool]) -> pa.RecordBatch:
            nonlocal number
            rows, number = held.pop(key), number + 1
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([key[0]], pa.int32()), pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([key[1]]),
                    pa.array([np.array([r[0] for r in rows], np.int64).tobytes()], pa.binary()), pa.array([b"".join(r[1] for r in rows)], pa.binary()),
                ],
                names=["dim", "part", "chunk", "is_query", "ids", "vectors"],
            )

        for batch in batches:
            vectors = batch.column(1)
            flat, at = vectors.values, vectors.offsets.to_numpy()
            broken = flat.is_null().to_numpy(zero_copy_only=False) | ~np.isfinite(flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64))
            numbers = flat.fill_null(0).to_numpy(zero_copy_only=False).astype("<f8")
            for r, (vec_id, asked) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                if vec_id is None or not vectors.is_valid()[r].as_py() or broken[at[r] : at[r + 1]].any():
                    continue
                row = numbers[at[r] : at[r + 1]]
                for key in ((len(row), False), (len(row), True))[: 1 + bool(asked)]:
                    held.setdefault(key, []).append((vec_id, row.tobytes()))
                    if len(held[key]) >= CHUNK:
                        yield emit(key)
        for key in list(held):
            yield emit(key)

    return rows.select("vec_id", "embedding", is_query.alias("asked")).mapInArrow(run, CHUNK_SCHEMA)


def _unpack(chunks: pd.DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.concatenate([np.frombuffer(b, np.int64) for b in chunks["ids"]])
    return ids, np.frombuffer(b"".join(chunks["vectors"]), "<f8").reshape(len(ids), dim)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = SCALE, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest integer inner products of each query.

    vectors: vec_id and embedding; is_query: which of its rows are queries.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    packed = stored(_chunks(rows, F.coalesce(is_query, F.lit(False))), "vectors")
    n = packed.groupBy("is_query").agg(F.count("*").alias("n")).collect()
    sizes = {r["is_query"]: r["n"] for r in n}
    across, down = (max(1, math.ceil(sizes.get(q, 0) * CHUNK / size)) for q, size in ((False, CELL_CANDIDATES), (True, CELL_QUERIES)))
    own = lambda m: F.pmod(F.xxhash64("part", "chunk"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    candidates = packed.where("not is_query").withColumn("x", own(across))
    queries = packed.where("is_query").withColumn("y", own(down))

    def probe(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """A block of distinct queries, each with the k-th score of one block of candidates."""
        if not len(right):
            return pd.DataFrame(columns=["dim", "y", "ids", "vectors", "floors"])
        q_ids, q = _unpack(right, key[0])
        once = np.unique(np.column_stack([q_ids.view(np.float64), q]).view(f"V{8 * (q.shape[1] + 1)}").ravel(), return_index=True)[1]
        q_ids, q = q_ids[once], q[once]
        floors = np.full(len(q), -np.inf)
        if len(left):
            x_ids, x = _unpack(left, key[0])
            found = pd.DataFrame(search_block(q_ids, quantised(q, scale), x_ids, quantised(x, scale), k, levels), columns=["q", "vec_id", "score"])
            full = found.groupby("q")["score"].agg(["size", "min"])
            full = full[(full["size"] == k) & (full["min"].abs() < EXACT)]
            floors[full.index.to_numpy(int)] = full["min"].to_numpy(float)
        return pd.DataFrame([{"dim": key[0], "y": key[1], "ids": q_ids.tobytes(), "vectors": q.tobytes(), "floors": floors.tobytes()}])

    first = candidates.where("x = 0").withColumn("y", every(down))
    asked = first.groupBy("dim", "y").cogroup(queries.groupBy("dim", "y")).applyInPandas(probe, "dim int, y int, ids binary, vectors binary, floors binary")
    asked = stored(asked, "queries").withColumn("x", every(across))

    def cell(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if not len(left) or not len(right):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in names})
        x_ids, x = _unpack(left, key[0])
        q_ids, q = _unpack(right, key[0])
        floors = np.frombuffer(b"".join(right["floors"]), "<f8")
        found = search_block(q_ids, quantised(q, scale), x_ids, quantised(x, scale), k, levels, floors)
        return pd.DataFrame([(int(q_ids[i]), v, s) for i, v, s in found], columns=names, dtype="int64")

    grid = candidates.withColumn("y", every(down)).groupBy("dim", "x", "y").cogroup(asked.groupBy("dim", "x", "y"))
    partial = grid.applyInPandas(cell, "query_id long, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return partial.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle(every: int = 100, k: int = 10, scale: int = SCALE) -> str:
    """The same rows in DuckDB SQL, by brute force."""
    return f"""
WITH valid AS (
  SELECT vec_id, list_transform(embedding, lambda v: CAST(floor({scale} * CAST(v AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_sum(list_transform(list_zip(q.e, x.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, e FROM valid WHERE vec_id % {every} = 0) q JOIN valid x ON q.vec_id <> x.vec_id AND len(q.e) = len(x.e)),
numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM numbered WHERE rank <= {k}"""
