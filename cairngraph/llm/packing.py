"""Sequence packing as a cutting-stock problem solved by column generation.

1. Every document is tokenised once (vocabulary file by parameter), closed with
   one end id and cut at multiples of the sequence length; the pieces (span,
   checksum) go to the shared folder.  Only remainders need packing: a piece that
   fills a sequence is a pattern of its own.
2. The histogram of piece lengths, at most ``capacity`` numbers, goes to the driver.
   A revised simplex solves the covering program over patterns.  Its first basis are
   the fullest patterns around the longest piece left, which is what the knapsack
   gives at the duals length / capacity; from there on, a knapsack dynamic program
   prices new columns at duals smoothed towards the best ones so far.  Each pricing
   also proves a lower bound (the duals' value over the price), and the loop ends
   only where no column prices out or the program's value is proved to be within
   ``GAP`` of all or ``SEQUENCES`` sequences of its optimum.
   Activities are rounded down, whole patterns of the largest fractions are taken
   once more, and the program of what is left is solved and rounded in turn; pieces
   of which no pattern fits any more close the last sequences, as full as can be.
3. Patterns become ranges of ranks within each length.  Pieces are ranked by
   hashed buckets and within them, so a length held by a third of all pieces is
   spread, and one join by length against the table of ranges (bounded by the
   number of patterns) gives sequence and offset.

A sequence whose tokens number a power of two needs no padding; the others are
padded to the capacity.

Defined cases: null or empty text is the end id alone; no document gives no rows;
repeated rows are packed each on its own.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairngraph.llm.storage import small_batches, stored

CAPACITY, END_ID, GAP, SEQUENCES, SMOOTHING, BUCKET_PIECES, MIN_BUCKETS = 2048, 1, 1e-5, 0.1, 0.8, 4096, 64
SPECIAL = {"<|endoftext|>": 50256}
Pattern = dict[int, int]


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


_encoders: dict = {}


def encoder(ranks: str):
    """The byte-level BPE of ``byte_bpe_50k.json``, read from the same vocabulary as ranks (the faster library)."""
    if ranks not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[ranks] = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=SPECIAL)
    return _encoders[ranks]


def token_ids(text: str | None, ranks: str) -> np.ndarray:
    """The ids of a text with the end id after them."""
    return np.array([*encoder(ranks).encode(text or "", allowed_special="all"), END_ID], "<u4")


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut(docs: DataFrame, ranks: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document: full ones and the remainder."""
    ranks = ranks or default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = token_ids(text.as_py(), ranks)
                for a in range(0, len(ids), capacity):
                    part = ids[a : a + capacity]
                    rows.append((doc_id, a, len(part), zlib.crc32(part.tobytes()), len(ids)))
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


# --- the cutting-stock problem -------------------------------------------------


def fill(lengths: list[int], limits: list[int], room: int) -> Pattern:
    """The fullest bounded pattern of at most ``room`` tokens, by subset sums as bit sets; long pieces preferred.

    lengths ascending; limits: how many of each there are.
    """
    mask = (1 << (room + 1)) - 1
    reach = 1
    steps: list[tuple[int, int, int]] = []  # (length, copies, sums reachable before)
    for length, limit in zip(lengths, limits):
        left, copies = min(limit, room // length), 1
        while left > 0:  # binary splitting
            take = min(copies, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            copies *= 2
    at = reach.bit_length() - 1
    pattern: Pattern = {}
    for length, take, before in reversed(steps):
        if at >= length * take and (before >> (at - length * take)) & 1:
            pattern[length] = pattern.get(length, 0) + take
            at -= length * take
        if at == 0:
            break
    return pattern


def least_slack(demand: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """(pattern, times) by always closing a sequence around the longest piece left, as full as it can be."""
    left = {k: v for k, v in demand.items() if v > 0}
    order = sorted(left)
    out: list[tuple[Pattern, int]] = []
    while order:
        longest = order[-1]
        left[longest] -= 1
        room = capacity - longest
        fits = [k for k in order if k <= room and left[k] > 0]
        pattern = fill(fits, [left[k] for k in fits], room) if fits else {}
        left[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(left[k] // n for k, n in pattern.items())
        for k, n in pattern.items():
            left[k] -= n * times
        out.append((pattern, times))
        order = [k for k in order if left[k] > 0]
    return out


def _first_basis(lengths: list[int], demand: dict[int, int], capacity: int) -> tuple[list[Pattern], np.ndarray]:
    """A feasible basis: the least-slack pass with fractional times, each step using up one length."""
    left = {k: float(v) for k, v in demand.items()}
    order = list(lengths)
    columns: list[Pattern] = []
    times: list[float] = []
    while order:
        longest = order[-1]
        room = capacity - longest
        fits = [k for k in order if k <= room]
        pattern = fill(fits, [capacity] * len(fits), room) if fits else {}
        pattern[longest] = pattern.get(longest, 0) + 1
        by, gone = min((left[k] / n, k) for k, n in pattern.items())
        for k, n in pattern.items():
            left[k] = max(0.0, left[k] - n * by)
        left[gone] = 0.0
        columns.append(pattern)
        times.append(by)
        order.remove(gone)
    return columns, np.array(times)


def _inverse(columns: list[Pattern], row: dict[int, int]) -> np.ndarray:
    """The inverse of the first basis, by elimination: a length last stands in the column that uses it up.

    Element by element, without the linear algebra library, whose threads can block for ever in a driver
    that has started a JVM.
    """
    last = {k: j for j, pattern in enumerate(columns) for k in pattern}
    used_up = {j: k for k, j in last.items()}
    work = np.eye(len(columns))
    for j, pattern in enumerate(columns):
        pivot = row[used_up[j]]
        work[pivot] /= pattern[used_up[j]]
        for k, n in pattern.items():
            if k != used_up[j]:
                work[row[k]] -= n * work[pivot]
    return work[[row[used_up[j]] for j in range(len(columns))]]


def price(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[float, Pattern]:
    """The pattern of largest value, by an unbounded knapsack over all capacities."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        n = int(np.searchsorted(lengths, c, side="right"))
        best[c] = best[c - 1]
        if n:
            got = best[c - lengths[:n]] + values[:n]
            k = int(got.argmax())
            if got[k] > best[c] + 1e-12:
                best[c], choice[c] = got[k], k
    pattern: Pattern = {}
    c = capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
            continue
        length = int(lengths[choice[c]])
        pattern[length] = pattern.get(length, 0) + 1
        c -= length
    return float(best[capacity]), pattern


class Master:
    """The restricted master program: a basis of patterns and surplus columns, its inverse, duals and activities."""

    def __init__(self, demand: dict[int, int], capacity: int) -> None:
        self.lengths = sorted(demand)
        self.row = {k: i for i, k in enumerate(self.lengths)}
        # Demands a little apart from each other, so that few bases are degenerate; real ones bound the rounding.
        apart = 1 + 1e-5 * np.random.default_rng(0).random(len(self.lengths))
        self.demand = np.array([demand[k] for k in self.lengths]) * apart
        self.columns, _ = _first_basis(self.lengths, dict(zip(self.lengths, self.demand.tolist())), capacity)
        self.inverse = _inverse(self.columns, self.row)
        self.cost = np.ones(len(self.columns))
        self.renew()

    def renew(self) -> None:
        """Activities and duals from the inverse; sums, as products would enter the threaded library."""
        self.x = np.maximum((self.inverse * self.demand).sum(axis=1), 0)
        self.duals = (self.inverse * self.cost[:, None]).sum(axis=0)

    def value(self) -> float:
        return float((self.cost * self.x).sum())

    def worth(self, pattern: Pattern) -> float:
        return sum(n * self.duals[self.row[k]] for k, n in pattern.items())

    def enter(self, pattern: Pattern, cost: float) -> bool:
        """Pivot a column in; False if nothing limits it."""
        direction = sum(n * self.inverse[:, self.row[k]] for k, n in pattern.items())
        grows = direction > 1e-7
        if not grows.any():
            return False
        ratio = np.where(grows, self.x / np.where(grows, direction, 1), np.inf)
        least = ratio.min()
        ties = np.flatnonzero(ratio <= least * (1 + 1e-7) + 1e-9)
        leaving = int(ties[direction[ties].argmax()])  # the largest pivot, for accuracy
        step = ratio[leaving]
        gain = cost - self.worth(pattern)
        self.x = np.maximum(self.x - step * direction, 0)
        self.x[leaving] = step
        self.columns[leaving], self.cost[leaving] = pattern, cost
        pivot = self.inverse[leaving] / direction[leaving]
        self.inverse -= np.outer(direction, pivot)
        self.inverse[leaving] = pivot
        self.duals = self.duals + gain * pivot
        return True


def relaxed(demand: dict[int, int], capacity: int, gap: float = GAP, sequences: float = SEQUENCES) -> tuple[list[tuple[Pattern, float]], float, float]:
    """Column generation: ((pattern, activity), ...) of the linear program, its value and the proved lower bound."""
    master = Master(demand, capacity)
    sizes = np.array(master.lengths)
    centre = sizes / capacity  # the best duals known: feasible, and their value is a bound
    bound = float((master.demand * centre).sum())
    smoothing, steps = SMOOTHING, 0
    while True:
        duals = master.duals
        if master.value() - bound <= max(gap * bound, sequences):
            value, _ = price(centre, sizes, capacity)  # the proof, by what no pattern surpasses
            bound = min(bound, bound / value)
            if master.value() - bound <= max(gap * bound, sequences):
                break
        low = int(duals.argmin())
        if duals[low] < -1e-9:  # more of a length than asked for is no harm
            done = not master.enter({master.lengths[low]: -1}, 0.0)
        else:
            asked = smoothing * centre + (1 - smoothing) * np.maximum(duals, 0)
            value, pattern = price(asked, sizes, capacity)
            proved = float((master.demand * asked).sum()) / value
            if proved > bound:
                bound, centre = proved, asked / value
            if master.worth(pattern) <= 1 + 1e-9:  # not at the duals themselves: smooth less
                done = smoothing == 0
                smoothing = smoothing / 2 if smoothing > 0.1 else 0.0
            else:
                done, smoothing = not master.enter(pattern, 1.0), SMOOTHING
        steps += 1
        if steps % 100 == 0:
            master.renew()
        if done:
            break
    active = [(p, float(x)) for p, x, c in zip(master.columns, master.x, master.cost) if c > 0 and x > 0]
    return active, master.value(), bound


def solve(demand: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Patterns and times that use every piece of the histogram exactly once."""
    out = [({capacity: 1}, demand[capacity])] if demand.get(capacity) else []
    left = {k: v for k, v in demand.items() if 0 < k < capacity and v > 0}
    sequences = SEQUENCES
    while left:
        active, _, _ = relaxed(left, capacity, sequences=sequences)
        sequences = 0.5  # what is left is rounded by more than that
        taken = 0
        for pattern, activity in sorted(active, key=lambda a: -a[1]):
            times = min(int(activity + 1e-4), *(left[k] // n for k, n in pattern.items()))
            taken += _take(out, left, pattern, times)
        for pattern, _ in sorted(active, key=lambda a: a[1] % 1, reverse=True):
            if all(left.get(k, 0) >= n for k, n in pattern.items()):
                taken += _take(out, left, pattern, 1)
        left = {k: v for k, v in left.items() if v > 0}
        if not taken:
            break
    return out + least_slack(left, capacity)


def _take(out: list[tuple[Pattern, int]], left: dict[int, int], pattern: Pattern, times: int) -> int:
    if times > 0:
        out.append((pattern, times))
        for k, n in pattern.items():
            left[k] -= n * times
    return max(0, times)


def padding(patterns: list[tuple[Pattern, int]], capacity: int = CAPACITY) -> int:
    """Padding tokens of all sequences; none where their number is a power of two."""
    total = 0
    for pattern, times in patterns:
        used = sum(k * n for k, n in pattern.items())
        total += 0 if used & (used - 1) == 0 else (capacity - used) * times
    return total


# --- assignment ------------------------------------------------------------------


def ranked(pieces: DataFrame, buckets: int) -> DataFrame:
    """Adds ``rank``, from 0 within each length."""
    rows = pieces.withColumn("h", F.xxhash64("doc_id", "start")).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    before = (
        rows.groupBy("length", "bucket")
        .count()
        .select("length", "bucket", F.coalesce(F.sum("count").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    )
    inside = F.row_number().over(W.partitionBy("length", "bucket").orderBy("h", "doc_id", "start", "ids_crc32", "doc_tokens")) - 1
    return rows.withColumn("inside", inside).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("inside")).drop("h", "bucket", "before", "inside")


def pack(docs: DataFrame, ranks: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece."""
    spark = docs.sparkSession
    pieces = stored(cut(docs, ranks, capacity), "pieces")
    demand = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    table, used, sequence = [], dict.fromkeys(demand, 0), 0
    for pattern, times in solve(demand, capacity):
        at = 0
        for length in sorted(pattern, reverse=True):
            copies = pattern[length]
            table.append((length, used[length], used[length] + copies * times, sequence, copies, at))
            used[length] += copies * times
            at += copies * length
        sequence += times
    places = spark.createDataFrame(table, "p_length long, low long, high long, base long, copies long, at long")
    n = sum(demand.values())
    dealt = ranked(pieces, max(MIN_BUCKETS, 1 << math.ceil(math.log2(max(1, n / BUCKET_PIECES)))))
    return (
        # at most a few rows for each of the patterns, whose number the capacity bounds
        dealt.join(F.broadcast(places), (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
        .withColumn("nth", F.col("rank") - F.col("low"))
        .select(
            "doc_id", "start", "length", "ids_crc32", "doc_tokens",
            F.expr("base + nth div copies").alias("sequence_id"),
            F.expr("at + (nth % copies) * length").alias("offset"),
        )
    )
