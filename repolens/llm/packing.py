"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Piece lengths are whole numbers up to the capacity, so an instance is a histogram of at most ``capacity``
numbers however many pieces there are: the driver plans on that histogram alone, and pieces, ranked within
their length in a distributed way, look their places up in the plan. The reduction fixes bins whose few
pieces dominate any other filling of a bin that holds their largest; what remains goes, largest first, into
the fullest bin that still takes it. Both work on whole classes at once, so the plan's size follows the
number of lengths, not of pieces.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, id_and_text, materialize, slices
from .tokens import default_path, tokenizer

CAPACITY = 1024
END_ID = 2
#: Pieces of one length that are ranked together in a task.
RANKED_TOGETHER = 20_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass
class Plan:
    """Runs of places: pieces of ``size`` with rank in [lo, hi) go ``each`` to a bin, bins from ``base`` on,
    the first at ``offset``."""

    runs: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    bins: int = 0
    fixed: int = 0


class _Classes:
    """Piece counts by length, largest first, and ranks already dealt out."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.left = {s: n for s, n in counts.items() if n > 0}
        self.dealt = dict.fromkeys(self.left, 0)
        self.sizes = sorted(self.left)

    def take(self, size: int, n: int) -> int:
        first = self.dealt[size]
        self.dealt[size] += n
        self.left[size] -= n
        if not self.left[size]:
            self.sizes.pop(bisect.bisect_left(self.sizes, size))
        return first

    def fits(self, room: int, without: tuple[int, ...] = ()) -> int | None:
        """The largest length of at most ``room``, one piece of each in ``without`` set aside."""
        k = bisect.bisect_right(self.sizes, room) - 1
        while k >= 0 and self.left[self.sizes[k]] <= without.count(self.sizes[k]):
            k -= 1
        return self.sizes[k] if k >= 0 else None

    def smallest(self, n: int, without: tuple[int, ...]) -> list[int]:
        got: list[int] = []
        for s in self.sizes:
            got += [s] * min(n - len(got), self.left[s] - without.count(s))
            if len(got) == n:
                break
        return got


def dominating(c: _Classes, j: int, capacity: int) -> tuple[int, ...] | None:
    """A set with one piece of length ``j`` that dominates every other feasible set with it, if one of at
    most three pieces is seen to (Martello and Toth 1990)."""
    room = capacity - j
    three = c.smallest(3, (j,))
    most = sum(sum(three[: k + 1]) <= room for k in range(len(three)))
    if most == 0:
        return (j,)
    best = c.fits(room, (j,))
    if most == 1 or best == room:
        return (j, best)
    if most > 2:
        return None
    pair, top = None, -1
    for a in reversed(c.sizes[: bisect.bisect_right(c.sizes, room)]):
        if 2 * a <= top:
            break
        if c.left[a] <= (j == a):
            continue
        b = c.fits(min(a, room - a), (j, a))
        if b is not None and a + b > top:
            pair, top = (a, b), a + b
    if pair is None or best >= top:
        return (j, best)
    a, b = pair
    if best == a:
        between: list[int] = []
        for s in c.sizes[bisect.bisect_right(c.sizes, b) : bisect.bisect_right(c.sizes, a)]:
            between += [s] * min(2 - len(between), c.left[s] - (s == a) - (s == j))
            if len(between) >= 2:
                break
        if len(between) < 2 or sum(between[:2]) > room:
            return (j, a, b)
    return None


def reduce_instance(c: _Classes, plan: Plan, capacity: int) -> None:
    """Fixes dominating sets, largest piece first, until none is found. Sets of one or two are fixed for a
    whole class at a time (their reason holds while both classes last), sets of three one bin at a time
    where a class runs out and otherwise for all but its last piece."""
    found = True
    while found:
        found = False
        for j in sorted(c.sizes, reverse=True):
            while c.left.get(j):
                group = dominating(c, j, capacity)
                if group is None:
                    break
                need = {s: group.count(s) for s in group}
                times = min(c.left[s] // k for s, k in need.items())
                if len(group) == 3:
                    times = max(1, min((c.left[s] - 1) // k for s, k in need.items()))
                offset = 0
                for s in sorted(need, reverse=True):
                    first = c.take(s, times * need[s])
                    plan.runs.append((s, first, first + times * need[s], need[s], plan.bins, offset))
                    offset += s * need[s]
                plan.bins += times
                plan.fixed += times
                found = True


def best_fit(c: _Classes, plan: Plan, capacity: int) -> None:
    """Largest first, each class into the fullest bins that take it; bins alike move as one group."""
    groups: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []

    def put(room: int, base: int, n: int) -> None:
        if n and room:
            if room not in groups:
                bisect.insort(rooms, room)
            groups.setdefault(room, []).append((base, n))

    for s in sorted(c.sizes, reverse=True):
        n = c.left[s]
        first = c.take(s, n)
        k = bisect.bisect_left(rooms, s)
        while n and k < len(rooms):
            room = rooms.pop(k)
            waiting = groups.pop(room)
            each = room // s
            for base, m in waiting:
                full = min(m, n // each)
                if full:
                    plan.runs.append((s, first, first + full * each, each, base, capacity - room))
                    put(room - each * s, base, full)
                    first, n, base, m = first + full * each, n - full * each, base + full, m - full
                if m and 0 < n < each:
                    plan.runs.append((s, first, first + n, n, base, capacity - room))
                    put(room - n * s, base, 1)
                    first, n, base, m = first + n, 0, base + 1, m - 1
                put(room, base, m)
            k = bisect.bisect_left(rooms, s)
        each = capacity // s
        full = n // each
        for bins, per in ((full, each), (1, n - full * each)):
            if bins and per:
                plan.runs.append((s, first, first + bins * per, per, plan.bins, 0))
                put(capacity - per * s, plan.bins, bins)
                plan.bins += bins
                first += bins * per


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Places for all pieces of a histogram ``length -> count``; lengths are 1 to ``capacity``."""
    if any(not 1 <= s <= capacity for s in counts):
        raise ValueError("a length outside 1 to capacity")
    plan, classes = Plan(), _Classes(counts)
    reduce_instance(classes, plan, capacity)
    best_fit(classes, plan, capacity)
    return plan


def document_pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of each whole text's ids and end id. Longer than ``capacity``: pieces of ``capacity`` from the
    end back, so that only the first may be shorter. Null text is empty and gives its end id alone."""
    vocabulary = tokenizer_path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, at = tokenizer(vocabulary).encode(batch.column("text"))
            ids = np.insert(ids, at[1:], end_id)
            at = at + np.arange(len(at))
            size = np.diff(at)
            n = -(-size // capacity)
            row = np.repeat(np.arange(len(size)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            short = size - (n - 1) * capacity
            start = np.where(piece == 0, 0, short[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, short[row], capacity)
            raw = memoryview(ids.astype("<u4").tobytes())
            begin = at[row] + start
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return id_and_text(docs).mapInArrow(run, PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a written table of pieces with ``length`` (1 to ``capacity``).
    Equal rows get places of their own; an empty table stays empty."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    plan = plan_packing(counts, capacity)
    salts = max(1, -(-max(counts.values(), default=1) // RANKED_TOGETHER))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    sums = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("length").orderBy("salt")
    before = sums.select(F.col("length"), F.col("salt"), (F.sum("n").over(upto) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("own", F.row_number().over(order)).join(before, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("own") - 1).drop("salt", "own", "before")

    runs: dict[int, np.ndarray] = {}
    for size in counts:
        runs[size] = np.array(sorted(r[1:] for r in plan.runs if r[0] == size), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length):
                at = np.flatnonzero(length == size)
                lo, _, each, base, start = runs[int(size)].T
                k = np.searchsorted(lo, rank[at], "right") - 1
                own = rank[at] - lo[k]
                sequence[at] = base[k] + own // each[k]
                offset[at] = start[k] + own % each[k] * size
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    names = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.select(*names, "rank").mapInArrow(run, f"{schema}, sequence_id long, offset long")


def op2_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return pack(materialize(document_pieces(documents(spark, sf_dir)), "pieces"))
