"""Best-fit packing of token sequences by linear grouping.

Lengths are whole numbers up to the capacity, so a histogram of at most ``CAPACITY`` rows says all that the
packing needs, whatever the number of documents. On it, large lengths are sorted into groups of equal
cardinality and rounded up to the largest of their group; few-size configurations of the rounded lengths are
optimised by column generation; actual lengths replace rounded ones; and what is left and the small lengths
go to the bins they fit best. The plan is a table of runs (so many documents of one length, from this rank
on, in these bins), and documents take their places in it by rank within their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm.common import checkpointed, table
from newsloom.llm.transducer import Transducer, transducer

CAPACITY, END_ID = 4096, 1
#: Lengths over CAPACITY // LARGE are large; they form GROUPS groups.
LARGE, GROUPS = 3, 48


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, and its place among pieces of its length in its partition (part, seq)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = transducer(path), np.array([END_ID], "<u4").tobytes()
        seen, part = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            row, piece, crc, length = [], [], [], []
            for i, ids in token_ids(own, (t.as_py() for t in batch.column("text"))):
                whole = memoryview(ids + end)
                for k, at in enumerate(range(0, len(whole), 4 * capacity)):
                    some = whole[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    length.append(len(some) // 4)
                    crc.append(zlib.crc32(some))
            lengths, pieces = np.array(length, np.int64), np.array(piece, np.int64)
            order = np.argsort(lengths, kind="stable")
            first = np.searchsorted(lengths[order], lengths[order])
            seq = np.empty(len(order), np.int64)
            seq[order] = np.arange(len(order)) - first
            seq += seen[lengths]
            seen += np.bincount(lengths, minlength=capacity + 1)
            columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(pieces.astype(np.int32)), pa.array(pieces * capacity), pa.array(lengths), pa.array(crc, pa.int64()), pa.array(np.full(len(row), part, np.int64)), pa.array(seq)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "part", "seq"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, piece int, start long, length long, ids_crc32 long, part long, seq long")


def token_ids(own: Transducer, texts: Iterable[str | None]) -> Iterator[tuple[int, bytes]]:
    """(index, ids as unsigned 32-bit numbers, least significant byte first) of each text."""
    waiting: list[bytes] = []
    index = -1
    for first, ends, outputs in own.read(texts):
        ids = own.tokens(outputs).tobytes()
        bounds = (4 * np.concatenate([[0], np.cumsum(own.counts(outputs))])[ends]).tolist()
        for i, (a, b) in enumerate(zip([0, *bounds], bounds), first):
            if i > index >= 0:
                yield index, b"".join(waiting)
                waiting = []
            index = i
            waiting.append(ids[a:b])
    if index >= 0:
        yield index, b"".join(waiting)


@dataclass
class Plan:
    """Runs of places: ``count`` pieces of ``length`` from rank ``rank`` on; ``per_bin`` of them side by side from ``offset`` in bins from ``bin`` on."""

    capacity: int
    bins: int = 0
    rows: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    next_rank: dict[int, int] = field(default_factory=dict)

    def open(self, n: int) -> int:
        self.bins += n
        return self.bins - n

    def place(self, length: int, count: int, first_bin: int, per_bin: int, offset: int) -> None:
        rank = self.next_rank.get(length, 0)
        self.rows.append((length, rank, count, first_bin, per_bin, offset))
        self.next_rank[length] = rank + count


def _knapsack(sizes: list[int], values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of most value that fits, by dynamic programming over the capacity."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    own, worth = np.array(sizes)[order], values[order]
    for room in range(int(own[0]), capacity + 1):
        k = np.searchsorted(own, room, "right")
        value = best[room - own[:k]] + worth[:k]
        i = int(value.argmax())
        if value[i] > best[room - 1]:
            best[room], taken[room] = value[i], i
        else:
            best[room] = best[room - 1]
    counts, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if taken[room] < 0:
            room -= 1
        else:
            counts[order[taken[room]]] += 1
            room -= int(own[taken[room]])
    return float(best[capacity]), counts


def optimise_configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 10_000) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often each is used in the linear relaxation, by column generation from one-size configurations.

    It ends when no configuration is worth more than it costs; should that not be after ``rounds``, it raises.
    """
    n = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    used = np.linalg.solve(basis, np.array(demand, float))
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(n))
        value, column = _knapsack(sizes, np.maximum(prices, 0), capacity)
        if value <= 1 + 1e-6:
            break
        change = np.linalg.solve(basis, column.astype(float))
        up = change > 1e-9
        if not up.any():
            break
        ratio = np.where(up, np.maximum(used, 0) / np.where(up, change, 1), np.inf)
        out = int(ratio.argmin())
        used = used - ratio[out] * change
        used[out] = ratio[out]
        basis[:, out] = column
    else:
        raise RuntimeError(f"column generation did not end in {rounds} rounds")
    return [(basis[:, j].round().astype(np.int64), float(used[j])) for j in range(n)]


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> Plan:
    """Packs pieces of which only the number of each length (1 to ``capacity``) is known."""
    plan, left = Plan(capacity), {n: c for n, c in histogram.items() if c}
    if full := left.pop(capacity, 0):
        plan.place(capacity, full, plan.open(full), 1, 0)
    large = sorted((n for n in left if n > capacity // LARGE), reverse=True)
    total = sum(left[n] for n in large)
    free: dict[int, list[tuple[int, int]]] = {}
    if total:
        # groups of equal cardinality, as runs of (length, count) from the longest on
        share, members, room = -(-total // groups), [[]], -(-total // groups)
        for n in large:
            count = left[n]
            while count:
                some = min(count, room)
                members[-1].append((n, some))
                count, room = count - some, room - some
                if not room:
                    members.append([])
                    room = share
        members = [m for m in members if m]
        sizes = [m[0][0] for m in members]
        merged: dict[int, list[tuple[int, int]]] = {}
        for size, m in zip(sizes, members, strict=True):  # a length may span groups
            merged.setdefault(size, []).extend(m)
        sizes, members = list(merged), list(merged.values())
        waiting = [list(reversed(m)) for m in members]
        for configuration, times in optimise_configurations(sizes, [sum(c for _, c in m) for m in members], capacity):
            times = int(times + 1e-7)
            if times < 1:
                continue
            bins = [(plan.open(times), times, 0)]  # first bin, how many, used
            for g in np.flatnonzero(configuration).tolist():
                for _ in range(configuration[g]):
                    after: list[tuple[int, int, int]] = []
                    for first, many, taken in bins:
                        while many and waiting[g]:
                            n, count = waiting[g].pop()
                            some = min(many, count)
                            if count > some:
                                waiting[g].append((n, count - some))
                            plan.place(n, some, first, 1, taken)
                            left[n] -= some
                            after.append((first, some, taken + n))
                            first, many = first + some, many - some
                        if many:
                            after.append((first, many, taken))
                    bins = after
            for first, many, taken in bins:
                free.setdefault(capacity - taken, []).append((first, many))
    _best_fit(plan, left, free)
    return plan


def _best_fit(plan: Plan, left: dict[int, int], free: dict[int, list[tuple[int, int]]]) -> None:
    """Puts what is left, the longest first, into the bins with the least room that takes it; ``free``: bins by room."""
    rooms = sorted(r for r in free if r)
    for n in sorted((x for x in left if left[x]), reverse=True):
        count = left[n]
        while count:
            i = bisect_left(rooms, n)
            if i == len(rooms):
                per = plan.capacity // n
                many = max(1, count // per)
                room, (first, have) = plan.capacity, (plan.open(many), many)
            else:
                room = rooms[i]
                first, have = free[room].pop()
                if not free[room]:
                    del free[room], rooms[i]
                per = room // n
                many = min(have, max(1, count // per))
            placed = min(count, per * many)
            per = min(per, placed)
            plan.place(n, placed, first, per, plan.capacity - room)
            count -= placed
            for rest, bins in ((room - per * n, (first, many)), (room, (first + many, have - many))):
                if bins[1] and rest:
                    if rest not in free:
                        free[rest] = []
                        insort(rooms, rest)
                    free[rest].append(bins)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of ``docs`` (doc_id, text) with sequence_id and offset; no sequence holds more than ``capacity`` tokens.

    A document's ids end with ``END_ID``, so null and empty texts are one piece of one token; longer ones are
    cut at every ``capacity`` ids. Ranks within a length run within a partition and over the totals of the
    partitions before it, so a length that many documents share is no group of one task. What reaches the
    driver is the histogram, and what is sent out is the plan: both are bounded by the capacity. Repeated
    rows are packed each; an empty table gives an empty result.
    """
    pieces = checkpointed(token_pieces(docs, path, capacity))
    counts = checkpointed(pieces.groupBy("length", "part").count())
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    rows = np.array(sorted(plan_bins(histogram, capacity).rows) or [(0, 0, 0, 0, 1, 0)], np.int64)
    sent = docs.sparkSession.sparkContext.broadcast((rows[:, 0] << 44 | rows[:, 1], rows))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("seq")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, runs = sent.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            _, first, _, bin_, per, offset = runs[np.searchsorted(keys, length << 44 | rank, "right") - 1].T
            at = rank - first
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(bin_ + at // per), pa.array(offset + at % per * length)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {key}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
