"""Best-fit packing by linear grouping (after de la Vega and Lueker, with Gilmore and Gomory's columns).

A document is its ids and an end id. One longer than ``capacity`` is cut into pieces of exactly
``capacity`` and a last, shorter one. Only the histogram of piece lengths, at most ``capacity``
entries however many documents there are, comes to the driver, where the packing is planned:

1. large lengths are sorted and split into groups of equal cardinality, each rounded up to its longest;
2. configurations of these few sizes are optimised as a linear programme by column generation
   (its knapsack pricing is exact), and rounded down;
3. actual lengths take the places of their group's size, which leaves each sequence more room;
4. what rounding left over, then the small lengths, go in by best fit, longest first.

All steps work on runs ("n sequences that look alike"), so the plan's size depends on the number of
distinct lengths only. The plan is a list of runs (length, ranks, first sequence, offset), and a piece
finds its own by its rank among the pieces of its length.

Null text: empty, a document of the end id alone. Empty table: empty result. Repeated rows are packed
each. Other columns are ignored.

Scale: one pass over the texts that leaves about 50 bytes a piece in a table; texts and ids are never
shuffled. Ranks come from counts by part (a fixed number of hash parts) and length, then a window
inside each part and length, so a length that a third of all pieces share is spread over the parts.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, parallelism
from .tokens import default_tokenizer, encoder

CAPACITY = 2048
#: Pieces that are ranked together, about.
PART_ROWS = 1 << 18
GROUPS = 96
#: Lengths up to this part of the capacity are small.
SMALL = 1 / 8


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document; the ids themselves stay in the task."""
    path = tokenizer or default_tokenizer()
    end, wide = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def run(batches):
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text")
            for at in range(0, len(texts), 256):
                rows = []
                for d, enc in zip(ids[at : at + 256], encoder(path).encode(texts.slice(at, 256).to_pylist())):
                    enc += end
                    for k in range(0, len(enc), wide):
                        one = enc[k : k + wide]
                        rows.append((d, k // wide, k // 4, len(one) // 4, zlib.crc32(one)))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


@dataclass
class Run:
    """``n`` sequences, numbered from ``first``, that hold the same lengths at the same offsets."""

    n: int
    first: int
    room: int
    items: list[tuple[int, int]] = field(default_factory=list)  # (length, offset)


@dataclass
class Plan:
    capacity: int
    places: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)  # length, rank from, to, first sequence, pieces a sequence, offset
    sequences: int = 0


class _Packer:
    def __init__(self, hist: dict[int, int], capacity: int):
        self.capacity, self.plan = capacity, Plan(capacity)
        self.left = dict(hist)
        self.rank: dict[int, int] = dict.fromkeys(hist, 0)
        self.open: dict[int, list[tuple[int, int]]] = {}  # room -> runs (first sequence, n)
        self.rooms: list[int] = []

    def _add_room(self, room: int, first: int, n: int) -> None:
        if room <= 0 or n <= 0:
            return
        if room not in self.open:
            insort(self.rooms, room)
            self.open[room] = []
        self.open[room].append((first, n))

    def put(self, length: int, n_seq: int, per: int, first: int, offset: int) -> None:
        """``per`` pieces of ``length`` side by side from ``offset`` in each of ``n_seq`` sequences."""
        n = n_seq * per
        self.plan.places.append((length, self.rank[length], self.rank[length] + n, first, per, offset))
        self.rank[length] += n
        self.left[length] -= n

    def new(self, n: int) -> int:
        first = self.plan.sequences
        self.plan.sequences += n
        return first

    def best_fit(self, length: int) -> None:
        """All that is left of one length: into the tightest room that takes it, else into new sequences."""
        while self.left[length]:
            k = bisect_left(self.rooms, length)
            if k == len(self.rooms):
                per = self.capacity // length
                count = self.left[length]
                for n, each in ((count // per, per), (1 if count % per else 0, count % per)):
                    if n:
                        first = self.new(n)
                        self.put(length, n, each, first, 0)
                        self._add_room(self.capacity - each * length, first, n)
                return
            room = self.rooms[k]
            first, n = self.open[room].pop()
            if not self.open[room]:
                del self.open[room], self.rooms[k]
            count, per = self.left[length], room // length
            full = min(n, count // per)
            if full:
                self.put(length, full, per, first, self.capacity - room)
                self._add_room(room - per * length, first, full)
                first, n = first + full, n - full
            rest = self.left[length]
            if n and 0 < rest < per:
                self.put(length, 1, rest, first, self.capacity - room)
                self._add_room(room - rest * length, first, 1)
                first, n = first + 1, n - 1
            self._add_room(room, first, n)

    def configuration(self, groups: list[list[list[int]]], pattern: dict[int, int], n: int) -> None:
        """``n`` sequences of one configuration: every place is filled with actual lengths of its group, longest first."""
        places = [g for g, times in pattern.items() for _ in range(times)]
        while n:
            have = {g: groups[g] for g in pattern}
            if any(not have[g] for g in pattern):
                return
            step, need = n, {g: pattern[g] for g in pattern}
            for g in pattern:  # as many sequences as all take the same lengths from each group
                step = min(step, have[g][0][1] // need[g]) if have[g][0][1] >= need[g] else 0
                if not step:
                    break
            if step:
                take = [(g, have[g][0][0], pattern[g]) for g in pattern]
                first, offset = self.new(step), 0
                for g, length, times in take:
                    self.put(length, step, times, first, offset)
                    offset += length * times
                    have[g][0][1] -= step * times
                    if not have[g][0][1]:
                        have[g].pop(0)
                self._add_room(self.capacity - offset, first, step)
                n -= step
                continue
            first, offset = self.new(1), 0  # a run ends inside this sequence: place by place
            for g in places:
                if not groups[g]:
                    continue
                length = groups[g][0][0]
                self.put(length, 1, 1, first, offset)
                offset += length
                groups[g][0][1] -= 1
                if not groups[g][0][1]:
                    groups[g].pop(0)
            self._add_room(self.capacity - offset, first, 1)
            n -= 1


def linear_groups(hist: dict[int, int], n_groups: int) -> list[tuple[int, list[list[int]]]]:
    """Groups of (nearly) equal cardinality over the sorted lengths, longest first: (rounded size, [[length, count]])."""
    total = sum(hist.values())
    groups: list[tuple[int, list[list[int]]]] = []
    if not total:
        return groups
    target, held, members = max(1, -(-total // n_groups)), 0, []
    for length in sorted(hist, reverse=True):
        count = hist[length]
        while count:
            take = min(count, target - held)
            members.append([length, take])
            held, count = held + take, count - take
            if held == target:
                groups.append((members[0][0], members))
                held, members = 0, []
    if members:
        groups.append((members[0][0], members))
    return groups


def optimise(sizes: list[int], demand: list[int], capacity: int, rounds: int = 4000) -> list[tuple[dict[int, int], float]]:
    """Cutting-stock relaxation by column generation: configurations ({size index: times}) and how often each is used."""
    m = len(sizes)
    if not m:
        return []
    s, d = np.array(sizes), np.array(demand, float)
    columns = np.diag(capacity // s).astype(float)
    inverse = np.diag(1.0 / np.diag(columns))
    x = inverse @ d
    for step in range(rounds):
        if step % 50 == 49:  # against drift
            inverse = np.linalg.inv(columns)
            x = np.maximum(inverse @ d, 0)
        duals = inverse.sum(axis=0)
        value, pattern = _knapsack(s, duals, capacity)
        if value <= 1 + 1e-7:
            break
        change = inverse @ pattern
        up = change > 1e-9
        if not up.any():
            break
        ratios = np.where(up, x / np.where(up, change, 1), np.inf)
        out = int(np.argmin(ratios))
        theta = ratios[out]
        x = np.maximum(x - theta * change, 0)
        x[out] = theta
        columns[:, out] = pattern
        pivot = inverse[out] / change[out]
        inverse = inverse - np.outer(change, pivot)
        inverse[out] = pivot
    return [({i: int(round(c)) for i, c in enumerate(columns[:, j]) if c > 0.5}, float(x[j])) for j in range(m) if x[j] > 1e-9]


def _knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack, exactly: best[c] over capacities by the number of items, of which few fit."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    useful = [int(i) for i in np.argsort(-values / sizes) if values[i] > 1e-9]
    for _ in range(capacity // int(sizes.min())):
        grown = False
        base = best.copy()
        for i in useful:
            w = int(sizes[i])
            cand = base[: capacity + 1 - w] + values[i]
            better = cand > best[w:] + 1e-12
            if better.any():
                best[w:][better], last[w:][better], grown = cand[better], i, True
        if not grown:
            break
    at, pattern = int(np.argmax(best)), np.zeros(len(sizes))
    top, room, chosen = best[at], at, 0.0
    while last[room] >= 0 and room > 0:
        i = int(last[room])
        pattern[i] += 1
        room -= int(sizes[i])
        chosen += values[i]
    return float(chosen if abs(chosen - top) > 1e-6 else top), pattern


def plan_packing(hist: dict[int, int], capacity: int = CAPACITY, n_groups: int = GROUPS, small: float = SMALL) -> Plan:
    """The plan for a histogram of piece lengths (1 to ``capacity``)."""
    packer = _Packer({k: v for k, v in hist.items() if v}, capacity)
    if packer.left.get(capacity):  # whole sequences by themselves
        n = packer.left[capacity]
        packer.put(capacity, n, 1, packer.new(n), 0)
    large = {k: v for k, v in packer.left.items() if v and small * capacity < k < capacity}
    grouped = linear_groups(large, n_groups)
    members = [m for _, m in grouped]
    by_size: dict[int, list[int]] = {}
    for g, (size, _) in enumerate(grouped):
        by_size.setdefault(size, []).append(g)
    sizes = sorted(by_size, reverse=True)
    queues = [[list(p) for g in by_size[z] for p in members[g]] for z in sizes]
    demand = [sum(c for _, c in q) for q in queues]
    for pattern, times in sorted(optimise(sizes, demand, capacity), key=lambda p: (-p[1], sorted(p[0].items()))):
        packer.configuration(queues, pattern, int(times + 1e-6))
    for length in sorted(packer.left, reverse=True):
        packer.best_fit(length)
    return packer.plan


def place(cut: DataFrame, plan: Plan, keys: list[str], parts: int | None = None) -> DataFrame:
    """Give every piece its sequence and offset. ``cut`` must be a written table: it is read twice."""
    spark = cut.sparkSession
    n = parts or max(1, parallelism(spark))
    part = F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")
    counts = cut.groupBy(part.alias("part"), "length").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))  # at most parts x capacity rows
    within = Window.partitionBy("part", "length").orderBy(*keys)
    ranked = (
        cut.withColumn("part", part)
        .withColumn("rank", F.row_number().over(within) - 1)
        .join(base, ["part", "length"])
        .withColumn("rank", F.col("rank") + F.col("base"))
        .drop("base", "part")
    )
    by_length: dict[int, list[tuple]] = {}
    for p in plan.places:
        by_length.setdefault(p[0], []).append(p[1:])
    starts = {k: np.array([p[0] for p in v], np.int64) for k, v in by_length.items()}
    rows = {k: np.array([(p[0], p[2], p[3], p[4]) for p in v], np.int64) for k, v in by_length.items()}
    held = spark.sparkContext.broadcast((starts, rows))  # runs of the plan: bounded by the distinct lengths

    def run(batches):
        starts_, rows_ = held.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for one in np.unique(length):
                at = np.flatnonzero(length == one)
                got = rows_[int(one)][np.searchsorted(starts_[int(one)], rank[at], side="right") - 1]
                k = rank[at] - got[:, 0]
                seq[at] = got[:, 1] + k // got[:, 2]
                off[at] = got[:, 3] + (k % got[:, 2]) * one
            keep = [c for c in b.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(seq), pa.array(off)], [*keep, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.drop("rank").schema.fields)
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    cut = materialize(pieces(docs, tokenizer, capacity, end_id), "pieces")
    hist = {int(r[0]): int(r[1]) for r in cut.groupBy("length").count().collect()}  # at most ``capacity`` rows
    parts = max(parallelism(docs.sparkSession), -(-sum(hist.values()) // PART_ROWS))  # so that what is ranked together doesn't grow with the table
    return place(cut, plan_packing(hist, capacity), ["doc_id", "piece", "start", "ids_crc32"], parts)
