"""Packing by cutting-stock column generation.

Documents are encoded once and cut at the capacity, so each leaves full pieces and one rest. The lengths of
all pieces are counted by class (steps of GRAIN ids, so 256 classes at 2,048, whatever the corpus). A linear
program over patterns (how many pieces of each class one sequence holds) is grown column by column: a
knapsack dynamic program prices patterns with the duals until none is worth its sequence. Whole parts of
the solution are used as they are, the few pieces left over go first-fit by falling length. Pieces are
ranked within their class across the cluster, and the rank alone tells the sequence and the place.

The driver handles the class histogram only. A class that holds a third of all pieces is ranked in parts
(each task counts its own, sums of the counts give the offsets).

Defined results: a null text is empty and packs as its end id; an empty table gives no rows; equal doc_ids
stay separate rows; extra columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyhive.llm.bpe import encoder
from skyhive.llm.common import flushes, id_and_text, prepare, spans, stored, table

CAPACITY, GRAIN = 2048, 8
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, class int, rank long"


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """Every document's ids with the end id, cut at the capacity; `rank` counts the task's pieces of a class."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                        ("doc_tokens", pa.int64()), ("part", pa.int32()), ("class", pa.int32()), ("rank", pa.int64())])

    def run(batches):
        part, enc = TaskContext.get().partitionId(), encoder(vocabulary)
        met = np.zeros(-(-capacity // grain) + 1, np.int64)
        for batch in flushes(batches, 8 << 20):
            lengths, ids = enc.encode(batch.column("text"))
            lengths = lengths + 1
            ends = np.cumsum(lengths)
            out = np.full(int(lengths.sum()), end_id, "<u4")
            out[spans(ends - lengths, lengths - 1)] = ids
            count = -(-lengths // capacity)
            owner = np.repeat(np.arange(len(lengths)), count)
            start = spans(np.zeros(len(count), np.int64), count) * capacity
            size = np.minimum(capacity, lengths[owner] - start)
            data, first = memoryview(out.tobytes()), ((ends - lengths)[owner] + start) * 4
            crc = [zlib.crc32(data[a:b]) for a, b in zip(first.tolist(), (first + size * 4).tolist())]
            kind = -(-size // grain)
            order = np.argsort(kind, kind="stable")
            begins = np.searchsorted(kind[order], np.arange(len(met)))
            rank = np.empty(len(kind), np.int64)
            rank[order] = np.arange(len(kind)) - begins[kind[order]] + met[kind[order]]
            met += np.bincount(kind, minlength=len(met))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(owner)), pa.array(start), pa.array(size), pa.array(crc, pa.int64()),
                 pa.array(lengths[owner]), pa.array(np.full(len(kind), part, np.int32)), pa.array(kind.astype(np.int32)), pa.array(rank)],
                schema=schema)

    prepare(docs.sparkSession)
    return id_and_text(docs).mapInArrow(run, _PIECES)


def best_pattern(value: np.ndarray) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the counts of classes 1..n (of sizes 1..n, n the capacity) worth most."""
    n = len(value)
    best, choice = np.zeros(n + 1), np.zeros(n + 1, np.int64)
    for room in range(1, n + 1):
        worth = value[:room] + best[room - 1::-1][:room]  # class c leaves room - c
        c = int(np.argmax(worth))
        if worth[c] > best[room - 1] + 1e-12:
            best[room], choice[room] = worth[c], c + 1
        else:
            best[room] = best[room - 1]
    pattern, room = np.zeros(n, np.int64), n
    while room:
        if choice[room]:
            pattern[choice[room] - 1] += 1
            room -= int(choice[room])
        else:
            room -= 1
    return float(best[n]), pattern


def solve(demand: np.ndarray, gap: float = 1e-4) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used, so that every class finds its demand of places.

    demand[c - 1] pieces of size c; the capacity is len(demand). Column generation stops when the dual bound
    lies within `gap` of the linear program.
    """
    n, rows = len(demand), np.flatnonzero(demand)
    if not len(rows):
        return []
    need = demand[rows].astype(float)
    columns = [np.where(np.arange(n) == r, n // (r + 1), 0) for r in rows]
    cost = np.ones(len(rows))
    inverse = np.diag([1.0 / (n // (r + 1)) for r in rows])
    x = inverse @ need
    while True:
        dual = cost @ inverse
        surplus = int(np.argmin(dual))
        if dual[surplus] < -1e-9:  # a class may be given more places than it has pieces
            entering, pattern, price = np.where(np.arange(len(rows)) == surplus, -1.0, 0.0), None, 0.0
        else:
            value = np.zeros(n)
            value[rows] = dual
            worth, pattern = best_pattern(value)
            if worth <= 1 + 1e-9 or (cost @ x) * (1 - 1 / worth) <= max(0.5, gap * (cost @ x)):
                break
            entering, price = pattern[rows].astype(float), 1.0
        step = inverse @ entering
        ratio = np.where(step > 1e-9, np.maximum(x, 0) / np.where(step > 1e-9, step, 1), np.inf)
        leave = int(np.argmin(ratio))
        x = x - ratio[leave] * step
        x[leave] = ratio[leave]
        pivot = inverse[leave] / step[leave]
        inverse = inverse - np.outer(step, pivot)
        inverse[leave] = pivot
        columns[leave], cost[leave] = pattern, price
    used = [(p, int(np.floor(v + 1e-9))) for p, v in zip(columns, x) if p is not None]
    used = [(p, k) for p, k in used if k > 0]
    left = np.maximum(demand - sum((p * k for p, k in used), np.zeros(n, np.int64)), 0)
    bins: list[np.ndarray] = []
    room: list[int] = []
    for c in range(n, 0, -1):
        for _ in range(int(left[c - 1])):
            i = next((i for i, r in enumerate(room) if r >= c), None)
            if i is None:
                bins.append(np.zeros(n, np.int64))
                room.append(n)
                i = len(bins) - 1
            bins[i][c - 1] += 1
            room[i] -= c
    return used + [(b, 1) for b in bins]


def places(patterns: list[tuple[np.ndarray, int]], n: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each class: ranks at which a pattern's places end, pieces per sequence, first sequence, first slot."""
    found: dict[int, list] = {}
    sequence = 0
    for pattern, times in patterns:
        slot = 0
        for c in np.flatnonzero(pattern).tolist():
            found.setdefault(c + 1, []).append((int(pattern[c]) * times, int(pattern[c]), sequence, slot))
            slot += int(pattern[c])
        sequence += times
    return {c: (np.cumsum([r[0] for r in rows]), *(np.array([r[i] for r in rows]) for i in (1, 2, 3))) for c, rows in found.items()}


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cut = stored(pieces(docs, vocabulary, end_id, capacity, grain), "pieces")
    counts = stored(cut.groupBy("part", "class").agg(F.count("*").alias("n")), "piece-counts")
    demand = np.zeros(capacity // grain, np.int64)
    for row in counts.groupBy("class").agg(F.sum("n").alias("n")).collect():  # at most capacity / grain rows
        demand[row["class"] - 1] = row["n"]
    where = places(solve(demand), len(demand))
    earlier = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "class", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = cut.join(offsets, ["part", "class"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before", "part")

    def assign(batches):
        for batch in batches:
            kind, rank = batch.column("class").to_numpy(), batch.column("rank").to_numpy()
            sequence, slot = np.zeros(len(kind), np.int64), np.zeros(len(kind), np.int64)
            for c in np.unique(kind).tolist():
                ends, per, first, base = where[c]
                at = np.flatnonzero(kind == c)
                k = np.searchsorted(ends, rank[at], side="right")
                q = rank[at] - np.where(k > 0, ends[k - 1], 0)
                sequence[at], slot[at] = first[k] + q // per[k], base[k] + q % per[k]
            kept = [batch.column(x) for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays(kept + [pa.array(sequence), pa.array(slot)],
                                             names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot"])

    placed = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "rank").mapInArrow(
        assign, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long")
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("slot")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 2,048 ids; one row per piece."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
