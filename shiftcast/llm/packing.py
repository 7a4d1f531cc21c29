"""Sequence packing as a cutting-stock problem solved by column generation.

A text's ids are cut into full pieces of ``CAPACITY`` and a rest, and the rest into
a multiple of ``GRAIN`` ids and a crumb of fewer (``cut_rest=False`` keeps rests
whole and rounds them up to a multiple, which costs half a ``GRAIN`` of padding a
text).  Pieces are counted by length; this histogram, of bounded size whatever the
corpus, is all that the driver sees.  There a linear
program over patterns (how many pieces of each length share a sequence) is solved
by the simplex method: its dual prices go to an unbounded-knapsack dynamic
program that finds the pattern of largest value, which enters the basis, until
Farley's bound proves the value within ``GAP`` of the optimum.  Counts of
patterns are rounded down and what is left is packed best-fit decreasing.

The patterns give each class a list of rank ranges, and pieces are ranked within
their class by counts per slice of the pieces table and a rank inside the slice,
so no class meets in one task.  Offsets come from a window over one sequence.

Defined results: a null or empty text is the single end id; every doc_id row is
packed for itself, repeated ones too; an empty table gives no piece.  Extra
columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftcast.llm.common import bound_batches, ship_package, store
from shiftcast.llm.tokens import encode_column

CAPACITY = 2048
GRAIN = 16
GAP = 1e-3


# ---------------------------------------------------------------- patterns

def best_pattern(value: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable multiset of sizes that fits the room."""
    best = np.zeros(room + 1)
    pick = np.full(room + 1, -1)
    for c in range(1, room + 1):
        fit = np.searchsorted(sizes, c, "right")
        if fit:
            got = best[c - sizes[:fit]] + value[:fit]
            k = int(np.argmax(got))
            if got[k] > best[c - 1] + 1e-12:
                best[c], pick[c] = got[k], k
                continue
        best[c] = best[c - 1]
    pattern = np.zeros(len(sizes), np.int64)
    c = room
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            pattern[pick[c]] += 1
            c -= sizes[pick[c]]
    return float(best[room]), pattern


def generate_columns(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and their fractional counts that meet ``demand`` with the fewest sequences."""
    m = len(sizes)
    patterns = np.diag(room // sizes).astype(np.int64)
    inverse = np.diag(1.0 / np.diag(patterns))
    x = inverse @ demand
    while True:
        price = np.maximum(inverse.sum(axis=0), 0)
        value, new = best_pattern(price, sizes, room)
        if value <= 1 + gap:
            return patterns, x
        move = inverse @ new
        up = move > 1e-9
        if not up.any():
            return patterns, x
        step = np.full(m, np.inf)
        step[up] = np.maximum(x[up], 0) / move[up]
        k = int(np.argmin(step))
        x = np.maximum(x - step[k] * move, 0)
        x[k] = step[k]
        patterns[k] = new
        row = inverse[k] / move[k]
        inverse -= np.outer(move, row)
        inverse[k] = row


def integer_patterns(sizes: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Patterns and whole counts that use every item exactly once."""
    if not len(sizes):
        return []
    patterns, x = generate_columns(sizes, demand.astype(float), room)
    out, left = [], demand.copy()
    for p, n in zip(patterns, np.floor(x + 1e-9).astype(np.int64)):
        used = p > 0
        n = min(int(n), int((left[used] // p[used]).min())) if used.any() else 0
        if n > 0:
            out.append((p.copy(), n))
            left -= n * p
    # best-fit decreasing over what rounding left: a few items for each class
    bins: list[np.ndarray] = []
    free: list[int] = []
    for k in range(len(sizes) - 1, -1, -1):
        for _ in range(int(left[k])):
            fits = [(f, b) for b, f in enumerate(free) if f >= sizes[k]]
            if fits:
                b = min(fits)[1]
            else:
                b = len(bins)
                bins.append(np.zeros(len(sizes), np.int64))
                free.append(room)
            bins[b][k] += 1
            free[b] -= int(sizes[k])
    return out + [(b, 1) for b in bins]


@dataclass
class Plan:
    """Rank ranges of each class: ``lo`` is the first rank, the rest says where it goes."""

    classes: np.ndarray
    lo: np.ndarray
    first_sequence: np.ndarray
    each: np.ndarray
    slot: np.ndarray


def make_plan(histogram: dict[int, int], room: int, capacity: int) -> Plan:
    """Sequences for ``histogram`` (class -> pieces).

    Class ``room`` holds the full pieces, smaller ones those of so many grains,
    and -n the crumbs of n ids, which share sequences of their own.
    """
    rows, rank, sequence = [], dict.fromkeys(histogram, 0), 0
    if room in histogram:
        rows.append((room, 0, 0, 1, 0))
        sequence = histogram[room]
    grains, crumbs = sorted(c for c in histogram if 0 < c < room), sorted((c for c in histogram if c < 0), reverse=True)
    for classes, limit in ((grains, room), (crumbs, capacity)):
        sizes = np.abs(np.array(classes, np.int64))
        for p, n in integer_patterns(sizes, np.array([histogram[c] for c in classes], np.int64), limit):
            slot = 0
            for k in np.flatnonzero(p)[::-1]:
                c = classes[k]
                rows.append((c, rank[c], sequence, int(p[k]), slot))
                rank[c] += int(p[k]) * n
                slot += int(p[k])
            sequence += n
    t = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return Plan(*t.T)


# ---------------------------------------------------------------- Spark side

def _pieces(path: str, capacity: int, grain: int, cut_rest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, ids, rows in encode_column(batch.column(1), path):
                data = memoryview(ids.astype("<u4")).cast("B")
                full, rest = rows // capacity, rows % capacity
                main = rest // grain * grain if cut_rest else rest
                n = full + (main > 0) + (rest > main)
                doc = np.repeat(np.arange(len(rows)), n)
                k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                whole, crumb = k < full[doc], k == full[doc] + (main[doc] > 0)
                start = np.where(crumb, full[doc] * capacity + main[doc], k * capacity)
                length = np.where(whole, capacity, np.where(crumb, (rest - main)[doc], main[doc]))
                kind = np.where(crumb, -length, -(-length // grain))
                at = 4 * ((np.cumsum(rows) - rows)[doc] + start)
                crc = [zlib.crc32(data[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i).take(pa.array(doc)), pa.array(start), pa.array(length),
                     pa.array(crc, pa.int64()), pa.array(rows[doc].astype(np.int64)), pa.array(kind.astype(np.int32))],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class"])
    return run


def _assign(plan: Plan, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.column("class").to_numpy(zero_copy_only=False).astype(np.int64)
            r = batch.column("rank").to_numpy(zero_copy_only=False).astype(np.int64)
            key = plan.classes.astype(np.float64)  # classes are small, so (class, lo) searches as two steps
            first = np.searchsorted(key, c, "left")
            last = np.searchsorted(key, c, "right")
            at = first.copy()
            for k in np.unique(c):
                own = c == k
                a, b = first[own][0], last[own][0]
                at[own] = a + np.searchsorted(plan.lo[a:b], r[own], "right") - 1
            off, each = r - plan.lo[at], plan.each[at]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(x) for x in names], pa.array(plan.first_sequence[at] + off // each),
                 pa.array(plan.slot[at] + off % each)], [*names, "sequence_id", "slot"])
    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, grain: int = GRAIN,
         cut_rest: bool = True) -> DataFrame:
    """One row per piece of ``docs(doc_id, text)``.

    doc_id, start (ids of its text before it), length, ids_crc32 (of its ids as
    little-endian 32-bit integers), doc_tokens, sequence_id, offset.
    """
    ship_package(docs.sparkSession)
    bound_batches(docs.sparkSession)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    pieces = store(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .mapInArrow(_pieces(tokenizer_path, capacity, grain, cut_rest),
                    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int")
        .withColumn("slice", F.spark_partition_id()), "pieces")
    counts = store(pieces.groupBy("slice", "class").agg(F.count("*").alias("n")), "counts")
    histogram = {r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    plan = make_plan(histogram, capacity // grain, capacity)
    before = counts.select("slice", "class", (F.sum("n").over(Window.partitionBy("class").orderBy("slice")) - F.col("n"))
                           .alias("before"))
    inside = F.row_number().over(Window.partitionBy("slice", "class").orderBy("doc_id", "start")) - 1
    ranked = pieces.withColumn("inside", inside).join(before, ["slice", "class"]).select(
        *names, "class", (F.col("inside") + F.col("before")).alias("rank"))
    placed = ranked.mapInArrow(_assign(plan, names), "doc_id long, start long, length long, ids_crc32 long, "
                               "doc_tokens long, sequence_id long, slot long")
    up_to = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    return placed.select(*names, "sequence_id", (F.sum("length").over(up_to) - F.col("length")).alias("offset"))
