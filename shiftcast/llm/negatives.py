"""Hard negatives from Hilbert-ordered blocks with zone maps.

Candidates are ordered by label and by their place on a Hilbert curve through their
``AXES`` leading principal axes, and written as Parquet rows of ``BLOCK`` vectors each
with a zone map: the least and largest value of every dimension, and of the label.
An anchor's inner product with any vector of a block lies between two sums over the
dimensions, by interval arithmetic.  So a block is read for an anchor's positives only
if its label occurs there and the upper bound reaches the anchor's last positive so
far, and for its negatives only if another label occurs there and the bounds meet one
of its windows above the last negative found for it so far.

Anchors come in rounds of neighbours on the curve, at most ``ROUND_VALUES`` numbers a round,
which is what is broadcast.  A round reads (1) the blocks its anchors stand in, for a
first bound; (2) the zone maps, which name the blocks to read, and those blocks, for the
positives; (3) the zone maps and blocks again, for the negatives of each (anchor,
positive).  Tasks keep the best few of an anchor while they go through their blocks and
skip a block as soon as its bounds fall short of them; a grouped limit takes the best of
all tasks.  Each round's result is a table of its own.  Ranges are cut between any two
vectors, so a label or vector with a third of all rows takes a third of the ranges.

Components are compared as whole numbers: floor(``SCALE`` * x).  Scores are exact as long
as they fit 64 bits; beyond that they count as the nearest 64-bit number.

Bounds: the axes are fitted on at most ``SAMPLE`` vectors of each length, those with the
smallest hash of vec_id (they order blocks and have no part in results).

Defined results: rows with a null vec_id, label or vector, or a null or non-finite
component take no part; vectors of different lengths are never compared; of rows that
share a vec_id the one with the smallest (label, vector) stands.  Ties go to the smaller
vec_id.  Anchors without positives, and positives without negatives, give no row.  Extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftcast.llm.common import column_lists, keep_ids, list_array, running_sum, scratch, ship_package, store

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
WINDOW = (50, 95)  # percent of the positive's score
BLOCK = 512
AXES = 6
CELL_BITS = 8
SAMPLE = 20_000
ROUND_VALUES = 1_500_000
#: Rows of a range, scores that a task computes at once, and hits that it holds before it drops all but the best.
RANGE_ROWS = 64 * BLOCK
STEP = 1_000_000
HELD = 50_000

_LOW = np.iinfo(np.int64).min
_BLOCKS = ("part int, block long, label_lo long, label_hi long, anchors array<long>, lo array<double>, hi array<double>, "
           "ids binary, labels binary, kind string, data binary")


# ---------------------------------------------------------------- order

def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell numbers (below 2 ** ``bits``)."""
    x = cells.T.astype(np.uint64).copy()
    zero, dims = np.uint64(0), len(x)
    for shift in range(bits - 1, 0, -1):  # undo the turns of the larger cubes, from the coarsest bit
        q = np.uint64(1 << shift)
        low = q - np.uint64(1)
        for i in range(dims):
            set_ = (x[i] & q) != zero
            swap = np.where(set_, zero, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= swap
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for shift in range(bits - 1, 0, -1):
        flip ^= np.where((x[dims - 1] & np.uint64(1 << shift)) != zero, np.uint64((1 << shift) - 1), zero)
    x ^= flip
    out = np.zeros_like(x[0])
    for shift in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << np.uint64(1)) | ((x[i] >> np.uint64(shift)) & np.uint64(1))
    return out.astype(np.int64)


@dataclass
class Curve:
    """Principal axes of a sample and the borders of equally filled cells on each."""

    axes: np.ndarray
    edges: list[np.ndarray]

    @staticmethod
    def fit(sample: np.ndarray) -> Curve:
        x = _tame(sample)
        _, _, v = np.linalg.svd(x - x.mean(0), full_matrices=False) if x.size else (0, 0, np.zeros((0, x.shape[1])))
        axes = v[:AXES].T
        at = np.linspace(0, 1, (1 << CELL_BITS) + 1)[1:-1]
        return Curve(axes, [np.quantile(c, at) for c in (x @ axes).T])

    def place(self, x: np.ndarray) -> np.ndarray:
        if not len(self.edges):
            return np.zeros(len(x), np.int64)
        p = _tame(x) @ self.axes
        return hilbert_index(np.stack([np.searchsorted(e, c) for e, c in zip(self.edges, p.T)], 1), CELL_BITS)


def _tame(x: np.ndarray) -> np.ndarray:
    """Extreme values cut, so that squares stay in range; only the order of blocks depends on it."""
    return np.clip(x, -1e100, 1e100)


def _matrix(col, dim: int) -> np.ndarray:
    flat, _ = column_lists(col)
    return flat.astype(np.float64).reshape(-1, dim)


def _placed_rows(shared, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        curve = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 5000):
                part = batch.slice(k, 5000)
                x = _matrix(part.column(part.schema.names.index("embedding")), dim) if dim else np.zeros((part.num_rows, 0))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(curve.place(x))], [*part.schema.names, "place"])
    return run


# ---------------------------------------------------------------- blocks

def _whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) in double precision (exact: SCALE is a power of two), except where that leaves the range."""
    with np.errstate(over="ignore"):
        return np.floor(x * SCALE)


def _pack(x: np.ndarray) -> tuple[str, bytes]:
    q = _whole(x)
    if not q.size or np.abs(q).max() < 1 << 15:
        return "short", q.astype(np.int16).tobytes()
    return "double", x.tobytes()


def _unpack(kind: str, data, rows: int, dim: int) -> np.ndarray:
    """Whole components as doubles, or as Python integers where doubles would not do."""
    if kind == "short":
        return np.frombuffer(data, np.int16).astype(np.float64).reshape(rows, dim)
    return whole_numbers(np.frombuffer(data, np.float64).reshape(rows, dim))


def whole_numbers(x: np.ndarray) -> np.ndarray:
    q = _whole(x)
    if not q.size or np.abs(q).max() < 1 << 53:
        return q
    out = np.empty(x.shape, object)
    out[:] = [[int(v) * SCALE if abs(v) >= 1 << 53 else int(np.floor(v * SCALE)) for v in row] for row in x.tolist()]
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of whole numbers, as 64-bit numbers."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    most = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 1 << 63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = [np.array([[int(v) for v in row] for row in m.tolist()], object) for m in (a, b)]
    return np.clip(whole[0] @ whole[1].T, _LOW, -_LOW - 1).astype(np.int64)


def _block_rows(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (vec_id, label, anchor, embedding) as one row for each BLOCK of them."""
    task, made = TaskContext.get().partitionId(), 0
    waiting: list[pa.RecordBatch] = []

    def row(t: pa.Table) -> pa.RecordBatch:
        nonlocal made
        made += 1
        x = _matrix(t["embedding"], dim) if dim else np.zeros((t.num_rows, 0))
        ids, labels = t["vec_id"].to_numpy().astype(np.int64), t["label"].to_numpy().astype(np.int64)
        q = np.clip(_whole(x), -1e305, 1e305)
        kind, data = _pack(x)
        marked = ids[t["anchor"].to_numpy()]
        one = np.array([1])
        return pa.RecordBatch.from_arrays(
            [pa.array([task], pa.int32()), pa.array([(task << 32) | made], pa.int64()), pa.array([labels.min()]), pa.array([labels.max()]),
             list_array(marked, one * len(marked), pa.int64()), list_array(q.min(0), one * dim, pa.float64()), list_array(q.max(0), one * dim, pa.float64()),
             pa.array([ids.tobytes()], pa.binary()), pa.array([labels.tobytes()], pa.binary()), pa.array([kind]), pa.array([data], pa.binary())],
            [f.split()[0] for f in _BLOCKS.split(", ")])

    for batch in batches:
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) >= BLOCK:
            t = pa.Table.from_batches(waiting)
            whole = t.num_rows // BLOCK * BLOCK
            for k in range(0, whole, BLOCK):
                yield row(t.slice(k, BLOCK))
            waiting = t.slice(whole).to_batches()
    t = pa.Table.from_batches(waiting) if waiting else None
    if t is not None and t.num_rows:
        yield row(t)


# ---------------------------------------------------------------- search

@dataclass
class Round:
    """The anchors of a round and, for each of their searches, the least and largest score wanted."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray        # whole numbers
    least: np.ndarray          # anchor x search; nothing below counts
    most: np.ndarray
    same: bool                 # whether the anchor's own label is wanted, or the others
    keep: int                  # best rows of each search

    def bounds(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score of each anchor with each box, with room for rounding."""
        a = np.clip(self.vectors.astype(np.float64), -1e305, 1e305)
        if not a.shape[1]:
            return np.zeros((len(a), len(lo))), np.zeros((len(a), len(lo)))
        up, down = np.maximum(a, 0), np.minimum(a, 0)
        with np.errstate(over="ignore", invalid="ignore"):
            room = 1 + 1e-9 * (np.abs(a) @ np.maximum(np.abs(lo), np.abs(hi)).T)
            upper = up @ hi.T + down @ lo.T + room
            lower = up @ lo.T + down @ hi.T - room
        # beyond the range of doubles anything is possible
        return np.where(np.isfinite(lower), lower, -np.inf), np.where(np.isfinite(upper), upper, np.inf)

    def wants(self, label_lo, label_hi, lo: np.ndarray, hi: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Whether each anchor must read each block."""
        lower, upper = self.bounds(lo, hi)
        own = self.labels[:, None]
        fits = (label_lo <= own) & (own <= label_hi) if self.same else (label_lo != own) | (label_hi != own)
        meets = np.zeros_like(fits)
        for s in range(least.shape[1]):
            meets |= (upper >= least[:, s, None]) & (lower <= self.most[:, s, None]) & (least[:, s, None] <= self.most[:, s, None])
        return fits & meets


class Best:
    """The first ``keep`` rows of each search: higher scores first, ties by smaller id."""

    def __init__(self, r: Round):
        self.r, self.least = r, r.least.copy()
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.count = 0

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.new.append((slot, score, ids))
        self.count += len(slot)
        if self.count >= max(HELD, len(self.slot)):
            self.settle()

    def settle(self) -> None:
        slot, score, ids = (np.concatenate(x) for x in zip((self.slot, self.score, self.id), *self.new))
        self.new, self.count = [], 0
        order = np.lexsort((ids, ~score, slot))  # ~x falls as x rises, without leaving 64 bits
        slot, score, ids = slot[order], score[order], ids[order]
        first = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1]))) if len(slot) else np.zeros(0, np.int64)
        place = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
        kept = place < self.r.keep
        self.slot, self.score, self.id = slot[kept], score[kept], ids[kept]
        last = place == self.r.keep - 1
        flat = self.least.reshape(-1)
        flat[slot[last]] = np.maximum(flat[slot[last]], score[last])

    def read(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, lo, hi) -> None:
        r = self.r
        near = np.flatnonzero(r.wants(labels.min(), labels.max(), lo[None], hi[None], self.least)[:, 0])
        step = max(1, STEP // max(1, len(ids)))
        for k in range(0, len(near), step):
            a = near[k:k + step]
            s = scores(r.vectors[a], vectors)
            usable = (r.labels[a, None] == labels) == r.same
            if r.same:
                usable &= r.ids[a, None] != ids
            for j in range(self.least.shape[1]):
                p, q = np.nonzero(usable & (s >= self.least[a, j, None]) & (s <= r.most[a, j, None]))
                if len(p):
                    self.add(a[p] * self.least.shape[1] + j, s[p, q], ids[q])


def _search(shared, dim: int, homes: bool):
    """Best rows of the round's searches in a task's blocks; ``homes``: anchors look only into their own block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r: Round = shared.value
        best = Best(r)
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
                vectors, lo, hi = _unpack(row["kind"], row["data"], len(ids), dim), np.array(row["lo"]), np.array(row["hi"])
                if homes:
                    here = np.flatnonzero(np.isin(r.ids, ids))
                    own = Best(Round(r.ids[here], r.labels[here], r.vectors[here], r.least[here], r.most[here], r.same, r.keep))
                    own.read(ids, labels, vectors, lo, hi)
                    own.settle()
                    best.add(here[own.slot], own.score, own.id)
                else:
                    best.read(ids, labels, vectors, lo, hi)
        best.settle()
        n = best.least.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(r.ids[best.slot // n]), pa.array(best.slot % n), pa.array(best.id), pa.array(best.score)],
                                         ["anchor_id", "search", "vec_id", "score"])
    return run


def _wanted(shared):
    """Blocks that some anchor of the round must read, and how many do, from their zone maps alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r: Round = shared.value
        dim = r.vectors.shape[1]
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                lo, hi = (_matrix(part.column(c), dim) if dim else np.zeros((part.num_rows, 0)) for c in ("lo", "hi"))
                want = r.wants(part.column("label_lo").to_numpy(), part.column("label_hi").to_numpy(), lo, hi, r.least).sum(0)
                some = pa.array(np.flatnonzero(want))
                yield pa.RecordBatch.from_arrays([part.column("part").take(some), part.column("block").take(some), pa.array(want[want > 0].astype(np.int64))],
                                                 ["part", "block", "readers"])
    return run


_FOUND = "anchor_id long, search long, vec_id long, score long"


def _first(found: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "search").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


class Index:
    """Blocks of one vector length, searched by rounds of anchors."""

    def __init__(self, rows: DataFrame, dim: int):
        self.spark, self.dim = rows.sparkSession, dim
        sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow()
        curve = Curve.fit(_matrix(sample["embedding"], dim) if dim else np.zeros((sample.num_rows, 0)))
        kind = rows.schema["embedding"].dataType.simpleString()
        placed = rows.mapInArrow(_placed_rows(self.spark.sparkContext.broadcast(curve), dim),
                                 f"vec_id long, label long, anchor boolean, embedding {kind}, place long")
        n = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
        order = ["label", "place", "vec_id"]
        self.placed = store(placed, "placed")
        sorted_ = self.placed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("vec_id", "label", "anchor", "embedding")
        path = scratch(self.spark, "blocks")
        sorted_.mapInArrow(lambda b: _block_rows(b, dim), _BLOCKS).write.partitionBy("part").parquet(path)
        self.blocks = self.spark.read.schema(_BLOCKS).parquet(path)

    def rounds(self) -> Iterator[Round]:
        """Anchors in rounds of neighbours on the curve, searching for positives."""
        size = max(1, ROUND_VALUES // max(1, self.dim))
        marked = store(self.placed.where("anchor"), "anchors")
        total = marked.count()
        placed = store(running_sum(marked, [], ["place", "vec_id"], F.lit(1), "at").withColumn("round", F.expr(f"at div {size}")), "rounds")
        for k in range(-(-total // size)):
            t = placed.where(F.col("round") == k).select("vec_id", "label", "embedding").toArrow()
            x = _matrix(t["embedding"], self.dim) if self.dim else np.zeros((t.num_rows, 0))
            one = np.zeros((t.num_rows, 1), np.int64)
            yield Round(t["vec_id"].to_numpy(), t["label"].to_numpy(), whole_numbers(x), one + _LOW, one + (-_LOW - 1), True, POSITIVES)

    def _read(self, wanted: DataFrame) -> DataFrame:
        wanted = store(wanted, "wanted")
        parts = [r["part"] for r in wanted.select("part").distinct().limit(2001).collect()]
        blocks = self.blocks.where(F.col("part").isin(parts)) if len(parts) <= 2000 else self.blocks  # folders that need no listing
        return keep_ids(blocks, wanted.select("block"), "block")

    def search(self, r: Round) -> DataFrame:
        """(anchor_id, search, vec_id, score, rank) of the round's searches."""
        shared = self.spark.sparkContext.broadcast(r)
        zones = self.blocks.select("part", "block", "label_lo", "label_hi", "lo", "hi")
        rows = self._read(zones.mapInArrow(_wanted(shared), "part int, block long, readers long"))
        return _first(rows.select(*[f.split()[0] for f in _BLOCKS.split(", ")]).mapInArrow(_search(shared, self.dim, False), _FOUND), r.keep)

    def first_bounds(self, r: Round) -> Round:
        """The round with the last positive of each anchor's own block as its least score."""
        shared = self.spark.sparkContext.broadcast(r)
        ids = self.spark.createDataFrame([(int(x),) for x in r.ids], "vec_id long")
        home = self.blocks.select("part", "block", F.explode("anchors").alias("vec_id")).join(F.broadcast(ids), "vec_id", "left_semi")
        found = self._read(home.select("part", "block").distinct()).select(*[f.split()[0] for f in _BLOCKS.split(", ")])
        got = found.mapInArrow(_search(shared, self.dim, True), _FOUND).groupBy("anchor_id").agg(F.count("*").alias("n"), F.min("score").alias("last"))
        least = {a: s for a, n, s in got.where(F.col("n") >= r.keep).select("anchor_id", "n", "last").collect()}
        r.least = np.array([[least.get(int(a), _LOW)] for a in r.ids], np.int64).reshape(-1, 1)
        return r


def _windows(r: Round, found: pa.Table, window: tuple[int, int], keep: int) -> tuple[Round, np.ndarray, np.ndarray]:
    """The round's searches for negatives, one for each positive, and the positives' ids and scores."""
    at = {int(a): i for i, a in enumerate(r.ids)}
    n = max([1, *found["rank"].to_pylist()])
    ids, score = np.zeros((len(r.ids), n), np.int64), np.zeros((len(r.ids), n), np.int64)
    least, most = np.ones((len(r.ids), n), np.int64), np.zeros((len(r.ids), n), np.int64)  # empty unless there is a positive
    for a, v, s, k in zip(*(found[c].to_pylist() for c in ("anchor_id", "vec_id", "score", "rank"))):
        i, j = at[a], k - 1
        ids[i, j], score[i, j] = v, s
        least[i, j], most[i, j] = -(-window[0] * s // 100), window[1] * s // 100
    return Round(r.ids, r.labels, r.vectors, least, most, False, keep), ids, score


def mine(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
         window: tuple[int, int] = WINDOW) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of
    ``vectors(vec_id, embedding, label)`` where ``anchor`` holds, against all of them.

    A positive is one of the first ``positives`` other rows of the anchor's label; its
    negatives are the first ``negatives`` rows of other labels whose score is from
    ``window[0]`` to ``window[1]`` percent of the positive's.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull()).where(finite)
    rows = usable.select("vec_id", F.col("label").cast("long").alias("label"), "embedding", F.coalesce(anchor, F.lit(False)).alias("anchor"))
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "embedding", "anchor")).alias("x"))
    rows = store(one.select("vec_id", "x.label", "x.anchor", "x.embedding", F.size("x.embedding").alias("dim")), "vectors")
    out = scratch(spark, "negatives")
    kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], kind).write.parquet(f"{out}/round=none")
    for dim in sorted(r["dim"] for r in rows.where("anchor").select("dim").distinct().collect()):  # one row for each vector length
        index = Index(rows.where(F.col("dim") == dim).drop("dim"), dim)
        for number, r in enumerate(index.rounds()):
            r.keep = positives
            found = index.search(index.first_bounds(r)).toArrow()  # a few rows for each anchor of the round
            searches, ids, score = _windows(r, found, window, negatives)
            known = [(int(a), j, int(ids[i, j]), int(score[i, j])) for i, a in enumerate(r.ids) for j in range(ids.shape[1])
                     if searches.least[i, j] <= searches.most[i, j]]
            pos = F.broadcast(spark.createDataFrame(known, "anchor_id long, search long, positive_id long, positive_score long"))
            got = index.search(searches).join(pos, ["anchor_id", "search"])
            got.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score",
                       F.col("score").alias("negative_score")).write.parquet(f"{out}/round={dim}-{number}")
    return spark.read.schema(kind).parquet(out).select(*[f.split()[0] for f in kind.split(", ")])
