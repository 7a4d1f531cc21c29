"""Near-duplicate vectors by a pivot-permutation index.

Some vectors of a bounded sample, none close to another, serve as pivots.  Every
vector is described by its ``PREFIX`` nearest pivots in order, and stands in the
inverted list of each.  Two vectors are candidates when they share at least
``SHARED`` of their pivots; candidates are verified by their cosine in double
precision.  So no pair below the threshold is reported; pairs above it are missed
only if their descriptions share too few pivots (tests measure the recall
against all pairs; it is above 0.99 on the given tables).

Equal vectors are one class with a weight.  A list is compared within a task:
shared pivots are popcounts of bit rows, and a pair counts in the first list it
shares only, so a task gives one row for each vector, its number of links and an
edge to the smallest vector of its component there, not the pairs.  A list of
more than ``BLOCK`` vectors is dealt in pairs of blocks, so a list that holds a
third of all vectors takes many tasks, each of bounded size.  The number of
pivots grows with the square root of the number of vectors.

Bounds: pivots come from at most ``SAMPLE`` vectors, those with the smallest hash of
vec_id.  Every vector is indexed and queried.

Defined results: vectors that are null, empty, zero, or hold null, NaN or infinite
components link with nothing; vectors of different length are never compared.
Rows that share a vec_id with equal vectors count as one, and of different ones
the one with the smallest hash stands for the id; null vec_ids are left out.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftcast.llm.common import column_lists, connected_components, list_array, ship_package, store

THRESHOLD = 0.9
PREFIX = 12
SHARED = 2
SAMPLE = 40_000
BLOCK = 1500
MOST_PIVOTS = 8192


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` unit vectors of the sample, as far from each other as it allows; fewer if it is one narrow cone."""
    chosen = np.zeros((0, sample.shape[1]))
    for limit in (0.5, 0.7, 0.85):
        for x in sample:
            if len(chosen) >= n:
                return chosen
            if not len(chosen) or (chosen @ x).max() < limit:
                chosen = np.vstack([chosen, x])
    return chosen


def _unit(col) -> tuple[np.ndarray, np.ndarray]:
    """Rows of unit vectors in double precision."""
    flat, offs = column_lists(col)
    x = flat.astype(np.float64).reshape(len(offs) - 1, -1)
    x = x / np.abs(x).max(1, keepdims=True)  # else squares of extreme values leave the range
    return x / np.sqrt((x * x).sum(1, keepdims=True)), offs


def _describe(shared, prefix: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                x, _ = _unit(part.column(1))
                near = np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :prefix]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, list_array(near.ravel().astype(np.int32), np.full(len(x), near.shape[1]), pa.int32())],
                    [*part.schema.names, "pivots"])
    return run


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row of each row's component under links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(pivots: int, threshold: float, shared: int):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        pivot, i, j = (x.as_py() for x in key)
        t = t.sort_by("vec_id")
        ids, weight, own = (t[c].to_numpy() for c in ("vec_id", "weight", "own"))
        near, offs = column_lists(t["pivots"])
        x, _ = _unit(t["embedding"])
        has = np.zeros((len(ids), -(-pivots // 64) * 64), bool)
        has[np.repeat(np.arange(len(ids)), np.diff(offs)), near] = True
        bits = np.packbits(has, axis=1, bitorder="little").view(np.uint64)
        has[:, pivot:] = False
        low = np.packbits(has, axis=1, bitorder="little").view(np.uint64)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        pa_, pb = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        step = max(1, 4_000_000 // max(1, len(right) * bits.shape[1]))
        for k in range(0, len(left), step):
            rows = left[k:k + step]
            count = np.zeros((len(rows), len(right)), np.uint8)
            for w in range(bits.shape[1]):
                count += np.bitwise_count(bits[rows, w][:, None] & bits[right, w][None, :])
            p, q = np.nonzero(count >= shared)
            p, q = rows[p], right[q]
            if i == j:
                p, q = p[p < q], q[p < q]
            first = ~(low[p] & low[q]).any(1)
            p, q = p[first], q[first]
            for s in range(0, len(p), 100_000):
                a, b = p[s:s + 100_000], q[s:s + 100_000]
                good = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
                pa_.append(a[good])
                pb.append(b[good])
        a, b = np.concatenate(pa_), np.concatenate(pb)
        links = np.bincount(a, weight[b], len(ids)) + np.bincount(b, weight[a], len(ids))
        root = _roots(len(ids), a, b)
        some = np.flatnonzero(links)
        return pa.table({"vec_id": pa.array(ids[some]), "links": pa.array(links[some].astype(np.int64)), "root": pa.array(ids[root[some]])})
    return run


def _usable() -> F.Column:
    e = F.col("embedding")
    return (e.isNotNull() & (F.size(e) > 0)
            & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists(e, lambda x: x != 0))


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD, prefix: int = PREFIX, shared: int = SHARED,
                 pivots: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every vec_id of ``vectors(vec_id, embedding)``."""
    spark = vectors.sparkSession
    ship_package(spark)
    key = F.struct(F.xxhash64("embedding").alias("a"), F.xxhash64(F.lit("second"), "embedding").alias("b"))
    rows = (vectors.where("vec_id is not null").select("vec_id", "embedding", key.alias("key"), F.coalesce(_usable(), F.lit(False)).alias("usable")))
    one = rows.groupBy("vec_id").agg(F.min(F.struct("usable", "key")).alias("x")).select("vec_id", "x.usable", "x.key")
    groups = one.where("usable").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    classes = store(one.join(groups.withColumn("usable", F.lit(True)), ["key", "usable"], "left")
                    .select("vec_id", "key", F.coalesce("rep", "vec_id").alias("rep"), F.coalesce("weight", F.lit(1)).alias("weight"), "usable"), "classes")
    reps = store(rows.join(classes.where("usable and vec_id = rep").select("vec_id", "key", "weight"), ["vec_id", "key"])
                 .dropDuplicates(["vec_id"]).select("vec_id", "embedding", "weight", F.size("embedding").alias("dim")), "vectors")
    found = None
    for r in reps.groupBy("dim").count().collect():  # one row for each vector length
        part = reps.where(F.col("dim") == r["dim"]).drop("dim")
        n = pivots or int(min(MOST_PIVOTS, max(64, 4 * r["count"] ** 0.5)))
        sample = part.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(SAMPLE, 20 * n)).select("embedding").toArrow()
        unit, _ = _unit(sample["embedding"])
        chosen = choose_pivots(unit, n)
        # few pivots: short descriptions, or every list would hold every vector
        width = min(prefix, max(1, len(chosen) // 4))
        need = shared if width >= 6 else 1
        described = store(part.mapInArrow(_describe(spark.sparkContext.broadcast(chosen), width),
                                          f"vec_id long, embedding {reps.schema['embedding'].dataType.simpleString()}, weight long, pivots array<int>"), "described")
        size = store(described.select(F.explode("pivots").alias("pivot")).groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")), "lists")
        lists = (described.withColumn("pivot", F.explode("pivots")).join(size, "pivot")
                 .withColumn("own", F.pmod(F.xxhash64("vec_id"), "parts").cast("int"))
                 .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
                 .select("pivot", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "vec_id", "weight", "pivots", "embedding"))
        got = lists.groupBy("pivot", "i", "j").applyInArrow(_links(len(chosen), threshold, need), "vec_id long, links long, root long")
        found = got if found is None else found.unionByName(got)
    if found is None:
        found = spark.createDataFrame([], "vec_id long, links long, root long")
    found = store(found, "links")
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    comp = connected_components(found.select(F.col("vec_id").alias("u"), F.col("root").alias("v")))
    out = (classes.join(links.withColumnRenamed("vec_id", "rep"), "rep", "left")
           .join(comp.select(F.col("id").alias("rep"), "component"), "rep", "left"))
    component = F.coalesce("component", "rep")
    return out.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"),
                      component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
