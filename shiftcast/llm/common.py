"""Helpers shared by the operators: tables, scratch folders, text as bytes, components.

Scratch data goes to the folder in ``spark.checkpoint.dir`` as Parquet, so it
survives lost executors and cuts the lineage of everything built on it.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shiftcast.session import ensure_checkpoint_dir

#: Ids that may be broadcast (8 bytes each); beyond it the join is shuffled.
BROADCAST_IDS = 500_000
#: Bytes of text that one numpy step handles; a longer text is one step.  A step's arrays take some 200 bytes for each.
CHUNK_BYTES = 500_000
#: Bytes of rows that Spark hands a Python worker at once; a longer row comes alone.
BATCH_BYTES = 2_000_000


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches end at ``BATCH_BYTES`` unless the session has a bound of its own.

    By default only a number of rows ends them, so that whole texts fill tens of
    megabytes, several times over, in the worker and outside the heap of its executor.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str, wide: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and return it as a table read from there.

    ``wide`` is for rows of about a megabyte.  Parquet looks at a page's size only every 100
    rows, so such a file's columns would be one page each, which writers and readers hold
    whole, plain and compressed, in buffers outside the heap.
    """
    path = scratch(df.sparkSession, name)
    out = df.write
    if wide:
        out = out.option("parquet.page.size.row.check.min", "1").option("parquet.page.size.row.check.max", "1")
    out.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_ids(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose ``key`` is (``left_anti``: is not) in the table ``ids``.

    ``ids`` is broadcast when it has at most ``BROADCAST_IDS`` rows (counted
    here, so store it first); otherwise both sides are shuffled.
    """
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, key, how)


#: Rows that one part of a distributed running sum aims at.
PART_ROWS = 100_000


def running_sum(df: DataFrame, group: list[str], order: list, value, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows before it in its ``group`` by ``order``.

    Rows are range-partitioned by group and order, so a large group takes many
    parts; each part is summed on its own and begins where the parts before it end
    (one row for each part and group).  ``df`` should be stored, its group columns
    without nulls and the order total, or rows that tie alike.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // PART_ROWS))
    # the part is written with the row, so it no longer depends on how rows are read
    parts = store(df.withColumn("_value", value).repartitionByRange(n, *group, *order).withColumn("_part", F.spark_partition_id()), "parts")
    before = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("_part", *group).agg(F.sum("_value").alias("_all"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = totals.select("_part", *group, F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_start"))
    rows = parts.withColumn("_before", F.coalesce(F.sum("_value").over(before), F.lit(0)))
    return (rows.join(start, ["_part", *group]).withColumn(name, F.col("_start") + F.col("_before"))
            .select(*df.columns, name))


# ---------------------------------------------------------------- text as bytes

def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a text column and its n + 1 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    _, off, data = col.buffers()
    offs = np.frombuffer(off, np.int64)[col.offset:col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0]:offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def row_chunks(offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes each (one row at least)."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j
        i = j


def text_chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of pieces of a text column."""
    raw, offs = text_bytes(col)
    for i, j in row_chunks(offs, limit):
        yield i, j, raw[offs[i]:offs[j]], offs[i:j + 1] - offs[i]


#: 0x20 and 0x09-0x0D part words.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(raw: np.ndarray, offs: np.ndarray, parts: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of bytes outside ``parts``; rows never join."""
    if not len(raw):
        return (np.zeros(0, np.int64),) * 3
    inside = ~parts[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    inner = offs[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    first[inner] = inside[inner]
    last[inner - 1] = inside[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: A random-looking value for each byte, A-Z as a-z.
FOLDED = mix64(np.arange(1, 257, dtype=np.uint64) * _ODD)
FOLDED[65:91] = FOLDED[97:123]
EXACT = mix64(np.arange(1, 257, dtype=np.uint64) * _ODD)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of an odd base and of its inverse modulo 2^64."""
    if len(_POWERS.get("up", ())) <= n:
        size = max(n, CHUNK_BYTES + 1) + 1
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        for key, base in (("up", _ODD), ("down", inverse)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = FOLDED) -> np.ndarray:
    """64-bit polynomial hash of each span, from one running sum over all bytes."""
    up, down = _powers(len(raw))
    run = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(values[raw] * up[:len(raw)], out=run[1:])
    return mix64((run[ends] - run[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column with ``counts[i]`` of the ``values`` in row i."""
    offs = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(values, kind))


def column_lists(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column of numbers, and the n + 1 offsets of its rows."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    counts = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
    return col.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))


# ---------------------------------------------------------------- components

def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(id, component) for every vertex of ``edges``; component is the smallest id reachable.

    Alternating large-star and small-star rounds; every round is one written
    table, and only its row count and checksum reach the driver.  Rounds grow
    with the logarithm of the component size.
    """
    e = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v")
    e = store(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _signature(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        e = store(small, "edges")
        now = _signature(e)
        if now == seen:
            break
        seen = now
    stars = e.groupBy("u").agg(F.min("v").alias("v"))
    return (stars.select(F.col("u").alias("id"), F.col("v").alias("component"))
            .unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()))
