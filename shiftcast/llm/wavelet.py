"""Token-id shards as wavelet matrices: one compressed file answers access, count and occurrence queries.

A shard holds the ids of a run of documents in ascending doc_id order.  Its
wavelet matrix has one bit-plane for each bit of the largest id: plane l holds
bit l (from the top) of every id in the order left by the planes above, and the
ids with a 0 go before those with a 1, order kept.  With counts of ones every
``RANK_BITS`` bits, rank is a table lookup and a few popcounts, so a token, the
count of an id in a prefix and the k-th place of an id each take one step a plane.

File (little-endian): magic, then as 64-bit integers the numbers of ids, planes
and documents; the sizes of the parts that follow; the doc_ids (64 bits) and
their counts (64 bits); zeros in each plane; then the planes, each Zstandard-
compressed by itself, so a query can inflate the planes it needs.  Rank counts
are rebuilt on opening, a single pass over the plane.

Shards go through ``pyarrow.fs`` to the shared folder under a name of their own
and are moved into place, so a repeated or lost task leaves whole files only.

Defined results: null or empty texts have the end id alone; repeated rows of a
doc_id follow each other in order of their text; null doc_ids come first.  A
document's ids never span shards, so a longer document makes a larger shard.
Extra columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftcast.llm.common import ship_package, store
from shiftcast.llm.tokens import encode_column
from shiftcast.llm.warc import _Out, _place

MAGIC = b"WAVEMTX1"
RANK_BITS = 512
#: Ids after which a new shard begins.
SHARD_IDS = 4_000_000
_NULL = -(1 << 63)


def build(ids: np.ndarray) -> tuple[int, np.ndarray, list[np.ndarray]]:
    """Number of planes, zeros of each plane, and the planes' packed bits."""
    planes = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    now = ids.astype(np.uint16 if planes <= 16 else np.uint32)
    zeros, bits = np.zeros(planes, np.int64), []
    for level in range(planes - 1, -1, -1):
        one = (now >> level) & 1 != 0
        bits.append(np.packbits(one, bitorder="little"))
        low = now[~one]
        zeros[planes - 1 - level] = len(low)
        now = np.concatenate((low, now[one]))
    return planes, zeros, bits


def shard_bytes(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    planes, zeros, bits = build(ids)
    pack = pa.Codec("zstd", compression_level=1)
    parts = [pack.compress(b.tobytes(), asbytes=True) for b in bits]
    head = MAGIC + struct.pack(f"<3q{planes}q", len(ids), planes, len(doc_ids), *map(len, parts))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), counts.astype("<i8").tobytes(), zeros.astype("<i8").tobytes(), *parts])


class WaveletMatrix:
    """A shard opened from its bytes."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet-matrix shard")
        self.n, self.planes, docs = struct.unpack_from("<3q", data, 8)
        sizes = struct.unpack_from(f"<{self.planes}q", data, 32)
        at = 32 + 8 * self.planes
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.counts = np.frombuffer(data, "<i8", docs, at + 8 * docs)
        self.zeros = np.frombuffer(data, "<i8", self.planes, at + 16 * docs)
        at += 16 * docs + 8 * self.planes
        self._parts = []
        for size in sizes:
            self._parts.append(data[at:at + size])
            at += size
        if at != len(data):
            raise ValueError("shard is cut short")
        self._open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def plane(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Packed bits of a plane (padded to whole rank blocks) and the ones before each block."""
        if level not in self._open:
            size = -(-self.n // 8)
            raw = np.frombuffer(pa.Codec("zstd").decompress(self._parts[level], size, asbytes=True), np.uint8)
            step = RANK_BITS // 8
            bits = np.zeros(-(-max(size, 1) // step) * step, np.uint8)
            bits[:size] = raw
            ones = np.bitwise_count(bits).reshape(-1, step).sum(1, dtype=np.int64)
            self._open[level] = bits, np.concatenate(([0], np.cumsum(ones)))
        return self._open[level]

    def rank1(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        bits, before = self.plane(level)
        block = i // RANK_BITS
        a = block * RANK_BITS // 8
        whole = int(np.bitwise_count(bits[a:i // 8]).sum())
        part = int(bits[i // 8] & ((1 << i % 8) - 1)).bit_count() if i % 8 else 0
        return int(before[block]) + whole + part

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) ``bit`` of a plane."""
        bits, ones = self.plane(level)
        before = ones if bit else np.arange(len(ones)) * RANK_BITS - ones
        block = int(np.searchsorted(before, k, "right")) - 1
        a = block * RANK_BITS // 8
        inside = np.unpackbits(bits[a:a + RANK_BITS // 8], bitorder="little") == bit
        return block * RANK_BITS + int(np.flatnonzero(inside)[k - int(before[block])])

    def access(self, i: int) -> int:
        """The id at place ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.planes):
            bit = int(self.plane(level)[0][i // 8] >> (i % 8)) & 1
            ones = self.rank1(level, i)
            i = int(self.zeros[level]) + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, symbol: int, i: int) -> tuple[int, int]:
        """Where the ids equal to ``symbol`` among the first ``i`` end up below the last plane."""
        a, b = 0, i
        for level in range(self.planes):
            x, y = self.rank1(level, a), self.rank1(level, b)
            if symbol >> (self.planes - 1 - level) & 1:
                a, b = int(self.zeros[level]) + x, int(self.zeros[level]) + y
            else:
                a, b = a - x, b - y
        return a, b

    def count(self, symbol: int, i: int | None = None) -> int:
        """Occurrences of ``symbol`` among the first ``i`` ids (all by default)."""
        if symbol < 0 or symbol >> self.planes:
            return 0
        a, b = self._range(symbol, self.n if i is None else i)
        return b - a

    def place(self, symbol: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of ``symbol``."""
        if not 0 <= k < self.count(symbol):
            raise IndexError(k)
        i = self._range(symbol, self.n)[0] + k
        for level in range(self.planes - 1, -1, -1):
            bit = symbol >> (self.planes - 1 - level) & 1
            i = self._select(level, bit, i - int(self.zeros[level]) if bit else i)
        return i

    def places(self, symbol: int) -> list[int]:
        return [self.place(symbol, k) for k in range(self.count(symbol))]

    def decode(self) -> np.ndarray:
        """All ids, from the last plane up."""
        now = np.zeros(self.n, np.uint16 if self.planes <= 16 else np.uint32)
        for level in range(self.planes - 1, -1, -1):
            one = np.unpackbits(self.plane(level)[0], count=self.n, bitorder="little").view(bool)
            z = int(self.zeros[level])
            up = np.empty_like(now)
            up[~one], up[one] = now[:z], now[z:] | now.dtype.type(1 << (self.planes - 1 - level))
            now = up
            self._open.pop(level)
        return now


# ---------------------------------------------------------------- Spark side

def _shard_rows(folder: str, path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        docs: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal number, docs, counts, held
            out = _Out(f"{folder}/shard-{part:06d}-{number:06d}.wm")
            rows, ids = np.concatenate(counts), np.concatenate(held)
            out.write(shard_bytes(np.concatenate(docs), rows, ids))
            out.done()
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([f"{folder}/shard-{part:06d}-{number:06d}.wm"]),
                 pa.array([len(rows)], pa.int64()), pa.array([len(ids)], pa.int64())], ["part", "number", "file", "docs", "ids"])
            number, docs, counts, held = number + 1, [], [], []
            return row

        for batch in batches:
            name = batch.column(0).fill_null(_NULL).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j, ids, rows in encode_column(batch.column(1), path):
                docs.append(name[i:j])
                counts.append(rows)
                held.append(ids.astype(np.uint16) if ids.max() < 1 << 16 else ids)
                if sum(map(len, held)) >= limit:
                    yield flush()
        if docs:
            yield flush()
    return run


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and write shards to ``folder`` in doc_id order.

    Returns (part, number, file, docs, ids, start); start is the number of ids in
    all shards before.  Written once.
    """
    ship_package(docs.sparkSession)
    place, path = _place(folder)
    place.create_dir(path, recursive=True)
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
               .repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text")))
    shards = store(ordered.mapInArrow(_shard_rows(folder, tokenizer_path, shard_ids),
                                      "part int, number int, file string, docs long, ids long"), "shards")
    # two steps: sums before each part over one row a part, then sums inside the part
    parts = shards.groupBy("part").agg(F.sum("ids").alias("all"))
    parts = parts.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))
    inside = F.sum("ids").over(Window.partitionBy("part").orderBy("number")) - F.col("ids")
    return shards.withColumn("inside", inside).join(parts, "part").withColumn("start", F.col("before") + F.col("inside")) \
        .drop("before", "inside")


def _document_rows(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                place, path = _place(name)
                with place.open_input_stream(path, compression=None) as file:
                    shard = WaveletMatrix(file.read())
                ids = shard.decode().astype("<u4")
                data = memoryview(ids).cast("B")
                stop = np.cumsum(shard.counts)
                start = stop - shard.counts
                crc = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(start.tolist(), stop.tolist())]
                cols = [pa.array(shard.doc_ids, pa.int64(), mask=shard.doc_ids == _NULL), pa.array(first + start),
                        pa.array(shard.counts, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    offs = pa.array(np.concatenate(([0], stop)), pa.int32())
                    cols.append(pa.ListArray.from_arrays(offs, pa.array(ids.astype(np.int32))))
                out = pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][:len(cols)])
                for k in range(0, out.num_rows, 2000):
                    yield out.slice(k, 2000)
    return run


def read_shards(shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents of the shards listed in ``shards(file, start)``, from the files alone.

    doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian 32-bit
    integers) and, if asked for, ids.
    """
    ship_package(shards.sparkSession)
    spread = shards.select("file", "start").repartition(min(max(1, shards.count()), 10_000))
    return spread.mapInArrow(_document_rows(with_ids), "doc_id long, start long, n_tokens long, ids_crc32 long" +
                             ", ids array<int>" * with_ids)
