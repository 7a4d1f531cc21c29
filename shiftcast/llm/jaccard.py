"""Set-similarity join of word shingles by parity sketches.

A text's set holds its distinct ``SHINGLE``-word shingles (64-bit hashes).  A
parity sketch toggles one bit for each element, so the sketches of two sets
differ in at most as many bits as the sets differ in elements: their Hamming
distance bounds the symmetric difference from below.  Sets A and B have
Jaccard >= 4/5 exactly if |A xor B| <= (|A| + |B|) / 9.

Search, per band of set sizes (each twice as wide as the one before):

* the bits of a sketch fall into k blocks by the element's hash; a block's key
  combines the codes of its set bits by XOR, so equal blocks have equal keys;
* d differing elements spoil d blocks at most.  A set with more than d
  non-empty blocks therefore shares a non-empty block with every partner
  (pigeonhole), and empty blocks need no key.  k is chosen so that sets have
  more such blocks than their largest possible d; the few that don't also give
  one key for each element, which holds always;
* a set in the lowest quarter of its band also gives keys for the band below,
  where its smaller partners are.

Sets that share a key are candidates, never all pairs of a bucket.  First each set
is compared with the smallest id of its bucket; verified links join into
components.  What then remains are pairs of different components, and for them
each set orders its keys by the number of components in their buckets, rarest
first.  A partner misses at most d of a set's keys, so it meets one of the first
d + 1; keys that no other component has come first and meet nothing.  Hence a set
with more than d keys of its own is done, and the others keep the few keys that
make up the d + 1.  Texts that share a line or passage, or copies too far from
each other to link, end here mostly.  What is left is paired by a join in small
buckets; a bucket of more than ``BIG`` rows is dealt in blocks of rows, compared
as bit matrices within a task, and a pair is given in the first bucket it shares
only.  So no link is lost and no row is capped.

Candidates must pass the size and Hamming bounds of a sketch of two to four bits
an element (folded to the smaller one's width) and are then verified on the whole
sets.

Equal texts are one class before any of this; a class is never expanded.

Defined results: null, empty or wordless texts have no shingle and their own
component; texts of fewer than five words have their whole word sequence as one
shingle; repeated rows of a doc_id with the same text count once.  doc_id must
not be null (such rows are left out).  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftcast.llm.common import (as_long, bound_batches, connected_components, keep_ids, list_array, mix64, ship_package,
                                  span_hashes, store, text_chunks, word_spans)

SHINGLE = 5
#: Rows of a bucket above which it is compared in blocks of at most ``BLOCK`` rows.
BIG, BLOCK = 64, 1024
#: Bits of the smallest sketch; wider bands take four bits for each element of their smallest set.
SKETCH_BITS = 256
_U = np.uint64


def shingle_sets(raw: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted within the row, and their counts."""
    rows = len(offs) - 1
    starts, ends, doc = word_spans(raw, offs)
    words = span_hashes(raw, starts, ends)
    n = np.bincount(doc, minlength=rows)
    base = np.concatenate(([0], np.cumsum(n)))
    # polynomial over the next `size` words; a shorter text takes what it has
    acc = np.zeros(len(words), _U)
    left = base[doc + 1] - np.arange(len(words))
    for k in range(min(size, len(words))):
        here, more = acc[:len(words) - k], words[k:]
        use = left[:len(here)] > k
        here[use] = here[use] * _U(0x100000001B3) + more[use]
    acc = mix64(acc + np.minimum(left, size).astype(_U))
    whole = (left >= size) | ((n[doc] < size) & (left == n[doc]))
    acc, doc = acc[whole], doc[whole]
    n = np.bincount(doc, minlength=rows)
    base = np.concatenate(([0], np.cumsum(n)))
    for r in np.flatnonzero(n > 1):
        acc[base[r]:base[r + 1]].sort()
    new = np.ones(len(acc), bool)
    new[1:] = (acc[1:] != acc[:-1]) | (doc[1:] != doc[:-1])
    return acc[new], np.bincount(doc[new], minlength=rows)


def _blocks(band: np.ndarray) -> np.ndarray:
    """Number of sketch blocks of a size band [2^b, 2^(b+1)), for sets of up to 2.5 * 2^b."""
    low = np.exp2(band)
    fill = np.where(band < 5, 1.0, np.where(band < 8, 2.0, 3.2))
    return np.ceil(2.5 * low / fill).astype(np.int64) + 1


def _keys(h: np.ndarray, n: np.ndarray, band: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the non-empty blocks of each set, their counts, and whether there are enough of them.

    ``h`` is sorted within each set and a block is a range of hash values, so
    the elements of a block lie next to each other.
    """
    rows = len(n)
    doc = np.repeat(np.arange(rows), n)
    k = _blocks(band)
    block = (((h >> _U(32)) * k[doc].astype(_U)) >> _U(32)).astype(np.int64)
    new = np.ones(len(h), bool)
    new[1:] = (block[1:] != block[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    bits = mix64(h ^ _U(0xA5A5A5A5A5A5A5A5))
    keys = np.bitwise_xor.reduceat(bits, at) if len(at) else bits[:0]
    where = (band[doc[at]].astype(_U) << _U(48)) + block[at].astype(_U)
    keys = mix64(keys + mix64(where))
    counts = np.bincount(doc[at], minlength=rows)
    few = counts < need
    if few.any():  # one key for each element as well
        pick = few[doc]
        extra = mix64(bits[pick] ^ mix64(band[doc[pick]].astype(_U) + _U(1 << 62)))
        keys, owner = np.concatenate((keys, extra)), np.concatenate((doc[at], doc[pick]))
        order = np.argsort(owner, kind="stable")
        keys, counts = keys[order], np.bincount(owner, minlength=rows)
    return keys, counts, few


def _sketches(h: np.ndarray, n: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity sketches of all sets as 64-bit words, and the words of each."""
    width = np.maximum(SKETCH_BITS, 4 << band)
    first = np.cumsum(width) - width
    doc = np.repeat(np.arange(len(n)), n)
    bit = (mix64(h ^ _U(0x5851F42D4C957F2D)) & (width[doc] - 1).astype(_U)).astype(np.int64)
    odd = (np.bincount(first[doc] + bit, minlength=int(width.sum())) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64), width // 64


def _entries(batch: pa.RecordBatch):
    """For pieces of a batch: rows, sets, and keys in the own band and in the one below."""
    for i, j, raw, offs in text_chunks(batch.column(1)):
        h, n = shingle_sets(raw, offs)
        band = np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)
        own = _keys(h, n, band, n // 4 + 1)
        below = (n > 0) & (band > 0) & (n * 0.8 < np.exp2(band))
        m = np.where(below, n, 0)
        down = _keys(h[np.repeat(below, n)], m, np.maximum(band - 1, 0), 2 * m // 9 + below)
        yield batch.column(0).slice(i, j - i), h, n, band, own, down


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, h, n, band, own, down in _entries(batch):
            words, counts = _sketches(h, n, band)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), list_array(as_long(words), counts, pa.int64()),
                 pa.array(own[1], pa.int64()), pa.array(own[2]), pa.array(down[1], pa.int64()), pa.array(down[2])],
                ["doc_id", "n", "sketch", "own", "own_few", "down", "down_few"])


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, _, n, _, own, down in _entries(batch):
            for (keys, counts, _), side in ((own, False), (down, True)):
                at = pa.array(np.repeat(np.arange(len(n)), counts))
                yield pa.RecordBatch.from_arrays([pa.array(as_long(keys)), ids.take(at), pa.array(np.full(len(keys), side))],
                                                 ["key", "doc_id", "down"])


_SKETCH_SCHEMA = "doc_id long, n long, sketch array<long>, own long, own_few boolean, down long, down_few boolean"


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, raw, offs in text_chunks(batch.column(1)):
            h, n = shingle_sets(raw, offs)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), list_array(as_long(h), n, pa.int64())],
                                             ["doc_id", "shingles"])


def text_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, rep): rep is the smallest doc_id with the same text; one row per doc_id.

    Where a doc_id occurs with several texts, the text with the smallest hash stands for it.
    """
    key = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit("second"), "text").alias("b"))
    one = (docs.where(F.col("doc_id").isNotNull()).select("doc_id", key.alias("k"))
           .groupBy("doc_id").agg(F.min("k").alias("k")))
    reps = one.groupBy("k").agg(F.min("doc_id").alias("rep"))
    return one.join(reps, "k").select("doc_id", "rep", F.col("k.a").alias("text_hash"))


def _bounds(pairs: DataFrame, small: DataFrame) -> DataFrame:
    """Pairs (u, v) that pass the size and Hamming bounds."""
    a = small.select(F.col("doc_id").alias("u"), F.col("n").alias("nu"), F.col("sketch").alias("su"))
    b = small.select(F.col("doc_id").alias("v"), F.col("n").alias("nv"), F.col("sketch").alias("sv"))
    def narrow(x, y):  # the wider of two sketches folds onto the other's width
        half = F.size(x).bitwiseAND(F.lit(-2)) / 2
        return F.when(F.size(x) > F.size(y), F.zip_with(
            F.slice(x, F.lit(1), half.cast("int")), F.slice(x, (half + 1).cast("int"), half.cast("int")),
            lambda p, q: p.bitwiseXOR(q))).otherwise(x)

    su, sv = F.col("su"), F.col("sv")
    apart = F.aggregate(F.zip_with(narrow(su, sv), narrow(sv, su), lambda p, q: F.bit_count(p.bitwiseXOR(q))),
                        F.lit(0), lambda t, x: t + x)
    return (pairs.join(a, "u").join(b, "v")
            .where((5 * F.least("nu", "nv") >= 4 * F.greatest("nu", "nv")) & (9 * apart <= F.col("nu") + F.col("nv")))
            .select("u", "v", "nu", "nv"))


def _verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Of the pairs those with 100 * intersection >= 80 * union, counted on whole sets."""
    pairs = store(pairs, "pairs")
    ids = store(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct(), "ids")
    sets = store(keep_ids(docs, ids, "doc_id").mapInArrow(_set_rows, "doc_id long, shingles array<long>"), "sets")
    common = F.size(F.array_intersect("su", "sv"))
    return (pairs.join(sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("sv")), "v")
            .join(sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("su")), "u")
            .where(100 * common >= 80 * (F.col("nu") + F.col("nv") - common))
            .select("u", "v"))


def _remaining(shared: DataFrame, comp: DataFrame, rows: DataFrame, small: DataFrame) -> DataFrame:
    """Candidate pairs (u < v) of different components, by the rarest keys of each set."""
    member = shared.drop("lead").join(comp.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left") \
        .withColumn("component", F.coalesce("component", "doc_id"))
    mixed = member.groupBy("key", "component").agg(F.count("*").alias("x")).groupBy("key").agg(F.count("*").alias("parts")) \
        .where("parts > 1")
    member = store(member.join(mixed, "key"), "mixed")
    sides = rows.select("doc_id", F.explode(F.array(
        F.struct(F.lit(False).alias("down"), F.col("own").alias("keys"), F.col("own_few").alias("few"),
                 F.floor(F.col("n") / 4).alias("spoiled")),
        F.struct(F.lit(True).alias("down"), F.col("down").alias("keys"), F.col("down_few").alias("few"),
                 F.floor(2 * F.col("n") / 9).alias("spoiled")))).alias("s")).select("doc_id", "s.*")
    met = member.groupBy("doc_id", "down").agg(F.count("*").alias("met"))
    take = (met.join(sides, ["doc_id", "down"])
            .select("doc_id", "down", F.when(F.col("few"), F.col("met"))
                    .otherwise(F.col("spoiled") + 1 - (F.col("keys") - F.col("met"))).alias("take")).where("take > 0"))
    rare = Window.partitionBy("doc_id", "down").orderBy("parts", "key")
    pool = (member.join(take, ["doc_id", "down"]).withColumn("r", F.row_number().over(rare)).where("r <= take")
            .select("key", "doc_id", "down", "component"))
    pool = store(pool, "pool")
    size = store(pool.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1"), "sizes")
    pool_sized = pool.join(size, "key")

    few = pool_sized.where(F.col("rows") <= BIG)
    a = few.select("key", F.col("doc_id").alias("u"), F.col("component").alias("cu"))
    b = few.select("key", F.col("doc_id").alias("v"), F.col("component").alias("cv"))
    pairs = a.join(b, "key").where("u < v and cu <> cv").select("u", "v").distinct()

    lists = pool.groupBy("doc_id", "down").agg(F.collect_list("key").alias("keys"))
    parts = F.ceil(F.col("rows") / BLOCK).cast("int")
    big = (pool_sized.where(F.col("rows") > BIG).join(small, "doc_id").join(lists, ["doc_id", "down"])
           .withColumn("own", F.pmod(F.xxhash64("doc_id"), parts).cast("int"))
           .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
           .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own",
                   "doc_id", "component", "n", "sketch", "keys"))
    blocks = big.groupBy("key", "i", "j").applyInArrow(_block_pairs, "u long, v long")
    return pairs.unionByName(blocks).distinct()


def _block_pairs(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    """Pairs of a block that pass the size and Hamming bounds and share no smaller key."""
    from shiftcast.llm.common import column_lists

    k, i, j = (x.as_py() for x in key)
    ids, comp, n, own = (t[c].to_numpy() for c in ("doc_id", "component", "n", "own"))
    words, offs = column_lists(t["sketch"])
    # all sketches at the width of the narrowest
    width = int(np.diff(offs).min())
    sketch = np.stack([np.bitwise_xor.reduce(words[a:b].reshape(-1, width), 0) for a, b in zip(offs[:-1], offs[1:])]).view(np.uint64)
    keys, offs = column_lists(t["keys"])
    row = np.repeat(np.arange(len(ids)), np.diff(offs))
    low = keys < k
    vocab, at, count = np.unique(keys[low], return_inverse=True, return_counts=True)
    has = np.zeros((len(ids), len(vocab)), bool)
    has[row[low], at] = True
    has = np.packbits(has[:, count > 1], axis=1)
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    us, vs = [], []
    for x in np.array_split(left, -(-len(left) // 64)) if len(left) else []:
        apart = np.bitwise_count(sketch[x][:, None, :] ^ sketch[right][None, :, :]).sum(2, dtype=np.int64)
        a, b = n[x][:, None], n[right][None, :]
        good = (9 * apart <= a + b) & (5 * np.minimum(a, b) >= 4 * np.maximum(a, b)) & (comp[x][:, None] != comp[right][None, :])
        p, q = np.nonzero(good)
        p, q = x[p], right[q]
        if i == j:
            p, q = p[ids[p] < ids[q]], q[ids[p] < ids[q]]
        new = ~(has[p] & has[q]).any(1)
        us.append(np.minimum(ids[p], ids[q])[new])
        vs.append(np.maximum(ids[p], ids[q])[new])
    none = [np.zeros(0, np.int64)]
    return pa.table({"u": pa.array(np.concatenate(us or none)), "v": pa.array(np.concatenate(vs or none))})


def similarity_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every doc_id of ``docs(doc_id, text)``."""
    ship_package(docs.sparkSession)
    bound_batches(docs.sparkSession)
    classes = store(text_classes(docs), "classes")
    copies = store(classes.where("doc_id <> rep").select("doc_id"), "copies")
    # one row per class, with the text that the class was formed on
    reps = classes.where("doc_id = rep").select("doc_id", "text_hash")
    texts = keep_ids(docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text"), copies, "doc_id", "left_anti")
    if docs.select(F.count("doc_id")).first()[0] != classes.count():  # some doc_id occurs more than once
        texts = (texts.withColumn("text_hash", F.xxhash64("text")).join(reps, ["doc_id", "text_hash"])
                 .dropDuplicates(["doc_id"]).select("doc_id", "text"))
    rows = store(texts.mapInArrow(_sketch_rows, _SKETCH_SCHEMA), "sketches")
    small = rows.where("n > 0").select("doc_id", "n", "sketch")
    keys = texts.mapInArrow(_key_rows, "key long, doc_id long, down boolean")
    by = Window.partitionBy("key")
    shared = store(keys.withColumn("lead", F.min("doc_id").over(by)).withColumn("most", F.max("doc_id").over(by))
                   .where("lead <> most").drop("most"), "buckets")

    # every member with the smallest id of its bucket
    first = store(_bounds(shared.where("doc_id <> lead").select(F.col("lead").alias("u"), F.col("doc_id").alias("v"))
                          .distinct(), small), "first")
    links = store(_verify(first, texts), "links")
    comp = connected_components(links)

    rest = (_remaining(shared, comp, rows, small).join(first.select("u", "v"), ["u", "v"], "left_anti"))
    more = store(_verify(_bounds(rest, small), texts), "more")
    comp = connected_components(links.unionByName(more))

    out = (classes.select("doc_id", "rep").join(rows.select(F.col("doc_id").alias("rep"), "n"), "rep")
           .join(comp.select(F.col("id").alias("rep"), "component"), "rep", "left"))
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      # texts without words are equal, but link with nothing
                      F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "rep")).alias("component_id"))
