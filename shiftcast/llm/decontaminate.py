"""Benchmark decontamination: a BM25 index of test items, queried by every training passage.

Items are cut into blocks; a posting holds a term's BM25 impact on an item,
divided by the item's own score, so 1 means every term of the item was met and
one threshold serves all items.  The index also keeps each term's largest impact
and each term's largest impact within each block.

Passages are windows of twice the longest item (at least ``WINDOW`` words) at
half steps, so every copy of an item lies whole in one.  The distinct words of a
passage are its query.  WAND with block maxima, a batch of passages at a time:
passages whose terms' bounds sum to less than the threshold are skipped; of the
rest the blocks whose block bounds sum to less; only the postings of what is
left are scored.  All items that reach the threshold are retrieved, none is
capped.  A hit counts as a leak when the passage also holds at least ``OVERLAP``
of the three-word shingles of the item's question and of its answer (its last
sentence; of an item of one sentence the second half of its words).

The index is cut into shards of at most ``SHARD_TERMS`` postings; each is
broadcast in turn to one pass over the documents, so its size is bounded whatever
the number of items.  Term statistics cover all items.

Defined results: null, empty or wordless documents and items match nothing;
repeated items or documents give a row for each pair of rows.  Extra columns are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftcast.llm.common import as_long, bound_batches, mix64, ship_package, span_hashes, store, text_bytes, text_chunks, word_spans
from shiftcast.llm.toxicity import PARTS

K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.5
WINDOW = 128
BLOCK = 16
SHARD_TERMS = 1_000_000


def _expand(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges [start, start + count) and the range of each."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[owner], owner


def _shingles(words: np.ndarray, size: int = 3) -> np.ndarray:
    size = min(size, len(words))
    if not size:
        return words
    acc = words[:len(words) - size + 1].copy()
    for k in range(1, size):
        acc = acc * np.uint64(0x100000001B3) + words[k:len(words) - size + 1 + k]
    return np.unique(mix64(acc + np.uint64(size)))


def _words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw, offs = text_bytes(pa.array([text], pa.large_string()))
    starts, ends, _ = word_spans(raw, offs, PARTS)
    return span_hashes(raw, starts, ends), starts, raw


def question_and_answer(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of an item's question and answer."""
    words, starts, raw = _words(text)
    stops = np.flatnonzero(np.isin(raw, np.frombuffer(b".?!\n", np.uint8)))
    # the last sentence begins behind the last stop that has words on both sides
    cuts = [int(np.searchsorted(starts, s)) for s in stops]
    cuts = [c for c in cuts if 0 < c < len(words)]
    cut = cuts[-1] if cuts else (len(words) + 1) // 2
    return words[:cut], words[cut:]


class Index:
    """One shard of the inverted index, as arrays sorted by (term, item)."""

    def __init__(self, items: list[tuple[int, object, str]], term: np.ndarray, item: np.ndarray, impact: np.ndarray):
        self.rows = [i for i, _, _ in items]
        self.ids = [x for _, x, _ in items]
        self.parts = []
        for _, _, text in items:
            q, a = question_and_answer(text)
            self.parts.append((_shingles(q), _shingles(a), min(3, len(q)), min(3, len(a))))
        number = np.searchsorted(np.array(self.rows), item)
        order = np.lexsort((number, term))
        term, self.item, self.impact = term[order], number[order], impact[order]
        self.terms, self.first, self.count = np.unique(term, return_index=True, return_counts=True)
        own = np.repeat(np.arange(len(self.terms)), self.count)
        self.bound = np.maximum.reduceat(self.impact, self.first) if len(term) else np.zeros(0)
        block = self.item // BLOCK
        new = np.ones(len(term), bool)
        new[1:] = (own[1:] != own[:-1]) | (block[1:] != block[:-1])
        at = np.flatnonzero(new)
        self.b_block, self.b_first = block[at], at
        self.b_count = np.diff(np.append(at, len(term)))
        self.b_bound = np.maximum.reduceat(self.impact, at) if len(at) else np.zeros(0)
        self.bt_first = np.searchsorted(own[at], np.arange(len(self.terms)))
        self.bt_count = np.bincount(own[at], minlength=len(self.terms))
        self.blocks = int(block.max()) + 1 if len(block) else 0

    def search(self, passage: np.ndarray, term: np.ndarray, n: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, score) of every pair at or above the threshold, for distinct (passage, term) pairs."""
        low = threshold - 1e-9
        live = np.bincount(passage, self.bound[term], n) >= low  # else no pivot exists
        pick = live[passage]
        passage, term = passage[pick], term[pick]
        at, own = _expand(self.bt_first[term], self.bt_count[term])
        key = passage[own] * self.blocks + self.b_block[at]
        some, back = np.unique(key, return_inverse=True)
        open_ = np.bincount(back, self.b_bound[at], len(some)) >= low  # block bound
        pick = open_[back]
        at, own = at[pick], own[pick]
        post, range_ = _expand(self.b_first[at], self.b_count[at])
        pair = passage[own[range_]] * len(self.rows) + self.item[post]
        some, back = np.unique(pair, return_inverse=True)
        score = np.bincount(back, self.impact[post], len(some))
        good = score >= low
        return some[good] // len(self.rows), some[good] % len(self.rows), score[good]


def _leak_rows(shared, window: int, threshold: float, overlap: float, id_type: pa.DataType):
    step = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in batches:
            for i, j, raw, offs in text_chunks(batch.column(1)):
                starts, ends, doc = word_spans(raw, offs, PARTS)
                words = span_hashes(raw, starts, ends)
                n = np.bincount(doc, minlength=j - i)
                base = np.cumsum(n) - n
                passages = np.maximum(-(-n // step) - 1, 1)
                p_base = np.cumsum(passages) - passages
                at = np.minimum(np.searchsorted(index.terms, words), len(index.terms) - 1)
                hit = np.flatnonzero(index.terms[at] == words)
                part = (hit - base[doc[hit]]) // step
                # a word lies in the passage that begins in its half window and in the one before
                own, term = np.concatenate((doc[hit], doc[hit])), np.concatenate((at[hit], at[hit]))
                part = np.concatenate((part, part - 1))
                ok = (part >= 0) & (part < passages[own])
                key = np.unique((p_base[own[ok]] + part[ok]) * len(index.terms) + term[ok])
                passage, item, score = index.search(key // len(index.terms), key % len(index.terms),
                                                    int(passages.sum()), threshold)
                best: dict[tuple[int, int], tuple] = {}
                for p, t, s in zip(passage.tolist(), item.tolist(), score.tolist()):
                    r = int(np.searchsorted(p_base, p, "right")) - 1
                    a = int(base[r]) + (p - int(p_base[r])) * step
                    own_words = words[a:min(a + window, int(base[r] + n[r]))]
                    q, ans, qn, an = index.parts[t]
                    both = [float(np.isin(x, _shingles(own_words, m)).mean()) if len(x) else 1.0 for x, m in ((q, qn), (ans, an))]
                    if min(both) >= overlap:
                        row = (s, a - int(base[r]), *both)
                        best[r, t] = max(best.get((r, t), row), row, key=lambda x: (x[0], -x[1]))
                if best:
                    rows = sorted(best)
                    got = [best[x] for x in rows]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array([i + r for r, _ in rows])),
                         pa.array([index.ids[t] for _, t in rows], id_type), pa.array([g[0] for g in got]),
                         pa.array([g[2] for g in got]), pa.array([g[3] for g in got]), pa.array([g[1] for g in got], pa.int64())],
                        ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"])
    return run


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, raw, offs in text_chunks(batch.column(1)):
            starts, ends, doc = word_spans(raw, offs, PARTS)
            words = span_hashes(raw, starts, ends)
            n = np.bincount(doc, minlength=j - i)
            order = np.lexsort((words, doc))
            words, doc = words[order], doc[order]
            new = np.ones(len(words), bool)
            new[1:] = (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])
            at = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i).take(pa.array(doc[at])), pa.array(as_long(words[at])),
                 pa.array(np.diff(np.append(at, len(words))), pa.int64()), pa.array(n[doc[at]], pa.int64())],
                ["row", "term", "tf", "length"])


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP,
          window: int = WINDOW, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """Pairs of ``docs(doc_id, text)`` and ``items(item_id, text)`` where the document holds the item.

    doc_id, item_id, score (share of the item's own BM25 score), question_overlap,
    answer_overlap, first_word (of the best passage).
    """
    spark = docs.sparkSession
    ship_package(spark)
    bound_batches(spark)
    items = store(items.where("text is not null").select(F.monotonically_increasing_id().alias("row"), "item_id", "text"), "items")
    terms = store(items.select("row", "text").mapInArrow(_term_rows, "row long, term long, tf long, length long"), "terms")
    size = terms.groupBy("row").agg(F.first("length").alias("length")).agg(
        F.count("*").alias("n"), F.avg("length").alias("mean"), F.max("length").alias("most")).first()
    fields = [docs.schema["doc_id"], items.schema["item_id"]]
    from pyspark.sql import types as T
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in fields],
                           *[T.StructField(c, T.DoubleType()) for c in ("score", "question_overlap", "answer_overlap")],
                           T.StructField("first_word", T.LongType())])
    if not size["n"]:
        return spark.createDataFrame([], schema)
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    tf, norm = F.col("tf"), K1 * (1 - B + B * F.col("length") / size["mean"])
    weight = F.log(1 + (size["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5)) * tf * (K1 + 1) / (tf + norm)
    shards = max(1, math.ceil(terms.count() / shard_terms))
    weighted = terms.join(df, "term").select("row", "term", weight.alias("w"), F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"))
    own = weighted.groupBy("row").agg(F.sum("w").alias("own"))
    impacts = store(weighted.join(own, "row").select("row", "term", (F.col("w") / F.col("own")).alias("impact"), "shard"), "impacts")
    window = max(window, 2 * int(size["most"]))
    from pyspark.sql.pandas.types import to_arrow_type
    kind = to_arrow_type(items.schema["item_id"].dataType)
    found = []
    for s in range(shards):
        part = impacts.where(F.col("shard") == s).toArrow()
        if not part.num_rows:
            continue
        rows = sorted((r["row"], r["item_id"], r["text"]) for r in items.where(
            F.pmod(F.xxhash64("row"), F.lit(shards)) == s).collect())
        known = set(part["row"].to_pylist())
        index = Index([r for r in rows if r[0] in known], part["term"].to_numpy().view(np.uint64), part["row"].to_numpy(),
                      part["impact"].to_numpy())
        run = _leak_rows(spark.sparkContext.broadcast(index), window, threshold, overlap, kind)
        found.append(docs.select("doc_id", "text").mapInArrow(run, schema))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
