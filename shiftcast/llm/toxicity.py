"""Toxic spans by a linear-chain conditional random field.

Documents carry labels, tokens don't, so words are weighed first: by their smoothed
log-odds between toxic and clean training documents, times the probability that the word
tells them apart at all (``_trust``: its likelihood ratio against the number of words that
were tried).  So a few labels give words of little weight, and many labels give the rarer
words theirs; there is no count from which a word is used.  Tokens of toxic documents whose
word is more likely than not to tell are the weak labels (without any, those of the words
trusted most).  The field has two states (clean, toxic); a token's features are a bias, the
weight of its word and those of both neighbours.  It is fitted by gradient ascent on the
likelihood of the weak labels.  Scoring runs forward-backward on every text: tokens whose
marginal is at least one half form the offending spans (byte offsets merged, given as
character offsets), and the document's score is a logistic function, fitted on the training
documents' labels, of the sum of the toxic marginals and the largest one.

Marginals depend on word weights nearby: a token more than ``REACH`` tokens from
every weighed word has, to 1e-6, the marginal of a chain without such words, which
adds nothing to a document.  So only stretches around weighed words are computed,
many side by side, and a text of any length costs memory for its stretches only.

Fitting: texts stay on the executors, where they are hashed; words are counted by a
grouped sum, and what reaches the driver are the words that have weight, the weights
along the stretches of the training documents and two numbers for each of them.  The
fit is bounded: at most ``MAX_TRAIN`` labelled documents of each class, those
with the smallest hash of doc_id, of at most ``MAX_TRAIN_CHARS`` characters, and all their
stretches.  All else covers every document and every character.

Defined results: null, empty and wordless texts score like a text without any
weighed word; without labels of both classes every score is 0.  Repeated rows are scored each for itself;
of contradicting labels of one doc_id toxic wins; null labels and doc_ids are not
trained on.  Extra columns pass, but for those called like the two that are added.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftcast.llm.common import as_long, bound_batches, column_lists, keep_ids, list_array, mix64, ship_package, row_chunks, span_hashes, store, text_chunks, word_spans

MAX_TRAIN = 3000
MAX_TRAIN_CHARS = 40_000
#: Weights below this one add nothing to speak of.
SCORED = 0.25
#: Weight at least of a word that only toxic documents without any other have.
MARK = 3.0
REACH = 16
ROUNDS = 80
#: Tokens of stretches that are computed side by side.
SIDE = 1 << 18
#: Bytes of text that are scored in one step; in smaller ones too few stretches lie side by side.
SCORE_BYTES = 2_000_000

#: Bytes that are not part of a word: ASCII other than letters and digits.
PARTS = np.array([not chr(b).isalnum() if b < 128 else False for b in range(256)])


@dataclass
class Model:
    """Word scores (by sorted hash), field weights and the document-level logistic."""

    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    odds: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(4))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    logistic: np.ndarray = field(default_factory=lambda: np.zeros(3))
    fitted: bool = False


def _scores(model: Model, words: np.ndarray) -> np.ndarray:
    if not len(model.hashes):
        return np.zeros(len(words))
    at = np.minimum(np.searchsorted(model.hashes, words), len(model.hashes) - 1)
    return np.where(model.hashes[at] == words, model.odds[at], 0.0)


def _stretches(score: np.ndarray, doc: np.ndarray, reach: int = REACH) -> list[tuple[int, int]]:
    """Token ranges within ``reach`` of a scored word, merged, none across documents."""
    hit = np.flatnonzero(score)
    if not len(hit):
        return []
    edge = np.concatenate(([0], np.flatnonzero(np.diff(doc)) + 1, [len(doc)]))
    own = np.searchsorted(edge, hit, "right") - 1
    lo, hi = np.maximum(hit - reach, edge[own]), np.minimum(hit + reach + 1, edge[own + 1])
    cut = np.flatnonzero((lo[1:] >= hi[:-1]) | (own[1:] != own[:-1])) + 1
    return list(zip(lo[np.concatenate(([0], cut))].tolist(), hi[np.concatenate((cut - 1, [len(hi) - 1]))].tolist()))


def _pad(spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Token indexes of stretches side by side (padded with the last token) and which are real."""
    a = np.array([s for s, _ in spans])
    n = np.array([e - s for s, e in spans])
    step = np.arange(n.max())
    return a[:, None] + np.minimum(step, n[:, None] - 1), step < n[:, None]


def _features(score: np.ndarray, doc: np.ndarray) -> np.ndarray:
    before, after = np.zeros_like(score), np.zeros_like(score)
    before[1:] = np.where(doc[1:] == doc[:-1], score[:-1], 0)
    after[:-1] = np.where(doc[1:] == doc[:-1], score[1:], 0)
    return np.stack([np.ones_like(score), score, before, after])


def forward_backward(emit: np.ndarray, real: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of state 1, expected transitions and log-likelihood base (sum of log Z).

    ``emit``: score of state 1 over state 0 for each chain (row) and token.
    """
    chains, n = emit.shape
    psi = np.exp(moves)
    e = np.ones((chains, n, 2))
    e[:, :, 1] = np.exp(np.clip(emit, -60, 60))
    f, b, scale = np.empty((chains, n, 2)), np.ones((chains, n, 2)), np.ones((chains, n))
    f[:, 0] = e[:, 0]
    for t in range(n):
        if t:
            f[:, t] = np.where(real[:, t, None], (f[:, t - 1] @ psi) * e[:, t], f[:, t - 1])
        scale[:, t] = f[:, t].sum(1)
        f[:, t] /= scale[:, t, None]
    for t in range(n - 2, -1, -1):
        back = (b[:, t + 1] * e[:, t + 1]) @ psi.T / scale[:, t + 1, None]
        b[:, t] = np.where(real[:, t + 1, None], back, 1.0)
    p = f * b
    p /= p.sum(2, keepdims=True)
    pair = np.zeros((2, 2))
    if n > 1:
        x = f[:, :-1, :, None] * psi * (e[:, 1:] * b[:, 1:])[:, :, None, :] / scale[:, 1:, None, None]
        pair = (x * real[:, 1:, None, None]).sum((0, 1))
    return p[:, :, 1] * real, pair, float(np.log(scale).sum())


def _batches(spans: list[tuple[int, int]], group: int = 512) -> Iterator[list[tuple[int, int]]]:
    """Stretches of like length together, and at most some ``SIDE`` tokens at once."""
    spans = sorted(spans, key=lambda s: s[1] - s[0])
    while spans:
        take = max(1, min(group, SIDE // (spans[-1][1] - spans[-1][0])))
        yield spans[-take:]
        spans = spans[:-take]


def marginals(model: Model, score: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Toxic marginal of every token near a weighed word; 0 elsewhere."""
    out = np.zeros(len(score))
    spans = _stretches(score, doc)
    emit = model.weights @ _features(score, doc) if spans else None
    for part in _batches(spans):
        at, real = _pad(part)
        p, _, _ = forward_backward(np.where(real, emit[at], 0), real, model.moves)
        out[at[real]] = p[real]
    return out


# ---------------------------------------------------------------- fitting

def fit_field(score: np.ndarray, mark: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Field weights and moves for which the marked tokens of the stretches are most likely.

    ``score`` holds the stretches one after the other, ``spans`` where each begins and ends."""
    own = np.repeat(np.arange(len(spans)), [b - a for a, b in spans])
    x = _features(score, own)
    target = x[:, mark].sum(1)
    pair = np.zeros((2, 2))
    parts = []
    for part in _batches(spans):
        at, real = _pad(part)
        y = mark[at] & real
        for i in (0, 1):
            for j in (0, 1):
                pair[i, j] += ((y[:, :-1] == i) & (y[:, 1:] == j) & real[:, 1:]).sum()
        parts.append((at, real))
    weights, moves = np.array([-2.0, 1.0, 0.0, 0.0]), np.zeros((2, 2))
    up, rate = np.full(8, 1e-8), 2.0
    for _ in range(ROUNDS):  # AdaGrad on the mean log-likelihood with a small L2 term
        emit = weights @ x
        has, moved = np.zeros(4), np.zeros((2, 2))
        for at, real in parts:
            p, got, _ = forward_backward(np.where(real, emit[at], 0), real, moves)
            has += x[:, at[real]] @ p[real]
            moved += got
        g = np.concatenate((has - target, (moved - pair).ravel())) / len(score)
        g += 1e-4 * np.concatenate((weights, moves.ravel()))
        up += g * g
        step = rate * g / np.sqrt(up) / 4
        weights, moves = weights - step[:4], moves - step[4:].reshape(2, 2)
    return weights, moves


def fit_logistic(f: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Newton steps of a ridge logistic regression on the documents' features."""
    w = np.zeros(1 + f.shape[1])
    z = np.column_stack([np.ones(len(toxic)), f])
    for _ in range(30):
        q = 1 / (1 + np.exp(-z @ w))
        h = (z * (q * (1 - q))[:, None]).T @ z + 1e-2 * np.eye(len(w))
        w = w - np.linalg.solve(h, z.T @ (q - toxic) + 1e-2 * w)
    return w


def _document_features(p: np.ndarray, doc: np.ndarray, rows: int) -> np.ndarray:
    total = np.bincount(doc, p, rows)
    most = np.zeros(rows)
    np.maximum.at(most, doc, p)
    return np.column_stack([np.log1p(total), most])


#: Min-hashes of a text's three-word shingles; texts that share one are near copies.
SIGNS = 4


def _signs(words: np.ndarray) -> np.ndarray:
    three = mix64(words[:-2] * np.uint64(3) + mix64(words[1:-1]) * np.uint64(5) + words[2:]) if len(words) > 2 else words[:0]
    return np.array([mix64(three ^ np.uint64(0x9E37 * (k + 1))).min() for k in range(SIGNS)] if len(three) else [], np.uint64)


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, toxic, words, signs) of labelled texts: hashes instead of text."""
    for batch in batches:
        for i, j, raw, offs in text_chunks(batch.column(2)):
            starts, ends, doc = word_spans(raw, offs, PARTS)
            words = span_hashes(raw, starts, ends)
            n = np.bincount(doc, minlength=j - i)
            signs = [_signs(w) for w in np.split(words, np.cumsum(n)[:-1])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), list_array(as_long(words), n, pa.int64()),
                 list_array(as_long(np.concatenate(signs)), np.array([len(x) for x in signs]), pa.int64())], ["doc_id", "toxic", "words", "signs"])


def _labelled(docs: DataFrame, labels: DataFrame, max_rows: int, max_chars: int) -> DataFrame:
    """Hashed texts of at most ``max_rows`` labelled documents of each class, stored."""
    marked = (labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    order = F.xxhash64("doc_id", F.lit("sample"))

    def first(df: DataFrame, n: int) -> DataFrame:
        return df.where("toxic = 1").orderBy(order, "doc_id").limit(n).unionByName(df.where("toxic = 0").orderBy(order, "doc_id").limit(n))

    # twice the rows, since labelled ids may lack a text or have a long one
    ids = store(first(marked, 2 * max_rows), "labelled")
    text = docs.where(F.length("text") <= max_chars).select("doc_id", "text")
    known = keep_ids(text, ids.select("doc_id"), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).join(ids, "doc_id")
    kind = docs.schema["doc_id"].dataType.simpleString()
    hashed = store(known.select("doc_id", "toxic", "text").mapInArrow(_word_rows, f"doc_id {kind}, toxic int, words array<long>, signs array<long>"), "hashed")
    return store(keep_ids(hashed, store(first(hashed.select("doc_id", "toxic"), max_rows).select("doc_id"), "chosen"), "doc_id"), "training")


def _trust(surprise, words: int):
    """Probability that a word of this likelihood ratio (G squared) tells classes apart, one of ``words`` being expected to by chance."""
    return 1 / (1 + F.exp(F.least(F.lit(700.0), F.lit(float(np.log(max(words, 1)))) - surprise / 2)))


def _weigh(rows: DataFrame) -> list[tuple[int, float, float]]:
    """(word, weight, trust) of the words that have weight, from the training documents."""
    sums = rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()
    n = {r["toxic"]: r["n"] for r in sums}
    # near copies would lend their words weight, so toxic texts count once for each group of them
    signs = rows.where("toxic = 1").select("doc_id", F.posexplode("signs").alias("k", "sign"))
    first = signs.groupBy("k", "sign").agg(F.min("doc_id").alias("first"))
    copies = signs.join(first, ["k", "sign"]).where("doc_id > first").select("doc_id").distinct()
    single = rows.join(copies.withColumn("copy", F.lit(True)), "doc_id", "left").select("doc_id", "toxic", "words", F.col("copy").isNull().alias("single"))
    pairs = store(single.select("doc_id", "toxic", "single", F.explode(F.array_distinct("words")).alias("word")), "words")
    na = single.where("toxic = 1 and single").count()
    nb = n.get(0, 0)
    counts = store(pairs.groupBy("word").agg(F.count_if((F.col("toxic") == 1) & F.col("single")).alias("a"), F.count_if(F.col("toxic") == 0).alias("b"),
                                             F.count_if(F.col("toxic") == 1).alias("all")), "counts")
    words = counts.count()
    a, b = F.col("a"), F.col("b")

    def part(x, of):  # of G squared: counts against one common rate
        return F.when(x > 0, x * F.log(x * (na + nb) / ((a + b) * of))).otherwise(0.0)

    odds = F.log((a + .5) / (na + 1.0)) - F.log((b + .5) / (nb + 1.0))
    trust = _trust(2 * (part(a, na) + part(b, nb)), words)
    found = {r["word"]: (r["odds"] * r["trust"], r["trust"]) for r in counts.where(a > 0).select("word", odds.alias("odds"), trust.alias("trust"))
             .where(F.col("odds") * F.col("trust") >= SCORED).collect()}
    # toxic texts without a trusted word (often copies of a few): the commonest word that no clean text has
    only = store(pairs.where("toxic = 1").join(counts.where("b = 0 and `all` > 1").select("word"), "word", "left_semi").select("doc_id", "word"), "only-toxic")
    spark = rows.sparkSession
    while True:
        # of bounded training rows; as an Arrow table it needs no Python workers
        known = spark.createDataFrame(pa.table({"word": pa.array([w for w, (_, t) in found.items() if t >= .5], pa.int64())}))
        served = pairs.where("toxic = 1").join(F.broadcast(known), "word", "left_semi").select("doc_id").distinct()
        top = (only.join(served, "doc_id", "left_anti").groupBy("word").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "word").limit(1)
               .select("word", _trust(2 * F.col("n") * np.log((n.get(1, 0) + nb) / max(n.get(1, 0), 1)), words).alias("trust")).collect())
        if not top or top[0]["trust"] < .5:
            break
        found[top[0]["word"]] = (max(found.get(top[0]["word"], (0.0, 0.0))[0], MARK), top[0]["trust"])
    return [(w, x, t) for w, (x, t) in found.items()]


def _stretch_rows(model: Model, marked: np.ndarray):
    """Weights and marks along the stretches of training documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for toxic, words in zip(batch.column(0).to_pylist(), batch.column(1)):
                w = words.values.to_numpy(zero_copy_only=False).view(np.uint64)
                score = _scores(model, w)
                spans = _stretches(score, np.zeros(len(w), np.int64))
                if spans:
                    at = np.concatenate([np.arange(a, b) for a, b in spans])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([score[at].tolist()], pa.list_(pa.float64())), pa.array([(np.isin(w[at], marked) & (toxic == 1)).tolist()], pa.list_(pa.bool_())),
                         pa.array([[b - a for a, b in spans]], pa.list_(pa.int64()))], ["score", "mark", "lengths"])
    return run


def _feature_rows(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offs = column_lists(batch.column(1))
            doc = np.repeat(np.arange(batch.num_rows), np.diff(offs))
            f = _document_features(marginals(model, _scores(model, flat.astype(np.int64).view(np.uint64)), doc), doc, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f[:, 0]), pa.array(f[:, 1])], ["toxic", "total", "most"])
    return run


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN, max_chars: int = MAX_TRAIN_CHARS) -> Model:
    """Fit on at most ``max_rows`` labelled documents of each class."""
    ship_package(docs.sparkSession)
    bound_batches(docs.sparkSession)
    rows = _labelled(docs, labels, max_rows, max_chars)
    model = Model()
    if rows.select("toxic").distinct().count() < 2:
        return model
    words = sorted((np.int64(w).view(np.uint64), x, t) for w, x, t in _weigh(rows))
    model.hashes, model.odds = np.array([w for w, _, _ in words], np.uint64), np.array([x for _, x, _ in words])
    trust = np.array([t for _, _, t in words])
    if len(words):
        marked = model.hashes[trust >= min(.5, trust.max())]
        t = rows.select("toxic", "words").mapInArrow(_stretch_rows(model, marked), "score array<double>, mark array<boolean>, lengths array<long>").toArrow()
        score, mark, lengths = (t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("score", "mark", "lengths"))
        ends = np.cumsum(lengths)
        model.weights, model.moves = fit_field(score, mark.astype(bool), list(zip((ends - lengths).tolist(), ends.tolist())))
    t = rows.select("toxic", "words").mapInArrow(_feature_rows(model), "toxic int, total double, most double").toArrow()
    order = np.lexsort([t[c].to_numpy() for c in ("most", "total", "toxic")])  # sums in one order, whatever that of the rows
    f = np.column_stack([t["total"].to_numpy(), t["most"].to_numpy()])[order]
    model.logistic, model.fitted = fit_logistic(f, t["toxic"].to_numpy()[order]), True
    return model


# ---------------------------------------------------------------- scoring

def _char_spans(raw: np.ndarray, begin: int, starts: np.ndarray, ends: np.ndarray) -> list[dict]:
    """Spans of one text, from byte to character offsets."""
    if not len(starts):
        return []
    lead = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    a, b = lead[starts - begin], lead[ends - begin]
    return [{"start": int(x), "end": int(y)} for x, y in zip(a, b)]


def _hashes(raw: np.ndarray, offs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``span_hashes``, a few texts at a time."""
    out = []
    for i, j in row_chunks(offs):
        a, b = np.searchsorted(starts, offs[[i, j]])
        out.append(span_hashes(raw[offs[i]:offs[j]], starts[a:b] - offs[i], ends[a:b] - offs[i]))
    return np.concatenate(out)


def _score_rows(model: Model, threshold: float = 0.5):
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for i, j, raw, offs in text_chunks(batch.column(names.index("text")), SCORE_BYTES):
                starts, ends, doc = word_spans(raw, offs, PARTS)
                p = marginals(model, _scores(model, _hashes(raw, offs, starts, ends)), doc)
                f = _document_features(p, doc, j - i)
                if model.fitted:
                    score = 1 / (1 + np.exp(-np.clip(model.logistic[0] + f @ model.logistic[1:], -700, 700)))
                else:
                    score = np.zeros(j - i)
                found: list[list[dict]] = [[] for _ in range(j - i)]
                hit = np.flatnonzero(p >= threshold)
                if len(hit):
                    # neighbouring toxic tokens of a text make one span
                    new = np.ones(len(hit), bool)
                    new[1:] = (np.diff(hit) > 1) | (np.diff(doc[hit]) > 0)
                    first = hit[new]
                    last = hit[np.append(np.flatnonzero(new)[1:] - 1, len(hit) - 1)]
                    for r in np.unique(doc[first]).tolist():
                        own = doc[first] == r
                        found[r] = _char_spans(raw[offs[r]:offs[r + 1]], offs[r], starts[first[own]], ends[last[own]])
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(i, j - i) for c in batch.columns), pa.array(score), pa.array(found, spans_type)],
                    [*names, "score", "spans"])
    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``spans`` (start and end character of each toxic span)."""
    ship_package(docs.sparkSession)
    bound_batches(docs.sparkSession)
    from pyspark.sql import types as T

    docs = docs.drop("score", "spans")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField(
        "spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])
    return docs.mapInArrow(_score_rows(model), schema)
