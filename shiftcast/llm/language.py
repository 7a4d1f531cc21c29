"""Language identification by Bayesian fusion of four kinds of evidence.

* Text: multinomial likelihoods of hashed byte trigrams, learned from labelled
  texts.  Trigrams of a text depend on each other, so a text's evidence weighs as
  that of ``WEIGHT`` of them at most (its mean over all of them, not a prefix).
* Markup: P(declared language | language).
* Address: P(suffix | language).
* Host: P(language | host), smoothed towards its domain's and that towards all
  records'; ``KAPPA`` is the weight of the level above.

Given the language the four count as independent.  A record's own share is taken
out of the counts at every level, so its text is not counted twice.

The tables for markup, address and host are grouped sums of the text posteriors
of all records, with map-side combining, so a host with a third of all records is
one row per map task; they are joined back by their keys (broadcast below a
checked number of rows).

The classifier alone is fitted on a bounded sample: at most ``MAX_TRAIN`` labelled
texts of a language, those with the smallest hash, of at most ``MAX_TRAIN_CHARS`` characters.

Defined results: empty and null texts, and texts without letters, are judged by
the other evidence; missing evidence is neutral; ties go to the first language
in alphabetical order; without any labelled text language and probability are
null.  Repeated rows are judged each for itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftcast.llm.common import BROADCAST_IDS, list_array, ship_package, store, text_chunks

MAX_TRAIN = 1500
MAX_TRAIN_CHARS = 40_000
BUCKETS = 1 << 16
WEIGHT = 60.0
KAPPA = 10.0
ALPHA = 0.5
#: Bytes of text that are counted or summed in one step.
STEP_BYTES = 2_000_000

#: Bytes as a trigram sees them: letters in lower case, other ASCII as blanks.
_FOLD = np.array([b | 0x20 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0x20 for b in range(256)], np.uint32)


def _trigrams(raw: np.ndarray) -> np.ndarray:
    """Bucket of the trigram at each byte but the last two."""
    b = _FOLD[raw]
    x = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return (x * np.uint32(0x9E3779B1)) >> np.uint32(16)


def _sums(table: np.ndarray, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the table's rows over each text's trigrams, and their number."""
    n = np.maximum(np.diff(offs) - 2, 0)
    out = np.zeros((len(n), table.shape[1]))
    if len(raw) > 2 and n.any():
        value = table[_trigrams(raw)]
        run = np.zeros((len(value) + 1, table.shape[1]))
        np.cumsum(value, axis=0, out=run[1:])
        a = np.minimum(offs[:-1], len(value))
        out = run[a + np.where(a + n <= len(value), n, 0)] - run[a]
    return out, n


@dataclass
class Model:
    languages: list[str]
    logp: np.ndarray    # trigram bucket x language
    prior: np.ndarray


def fit(texts: pa.Array, langs: list[str]) -> Model:
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    counts = np.zeros((len(names), BUCKETS))
    at = np.array([names.index(x) for x in langs])
    for i, j, raw, offs in text_chunks(texts, STEP_BYTES):
        if len(raw) < 3:
            continue
        t = _trigrams(raw)
        row = np.searchsorted(offs, np.arange(len(t)), "right") - 1
        inside = np.arange(len(t)) + 2 < offs[row + 1]
        counts += np.bincount(at[i + row[inside]] * BUCKETS + t[inside], minlength=counts.size).reshape(counts.shape)
    logp = np.log(counts + ALPHA) - np.log(counts.sum(1, keepdims=True) + ALPHA * BUCKETS)
    return Model(names, np.ascontiguousarray(logp.T), np.bincount(at, minlength=len(names)) / len(at))


def train(labelled: DataFrame, max_rows: int = MAX_TRAIN, max_chars: int = MAX_TRAIN_CHARS) -> Model:
    """Fit on at most ``max_rows`` rows of each language of ``labelled(text, lang)``."""
    usable = labelled.where((F.length("text") > 2) & (F.length("text") <= max_chars) & (F.trim("lang") != "")).select(
        F.lower(F.trim("lang")).alias("lang"), "text")
    parts = []
    for r in usable.select("lang").distinct().orderBy("lang").collect():  # one row a language
        parts.append(usable.where(F.col("lang") == r["lang"]).orderBy(F.xxhash64("text", F.lit("sample")), "text").limit(max_rows).toArrow())
    if not parts:
        return fit(pa.array([], pa.string()), [])
    t = pa.concat_tables(parts)
    return fit(t["text"].combine_chunks(), t["lang"].to_pylist())


# ---------------------------------------------------------------- records

_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-zA-Z]+)|<meta\b[^>]*?content-language[^>]*?content\s*=\s*[\"']?\s*([a-zA-Z]+)", re.I)


def _page_text(page: str | None) -> tuple[str, str | None]:
    """Article text and declared language of a page."""
    from shiftcast.llm import wrappers as W

    m = _LANG.search(page or "")
    return W.extract(page, None), (m[1] or m[2]).lower() if m else None


def _page_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 200):
            part = batch.slice(k, 200)
            got = [_page_text(x) for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([t for t, _ in got], pa.string()),
                                              pa.array([d for _, d in got], pa.string())], ["id", "host", "text", "declared"])


def page_records(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` as records (kind, id, text, host, domain, suffix, declared)."""
    ship_package(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    rows = pages.select(F.col("page_id").alias("id"), F.when(host != "", host).alias("host"), "html")
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = rows.mapInArrow(_page_rows, f"id {kind}, host string, text string, declared string")
    return rows.select(F.lit("page").alias("kind"), "id", "text", "host",
                       F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("domain"),
                       F.regexp_extract("host", r"([^.]+)$", 1).alias("suffix"), "declared")


def document_records(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, source)`` as records; the source stands for the host, and there is no address or markup."""
    no = F.lit(None).cast("string")
    return docs.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text", F.col("source").alias("host"),
                       no.alias("domain"), no.alias("suffix"), no.alias("declared"))


# ---------------------------------------------------------------- fusion

def _likelihoods(shared, place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            kept = [c for c in batch.schema.names if c != "text"]
            for i, j, raw, offs in text_chunks(batch.column(place), STEP_BYTES):
                sums, n = _sums(model.logp, raw, offs)
                ll = sums * np.minimum(1.0, WEIGHT / np.maximum(n, 1))[:, None]
                post = np.exp(ll - ll.max(1, keepdims=True)) * model.prior
                post /= post.sum(1, keepdims=True)
                post[n == 0] = 0  # nothing to count
                size = np.full(j - i, len(model.languages))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(i, j - i) for c in kept), list_array(ll.ravel(), size, pa.float64()), list_array(post.ravel(), size, pa.float64())],
                    [*kept, "ll", "post"])
    return run


def _grouped(rows: DataFrame, key: str, n: int) -> DataFrame:
    """(key, array of the sums of the text posteriors)."""
    out = store(rows.where(F.col(key).isNotNull()).groupBy(key)
                .agg(*[F.sum(F.col("post")[i]).alias(f"s{i}") for i in range(n)])
                .select(key, F.array(*[f"s{i}" for i in range(n)]).alias(f"{key}_sum")), f"sum-{key}")
    return F.broadcast(out) if out.count() <= BROADCAST_IDS // 10 else out


def identify(records: DataFrame, model: Model) -> DataFrame:
    """``records`` without ``text``, with lang, probability, text_lang (by the text alone, null if it has no trigram)."""
    spark = records.sparkSession
    ship_package(spark)
    names = [c for c in records.columns if c != "text"]
    n = len(model.languages)
    none = F.lit(None)
    if not n:
        return records.select(*names, none.cast("string").alias("lang"), none.cast("double").alias("probability"), none.cast("string").alias("text_lang"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema.fields if f.name != "text"),
                        "ll array<double>", "post array<double>"])
    rows = store(records.mapInArrow(_likelihoods(spark.sparkContext.broadcast(model), records.columns.index("text")), schema), "evidence")
    total = rows.agg(*[F.coalesce(F.sum(F.col("post")[i]), F.lit(0.0)) for i in range(n)]).first()
    for key in ("declared", "suffix", "domain", "host"):
        rows = rows.join(_grouped(rows.select(key, "post"), key, n), key, "left")

    def total_of(a):
        return F.aggregate(a, F.lit(0.0), lambda t, x: t + x)

    def smoothed(key, above):  # unnormalised P(language | key): sums of the other records and KAPPA of the level above
        others = F.zip_with(f"{key}_sum", "post", lambda t, p: F.greatest(t - p, F.lit(0.0)))
        return F.coalesce(F.zip_with(others, above, lambda t, p: t + KAPPA * p), F.col(above))

    def normalised(df, name, weights):
        df = df.withColumn(name, weights).withColumn("_t", total_of(name))
        return df.withColumn(name, F.transform(name, lambda x: x / F.col("_t")))

    everything = F.array(*[F.lit(float(x)) for x in total])
    rows = normalised(rows, "p_all", F.zip_with(everything, "post", lambda t, p: F.greatest(t - p, F.lit(0.0)) + ALPHA))
    rows = normalised(rows, "p_domain", smoothed("domain", "p_all"))
    rows = normalised(rows, "p_host", smoothed("host", "p_domain"))
    evidence = F.zip_with("ll", "p_host", lambda a, p: a + F.log(p))
    for key in ("declared", "suffix"):
        # P(key | language) is P(language | key) / P(language), but for a factor that all languages share
        rows = normalised(rows, f"p_{key}", smoothed(key, "p_all"))
        evidence = F.zip_with(evidence, F.zip_with(f"p_{key}", "p_all", lambda p, q: F.log(p / q)), lambda a, b: a + b)
    rows = rows.withColumn("_s", evidence).withColumn("_m", F.array_max("_s"))
    rows = rows.withColumn("_t", total_of(F.transform("_s", lambda x: F.exp(x - F.col("_m")))))
    langs = F.array(*[F.lit(x) for x in model.languages])
    return rows.select(*names, F.element_at(langs, F.array_position("_s", F.col("_m")).cast("int")).alias("lang"),
                       (1 / F.col("_t")).alias("probability"),
                       F.when(F.array_max("post") > 0, F.element_at(langs, F.array_position("post", F.array_max("post")).cast("int"))).alias("text_lang"))
