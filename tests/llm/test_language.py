import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from shiftcast.llm import language as L

SYLLABLES = {"aa": ["ka", "to", "mi"], "bb": ["ein", "sch", "ung"], "cc": ["é", "que", "oi"]}


def _say(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(n))


def test_sums_equal_a_loop():
    table = np.random.default_rng(0).normal(size=(L.BUCKETS, 2))
    texts = ["", "ab", "abc", "xyz and é", None, "q" * 500, ""]
    for i, j, raw, offs in L.text_chunks(pa.array(texts)):
        sums, n = L._sums(table, raw, offs)
        for k, t in enumerate(texts):
            b = np.frombuffer((t or "").encode(), np.uint8)
            want = table[L._trigrams(b)].sum(0) if len(b) > 2 else np.zeros(2)
            assert np.allclose(sums[k], want) and n[k] == max(len(b) - 2, 0)


def test_evidence_is_fused(spark):
    rng = random.Random(9)
    docs = [(i, _say(rng, lang, rng.randrange(3, 60)), lang) for i, lang in enumerate(rng.choices(list(SYLLABLES), k=300))]
    labelled = spark.createDataFrame(docs + [(900, None, "aa"), (901, "x", None), (902, "ka to", "")], "doc_id long, text string, lang string")
    model = L.train(labelled)
    assert model.languages == ["aa", "bb", "cc"]
    pages, truth = [], {}
    for i in range(240):
        lang = rng.choice(list(SYLLABLES))
        shown = lang if rng.random() < .9 else rng.choice(list(SYLLABLES))
        text = _say(rng, lang, 30) if i < 200 else ""  # the last have no text
        host = f"www.{lang}{rng.randrange(3)}.example.{ {'aa': 'x', 'bb': 'y', 'cc': 'z'}[lang]}"
        pages.append((i, f"https://{host}/p{i}", f'<html lang="{shown}"><body><article><p>{text}</p></article></body></html>'))
        truth[i] = lang
    pages += [(800, None, None), (801, "", "<html lang=bb></html>"), (802, "http://new.example.z/", "")]
    records = L.page_records(spark.createDataFrame(pages, "page_id long, url string, html string")).unionByName(
        L.document_records(labelled.withColumn("source", F.lit("s"))))
    out = L.identify(records.repartition(4), model).collect()
    assert len(out) == len(pages) + 303
    got = {r.id: r for r in out if r.kind == "page"}
    assert np.mean([got[i].lang == t for i, t in truth.items()]) == 1.0
    assert got[801].lang == "bb" and got[802].lang == "cc" and got[800].text_lang is None
    assert all(0 < r.probability <= 1 for r in out)
    docs_got = {r.id: r.lang for r in out if r.kind == "document"}
    assert np.mean([docs_got[i] == lang for i, _, lang in docs]) > .98


def test_without_labels_or_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.b/", "<p>x")], "page_id long, url string, html string")
    model = L.train(spark.createDataFrame([], "text string, lang string"))
    assert [(r.lang, r.probability) for r in L.identify(L.page_records(pages), model).collect()] == [(None, None)]
    model = L.train(spark.createDataFrame([("abc abc", "aa"), ("xyz", "bb")], "text string, lang string"))
    assert L.identify(L.page_records(pages.where("false")), model).count() == 0
