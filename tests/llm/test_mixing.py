"""Mixing to target weights against a plain loop."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from shiftcast.llm import mixing as M

SCHEMA = "doc_id long, source string, text string, words string, part int"


def _docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def _want(rows, weights=(1, 2, 3), repeats=3):
    """{source: target} by sharing the excess again and again."""
    size = {}
    for _, s, t in rows:
        size[s] = size.get(s, 0) + len(re.findall(M.WORD, t or ""))
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total = sum(size.values())
    target = {s: total * w[s] / sum(w.values()) for s in names}
    capped = set()
    while True:
        over = [s for s in names if target[s] > repeats * size[s] + 1e-9]
        if not over:
            return size, target
        excess = sum(target[s] - repeats * size[s] for s in over)
        for s in over:
            target[s] = repeats * size[s]
            capped.add(s)
        open_ = [s for s in names if s not in capped]
        for s in open_:
            target[s] += excess * w[s] / sum(w[x] for x in open_)


def test_targets_and_cuts(spark):
    rows = [(i, f"s{i % 5}" if i % 5 else None, " ".join(["w"] * (i * 7 % 40))) for i in range(200)]
    rows += [(1000, "tiny", "a b c"), (1001, "", "one\ttwo\x0bthree"), (None, "s1", "no id"), (1002, "s2", None), (1003, "é", "é è")]
    rows += [(7, "s1", "the same row twice")] * 2
    got = M.plan_mix(_docs(spark, rows)).collect()
    assert len(got) == len(rows)
    size, target = _want(rows)
    for s in size:
        mine = [r for r in got if r.source == s]
        assert all(r.source_size == size[s] for r in mine)
        assert mine[0].target == pytest.approx(target[s])
        budget = int(mine[0].target + 1e-9)
        assert sum(r.taken for r in mine) == budget
        # by hand: whole passes, then documents in the order of their hashes
        passes, rest = divmod(budget, size[s]) if size[s] else (0, 0)
        for r in sorted(mine, key=lambda r: (r.key, r.taken != 0, -r.taken)):
            cut = min(r.size, rest)
            rest -= cut
            assert r.taken == passes * r.size + cut <= 3 * r.size
    key = next(r.key for r in got if r.doc_id == 1000)
    assert key == hashlib.md5(b"42/1000/a b c").hexdigest()


def test_mixed_texts(spark):
    rows = [(i, "ab"[i % 2], f"d{i} " + "x " * (i % 9)) for i in range(60)] + [(90, "c", "lone words here")] * 3
    docs = _docs(spark, rows)
    plan = {(r.doc_id, r.key): r for r in M.plan_mix(docs, weights=(1, 5, 2)).collect()}
    out = M.mix(docs, weights=(1, 5, 2)).collect()
    assert all(r.words == len(re.findall(M.WORD, r.text)) for r in out)
    taken = {}
    for r in out:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.words
    for r in plan.values():
        if r.doc_id != 90:
            assert taken.get(r.doc_id, 0) == r.taken
    texts = {d: t for d, _, t in rows}
    for r in out:
        assert r.text == texts[r.doc_id] or texts[r.doc_id].split()[:r.words] == r.text.split()


def test_reruns_agree_and_a_budget_of_words(spark):
    rows = [(i, f"s{i % 3}", "w " * (i % 50)) for i in range(300)]
    docs = _docs(spark, rows)
    one = {(r.doc_id, r.taken) for r in M.plan_mix(docs, words=1000).collect()}
    two = {(r.doc_id, r.taken) for r in M.plan_mix(docs.repartition(7), words=1000).collect()}
    assert one == two
    assert 1000 - 3 < sum(t for _, t in one) <= 1000
    most = M.plan_mix(docs, words=10**9).agg(F.sum("taken"), F.sum("size")).first()
    assert most[0] == 3 * most[1]


@pytest.mark.parametrize("rows", [[], [(1, "a", None), (2, None, "")]])
def test_without_words(spark, rows):
    got = M.plan_mix(_docs(spark, rows)).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * len(rows)
    assert M.mix(_docs(spark, rows)).count() == 0


def test_hot_source_keeps_every_row(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 17)).alias("source"),
                                      F.expr("repeat('w ', cast(id % 11 as int))").alias("text"))
    got = M.plan_mix(docs)
    per = got.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("target")).collect()
    assert got.count() == 30_000 and all(r.t == int(r.target) for r in per)
