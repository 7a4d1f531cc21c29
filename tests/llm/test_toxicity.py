import itertools
import random

import numpy as np

from shiftcast.llm import toxicity as X


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    emit, moves = rng.normal(size=(3, 5)), rng.normal(size=(2, 2))
    real = np.arange(5) < np.array([5, 3, 1])[:, None]
    p, pair, logz = X.forward_backward(np.where(real, emit, 0), real, moves)
    want_pair, want_z = np.zeros((2, 2)), 0.0
    for c in range(3):
        n = int(real[c].sum())
        weight = {y: np.exp(sum(emit[c, t] * y[t] for t in range(n)) + sum(moves[y[t], y[t + 1]] for t in range(n - 1)))
                  for y in itertools.product((0, 1), repeat=n)}
        z = sum(weight.values())
        want_z += np.log(z)
        for t in range(n):
            assert np.isclose(p[c, t], sum(w for y, w in weight.items() if y[t]) / z)
        for y, w in weight.items():
            for t in range(n - 1):
                want_pair[y[t], y[t + 1]] += w / z
    assert np.allclose(pair, want_pair) and np.isclose(logz, want_z)


def _corpus(n=400, seed=2):
    rng = random.Random(seed)
    bad = ["vile", "rotten", "foul"]
    rows = []
    for i in range(n):
        w = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(5, 200))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randrange(1, 5)):
                w.insert(rng.randrange(len(w)), rng.choice(bad).upper() + rng.choice(["", "!", ","]))
        rows.append((i, "\n".join(w) if i % 3 else " é ".join(w), int(toxic)))
    return rows


def test_learns_and_finds_spans(spark):
    rows = _corpus()
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + [(900, None, "s"), (901, "", "s"), (902, "VILE " * 30000, "s")],
                                 "doc_id long, text string, toxic string").repartition(5)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 300] + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = X.train(docs, labels)
    got = {r.doc_id: r for r in X.score(docs, model).collect()}
    assert got[902].score >= .5 and got[900].score < .5 and got[901].score < .5 and got[900].toxic == "s"
    held = [(i, t, y) for i, t, y in rows if i >= 300]
    assert np.mean([(got[i].score >= .5) == y for i, _, y in held]) == 1
    for i, t, y in held:
        words = {t[s.start:s.end] for s in got[i].spans}
        assert all(any(b in w for b in ("VILE", "ROTTEN", "FOUL")) for w in words) and bool(words) == bool(y)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = X.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.score for r in X.score(docs, model).collect()] == [0.0]
    assert X.score(docs.where("false"), model).count() == 0


def test_one_class_only(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 3), (2, "b c", "s", 4)], "doc_id long, text string, score string, spans int")
    model = X.train(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int"))
    out = X.score(docs, model)
    assert not model.fitted and [r.score for r in out.collect()] == [0.0, 0.0] and out.columns == ["doc_id", "text", "score", "spans"]


def test_few_labels_give_weak_scores(spark):
    rows = _corpus(60, 5)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 30], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in X.score(docs, X.train(docs, labels)).collect()}
    assert all(0 < s < 1 for s in got.values())
    held = [(got[i], y) for i, _, y in rows if i >= 30]
    assert np.mean([s for s, y in held if y]) > np.mean([s for s, y in held if not y])
    two = X.train(docs, labels.where("doc_id in (0, 1)"))
    assert two.fitted and all(0 < r.score < 1 for r in X.score(docs, two).collect())


def test_field_marks_the_weighed_words():
    score = np.array([0, 0, 3.0, 0, 0, 0, 2.0, 0, 0, 0.5, 0, 0])
    weights, moves = X.fit_field(score, score >= 2, [(0, 5), (5, 12)])
    model = X.Model(weights=weights, moves=moves)
    p = X.marginals(model, score, np.repeat([0, 1], [5, 7]))
    assert ((p >= .5) == (score >= 2)).all()
