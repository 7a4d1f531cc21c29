"""Hard negatives against comparing every pair."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftcast.llm import negatives as N

SCHEMA = "vec_id long, embedding array<double>, label int, score string, place long"


def _table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def _plain(rows, every, positives=5, negatives=3):
    good = {}
    for i, e, y in rows:
        if i is None or y is None or e is None or any(x is None or not np.isfinite(x) for x in e):
            continue
        good[i] = min(good.get(i, (y, e)), (y, e))
    q = {i: (y, [int(np.floor(x * 256)) if abs(x) < 1e300 else int(x) * 256 for x in e]) for i, (y, e) in good.items()}
    clip = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    out = []
    for a, (y, e) in q.items():
        if a % every:
            continue
        s = [(-clip(sum(u * v for u, v in zip(e, f))), b, z) for b, (z, f) in q.items() if b != a and len(f) == len(e)]
        for ps, p, _ in sorted(x for x in s if x[2] == y)[:positives]:
            fits = sorted(x for x in s if x[2] != y and -50 * ps <= -100 * x[0] <= -95 * ps)[:negatives]
            out += [(a, p, k, n, -ps, -ns) for k, (ns, n, _) in enumerate(fits, 1)]
    return sorted(out)


def _random(rng, n, dim, labels=4, copies=0):
    centre = rng.normal(size=(6, dim))
    x = centre[rng.integers(0, 6, n)] + rng.normal(size=(n, dim)) * 0.7
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if copies:
        x[:copies] = x[0]
    return [(i, [float(v) for v in row], int(rng.integers(0, labels))) for i, row in enumerate(x)]


@pytest.mark.parametrize("block,values,seed", [(512, 1_500_000, 0), (16, 60, 1)])
def test_equals_all_pairs(spark, monkeypatch, block, values, seed):
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "ROUND_VALUES", values)
    rng = np.random.default_rng(seed)
    rows = _random(rng, 150, 8, copies=30)
    rows += [(1000, [0.1] * 3, 1), (1010, [0.2] * 3, 1), (1020, [0.1] * 3, 2), (1001, None, 1), (1002, [None] * 8, 1), (1003, [float("nan")] * 8, 2),
             (1004, [float("inf")] * 8, 1), (None, [0.3] * 8, 1), (1005, [0.3] * 8, None), (1030, [], 1), (1040, [], 1), (1041, [], 2)]
    rows += [(0, rows[0][1], rows[0][2]), (20, [0.5] * 8, 3), (20, [0.25] * 8, 3)]
    got = N.mine(_table(spark, rows), F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = _plain(rows, 10)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 50


def test_large_numbers(spark):
    rng = np.random.default_rng(3)
    for scale in (1e6, 1e30):  # 64-bit sums, and beyond
        rows = [(i, [float(v) for v in rng.normal(size=4) * scale], int(rng.integers(0, 2))) for i in range(40)]
        got = N.mine(_table(spark, rows), F.col("vec_id") % 5 == 0)
        assert sorted(tuple(r) for r in got.collect()) == _plain(rows, 5)


def test_no_anchor(spark):
    for rows in ([], [(1, [0.5], 1), (10, None, 1)]):
        assert N.mine(_table(spark, rows), F.col("vec_id") % 10 == 0).count() == 0
    assert N.mine(_table(spark, [(10, [0.5], 1), (20, [0.5], 2)]), F.col("vec_id") % 10 == 0).count() == 0


def test_hilbert_curve_is_one_walk():
    for dims, bits in ((2, 3), (3, 2), (1, 4)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        at = N.hilbert_index(cells, bits)
        assert sorted(at.tolist()) == list(range(len(cells)))
        walk = cells[np.argsort(at)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_bounds_hold_and_skip_blocks():
    rng = np.random.default_rng(5)
    a = np.floor(rng.normal(size=(20, 6)) * 100)
    v = np.floor(rng.normal(size=(30, 6)) * 20 + 100)
    one = np.zeros((20, 1), np.int64)
    r = N.Round(np.arange(20), np.zeros(20, np.int64), a, one, one, True, 5)
    low, up = r.bounds(v.min(0)[None], v.max(0)[None])
    s = N.scores(a, v)
    assert (low <= s.min(1, keepdims=True)).all() and (up >= s.max(1, keepdims=True)).all()
    wants = lambda least, most, labels: r.__class__(r.ids, r.labels, a, one + least, one + most, True, 5).wants(
        np.array([labels[0]]), np.array([labels[1]]), v.min(0)[None], v.max(0)[None], one + least)
    top = int(s.max()) + 100_000
    assert not wants(top, top + 1, (0, 0)).any() and not wants(-top, top, (1, 2)).any() and wants(-top, top, (0, 3)).all()
