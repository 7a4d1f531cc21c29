"""Quantiles of all earlier rows against numpy."""

import datetime as dt

import numpy as np
import pytest

from shiftcast.operators.asof import asof_quantiles


@pytest.mark.parametrize("block", [1, 7, 64])
def test_equal_to_numpy(spark, block):
    rng = np.random.default_rng(block)
    rows = [(k, dt.date(2024, 1, 1) + dt.timedelta(days=int(d)), None if rng.random() < 0.15 else float(rng.integers(0, 30)) / 2, "x")
            for k in "ab" for d in rng.choice(400, 150, replace=False)]
    df = spark.createDataFrame(rows, "k string, date date, v double, other string").repartition(4)
    qs = (0.0, 0.25, 0.65, 0.88, 1.0)
    out = asof_quantiles(df, ["k"], "date", "v", qs, "q", "n", block)
    assert out.columns == ["k", "date", "v", "other", "q", "n"]
    got = {(r.k, r.date): r for r in out.collect()}
    assert len(got) == len(rows)
    for k, d, _, _ in rows:
        past = [v for kk, dd, v, _ in rows if kk == k and dd < d and v is not None]
        assert got[k, d].n == len(past)
        assert (got[k, d].q is None) == (not past)
        if past:
            assert np.allclose(got[k, d].q, np.quantile(past, qs), atol=1e-12)
    assert "percentile" not in out._jdf.queryExecution().executedPlan().toString()
