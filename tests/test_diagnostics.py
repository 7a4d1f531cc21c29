import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from shiftcast.operators import diagnostics as D

T0 = dt.datetime(2024, 1, 1)


def _series(spark, vals, key="a"):
    return spark.createDataFrame([(key, T0 + dt.timedelta(hours=i), float(v)) for i, v in enumerate(vals)],
                                 "k string, timestamp_hour timestamp_ntz, y double")


def _np_acf(x, nlags):
    x = np.asarray(x, float) - np.mean(x)
    d = np.sum(x * x)
    return np.array([np.sum(x[k:] * x[:len(x) - k]) / d for k in range(nlags + 1)])


def test_acf_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = np.sin(np.arange(300) / 4) * 5 + rng.normal(size=300)
    got = D.acf(_series(spark, x), "y", ["k"], nlags=30).orderBy("lag").toPandas()["acf"].to_numpy()
    assert np.allclose(got, _np_acf(x, 30), atol=1e-10)


def test_pacf_matches_yule_walker(spark):
    rng = np.random.default_rng(2)
    e = rng.normal(size=500)
    x = np.zeros(500)
    for t in range(2, 500):
        x[t] = 0.6 * x[t - 1] - 0.3 * x[t - 2] + e[t]
    got = D.pacf(_series(spark, x), "y", ["k"], nlags=6).orderBy("lag").toPandas()["pacf"].to_numpy()
    r = _np_acf(x, 6)
    exp = [1.0]
    for k in range(1, 7):
        R = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        exp.append(np.linalg.solve(R, r[1:k + 1])[-1])
    assert np.allclose(got, exp, atol=1e-9)
    assert abs(got[2] + 0.3) < 0.1


def test_cross_corr_matches_pandas(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=120), rng.normal(size=120)
    df = spark.createDataFrame([(T0 + dt.timedelta(hours=i), float(a[i]), float(b[i])) for i in range(120)],
                               "timestamp_hour timestamp_ntz, a double, b double")
    got = {r.lag: r.xcorr for r in D.cross_corr(df, "a", "b", max_lag=5).collect()}
    sa, sb = pd.Series(a), pd.Series(b)
    for lag in range(-5, 6):
        assert np.isclose(got[lag], sa.corr(sb.shift(lag)))


def test_quantile_methods_agree_with_numpy(spark):
    vals = [1, 5, 5, 2, 9, 9, 9, 4, 0, 7, 3]
    df = spark.createDataFrame([("g", float(v)) for v in vals], "g string, v double")
    qs = (0.25, 0.5, 0.65, 0.88)
    for method in ("bracket", "exact"):
        r = D.quantiles(df, "v", qs, ["g"], method).first()
        assert np.allclose([r[f"q{int(round(q * 100))}"] for q in qs], np.percentile(vals, [25, 50, 65, 88])), method
    b = D.box_stats(df, "v", ["g"]).first()
    q1, q3 = np.percentile(vals, [25, 75])
    assert b.whisker_lo == min(v for v in vals if v >= q1 - 1.5 * (q3 - q1)) and b.n_outliers == 0


def test_bracketed_quantiles_of_many_values(spark, monkeypatch):
    monkeypatch.setattr(D, "ACCURACY", 50)  # a coarse sketch, so that the brackets matter
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.normal(size=4000), np.repeat(0.5, 900), rng.normal(1e6, 1, size=100)])
    df = spark.createDataFrame([("g", float(v)) for v in vals] + [(None, 1.0), (None, 3.0), ("h", None)], "g string, v double").repartition(5)
    qs = (0.0, 0.25, 0.5, 0.65, 0.97, 1.0)
    got = {r.g: [r[f"q{int(round(q * 100))}"] for q in qs] for r in D.quantiles(df, "v", qs, ["g"]).collect()}
    assert np.allclose(got["g"], np.percentile(vals, [100 * q for q in qs]), rtol=0, atol=1e-12)
    assert np.allclose(got[None], [1.0, 1.5, 2.0, 2.3, 2.94, 3.0]) and set(got) == {"g", None}


def test_describe_and_profiles(spark):
    df = _series(spark, [1, 2, 3, 4, 100])
    d = D.describe(df, ["y"]).first()
    assert d["count"] == 5 and d["p50"] == 3.0 and np.isclose(d["std"], np.std([1, 2, 3, 4, 100], ddof=1))
    hp = D.hour_profile(df, "y", ["k"]).filter("hour = 4").first()
    assert hp["mean"] == 100.0 and hp["std"] is None


def test_corr_matrix_pairwise_complete(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, 4.0, 1.0), (3.0, 7.0, 2.0), (4.0, 8.0, 4.0)],
                               "a double, b double, c double")
    m = {(r.col_a, r.col_b): r.corr for r in D.corr_matrix(df, ["a", "b", "c"]).collect()}
    assert np.isclose(m[("a", "c")], pd.Series([2.0, 3, 4]).corr(pd.Series([1.0, 2, 4])))
    assert np.isclose(m[("a", "a")], 1.0)


def test_box_stats_of_few_groups_deal_no_rows_by_group(spark):
    df = spark.createDataFrame([("g", float(v)) for v in range(40)] + [("h", 500.0), (None, 1.0), (None, 3.0)], "g string, v double").repartition(3)
    few = D.box_stats(df, "v", ["g"], bound_groups=3)
    # rows meet their group's statistics where they are: nothing but aggregates is sent to a group's task
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = few._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") >= 2 and "SortMergeJoin" not in plan
        assert sorted(map(str, few.collect())) == sorted(map(str, D.box_stats(df, "v", ["g"]).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_corr_matrix_computes_a_pair_once(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, 4.5, 1.0), (3.0, 7.0, 2.0), (4.0, 8.0, 4.0)], "a double, b double, c double")
    m = D.corr_matrix(df, ["a", "b", "c"])
    got = {(r.col_a, r.col_b): r["corr"] for r in m.collect()}
    assert len(got) == 9 and all(got[x, y] == got[y, x] for x, y in got)
    assert np.isclose(got["b", "c"], np.corrcoef([4.5, 7.0, 8.0], [1.0, 2.0, 4.0])[0, 1])
    assert m._jdf.queryExecution().optimizedPlan().toString().count("covar_samp(") == 6
