import datetime as dt
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from shiftcast.operators import availability as AV
from shiftcast.operators import features as FT

T0 = dt.datetime(2024, 1, 1, 9)


def _panel(spark, hours, key="a", start=T0):
    rows = [(key, start + dt.timedelta(hours=h), int(v) if v is not None else None) for h, v in hours]
    return spark.createDataFrame(rows, "k string, timestamp_hour timestamp_ntz, y long")


def test_clock_lags_are_gap_correct(spark):
    # hour 24 exists, hour 25 is missing, so row 49's 24 h lag is NULL while its row lag is not
    df = _panel(spark, [(0, 1), (24, 2), (48, 3), (49, 4), (24 * 7 + 48, 9)])
    out = {r.timestamp_hour: r for r in FT.row_lags(FT.clock_lags(df, "y", (24, 168), ["k"]), "y", (1,), ["k"]).collect()}
    r49 = out[T0 + dt.timedelta(hours=49)]
    assert r49.y_lag_24h is None and r49.y_lag_1 == 3
    assert out[T0 + dt.timedelta(hours=48)].y_lag_24h == 2
    assert out[T0 + dt.timedelta(hours=216)].y_lag_168h == 3


def test_same_slot_mean_over_available_weeks(spark):
    w = 168
    df = _panel(spark, [(0, 10), (w, 20), (3 * w, 60), (4 * w, 0)])
    out = {r.timestamp_hour: r.y_same_slot_4w_avg for r in FT.same_slot_mean(df, "y", 4, ["k"]).collect()}
    assert out[T0 + dt.timedelta(hours=4 * w)] == (60 + 20 + 10) / 3
    assert out[T0] is None


def test_rolling_matches_pandas_shift_rolling(spark):
    rng = np.random.default_rng(3)
    vals = [None if i in (5, 6) else int(x) for i, x in enumerate(rng.integers(0, 30, 60))]
    df = _panel(spark, list(enumerate(vals)))
    out = FT.rolling_stats(df, "y", keys=["k"]).orderBy("timestamp_hour").toPandas()
    s = pd.Series([np.nan if v is None else v for v in vals], dtype=float).shift(1)
    for name, (w, how) in FT.ROLLING.items():
        exp = getattr(s.rolling(w, min_periods=max(1, w // 4)), how)()
        got = out[f"y_{name}"].astype(float)
        assert np.allclose(got.fillna(-1e9), exp.fillna(-1e9), atol=1e-9), name


def test_std_of_single_value_is_null(spark):
    df = _panel(spark, [(0, 5), (1, 7)])
    spec = {"roll_std_24": (24, "std")}
    out = FT.rolling_stats(df, "y", spec, ["k"]).orderBy("timestamp_hour").collect()
    assert out[1].y_roll_std_24 is None


def test_key_independence_and_shuffle_invariance(spark):
    a = _panel(spark, [(h, h % 5) for h in range(0, 400, 3)], "a")
    b = _panel(spark, [(h, h % 7) for h in range(1, 400, 2)], "b")
    both = a.unionByName(b)
    f_both = FT.add_rolling_features(FT.add_lag_features(both, "y", ["k"]), "y", ["k"])
    f_a = FT.add_rolling_features(FT.add_lag_features(a, "y", ["k"]), "y", ["k"])
    key = lambda rows: sorted(tuple(r) for r in rows)
    assert key(f_a.collect()) == key(f_both.filter("k = 'a'").collect())
    shuffled = both.repartition(7, F.rand(1))
    f_sh = FT.add_lag_features(shuffled, "y", ["k"])
    assert key(FT.add_lag_features(both, "y", ["k"]).collect()) == key(f_sh.collect())


def test_leakage_safe_features_ignore_the_future(spark):
    df = _panel(spark, [(h, (h * 37) % 11) for h in range(0, 24 * 30)])
    cut = T0 + dt.timedelta(days=20)
    full = FT.add_rolling_features(FT.add_lag_features(df, "y", ["k"]), "y", ["k"])
    trunc = FT.add_rolling_features(FT.add_lag_features(df.filter(F.col("timestamp_hour") <= cut), "y", ["k"]), "y", ["k"])
    safe = [c for c in full.columns if c in AV.SAFE_FOR_NEXT_DAY or c.startswith("y_")]
    pick = lambda d: sorted(tuple(r) for r in d.filter(F.col("timestamp_hour") <= cut).select("timestamp_hour", *safe).collect())
    assert pick(full) == pick(trunc)


def test_warmup_drop_uses_lag_and_roll_columns_only(spark):
    df = _panel(spark, [(h, 1) for h in range(0, 24 * 16)])
    f = FT.add_rolling_features(FT.add_lag_features(df, "y", ["k"]), "y", ["k"])
    kept = FT.warmup_drop(f)
    assert kept.agg(F.min("timestamp_hour")).first()[0] == T0 + dt.timedelta(hours=336)
    assert "y_same_slot_4w_avg" not in FT.warmup_columns(f.columns)


def test_interactions(spark):
    df = spark.createDataFrame([(1, 1, 2.5, 1, 1, 0.5, 1)],
                               "is_weekend int, is_live_music_window int, rain_mm double, bank_holiday_flag int, "
                               "city_event_flag int, airport_arrivals_zscore double, cruise_ship_flag int")
    r = FT.add_interactions(df).first()
    assert (r.weekend_x_music, r.rain_x_weekend, r.event_intensity, r.tourism_pressure) == (1, 2.5, 2, 1.5)
    assert not math.isnan(r.tourism_pressure)


def test_feature_lists_by_availability_and_exclusion():
    cols = ["timestamp_hour", "orders_count", "orders_count_lag_1", "orders_count_lag_24h", "hour", "temp_c",
            "sales_total", "busy_label"]
    assert AV.feature_cols(cols, AV.SAFE_FOR_NEXT_DAY) == ["orders_count_lag_24h", "hour", "temp_c"]
    assert "orders_count_lag_1" in AV.feature_cols(cols, AV.FULL_FEATURES)
    assert AV.feature_columns_by_exclusion(cols, ["orders_count"]) == ["orders_count_lag_1", "orders_count_lag_24h",
                                                                        "temp_c"]


def test_rolling_features_of_whole_targets_need_no_wide_frames(spark):
    """Two integer targets together: the values of the sliding frames, nulls, gaps and large values included,
    from one sort and without a frame as wide as a window."""
    import random

    rnd = random.Random(3)
    rows = []
    for k in ("a", "b", None):
        big = 2 ** 20 if k == "b" else 0
        rows += [(k, T0 + dt.timedelta(hours=h), None if rnd.random() < 0.2 else rnd.randint(-9, 40) + big, rnd.randint(0, 5))
                 for h in range(240) if rnd.random() < 0.9]
    df = spark.createDataFrame(rows, "k string, timestamp_hour timestamp_ntz, y long, z int")
    old = FT.rolling_stats(FT.rolling_stats(df, "y", keys=["k"]), "z", keys=["k"])
    new = FT.add_rolling_features(df, ["y", "z"], ["k"])
    assert old.dtypes == new.dtypes
    order = lambda d: d.orderBy("k", "timestamp_hour").collect()
    for a, b in zip(order(old), order(new), strict=True):
        for c in old.columns:
            assert (a[c] is None) == (b[c] is None), (c, a, b)
            if isinstance(a[c], float):
                assert abs(a[c] - b[c]) <= 1e-9 * max(1.0, abs(a[c])), (c, a, b)
            else:
                assert a[c] == b[c], (c, a, b)
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1
    assert not any(f"-{w}, -1)" in plan for w in (24, 168))


def test_round6_equals_round(spark):
    vals = [0.0, -0.0, 3.0, -7.0, 0.1234565, -2.5000005, 1e300, 123456789.0000004, float("nan"), float("inf"), None]
    from shiftcast.plans.feature_queries import _round6

    df = spark.createDataFrame([(v,) for v in vals], "v double").select(_round6("v").alias("a"), (F.round("v", 6) + F.lit(0.0)).alias("b"))
    assert [(str(r.a), str(r.b)) for r in df.collect() if str(r.a) != str(r.b)] == []
