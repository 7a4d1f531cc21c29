"""Randomised equivalences (hypothesis, few examples: every one runs Spark jobs)."""

import datetime as dt

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shiftcast.operators import diagnostics as D
from shiftcast.operators import enrich as E
from shiftcast.operators import features as FT

SETTINGS = dict(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
D0 = dt.date(2026, 1, 1)


@settings(**SETTINGS)
@given(st.lists(st.tuples(st.integers(0, 60), st.one_of(st.none(), st.integers(-5, 20)), st.booleans()),
                min_size=1, max_size=25))
def test_interval_methods_agree(spark, ivs):
    rows = [(D0 + dt.timedelta(days=s), None if e is None else D0 + dt.timedelta(days=s + e), f) for s, e, f in ivs]
    df = spark.createDataFrame(rows, "s date, e date, f boolean")
    flags = {"flagged": F.col("f")}
    a = sorted(map(tuple, E.interval_daily_counts(df, "s", "e", flags, method="explode").collect()))
    b = sorted(map(tuple, E.interval_daily_counts(df, "s", "e", flags, method="delta")
                   .select("date", "failte_event_count", "flagged").collect()))
    assert a == b


@settings(**SETTINGS)
@given(st.lists(st.one_of(st.none(), st.integers(0, 50)), min_size=2, max_size=60))
def test_rolling_frames_equal_prefix(spark, vals):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("k", t0 + dt.timedelta(hours=i), v) for i, v in enumerate(vals)],
                               "k string, timestamp_hour timestamp_ntz, y long")
    spec = {"m3": (3, "mean"), "s6": (6, "std"), "m24": (24, "mean"), "x6": (6, "max")}
    a = FT.rolling_stats(df, "y", spec, ["k"], method="frames").orderBy("timestamp_hour").toPandas()
    b = FT.rolling_stats(df, "y", spec, ["k"], method="prefix").orderBy("timestamp_hour").toPandas()
    for c in ("y_m3", "y_s6", "y_m24", "y_x6"):
        x, y = a[c].astype(float).to_numpy(), b[c].astype(float).to_numpy()
        assert np.array_equal(np.isnan(x), np.isnan(y)) and np.allclose(np.nan_to_num(x), np.nan_to_num(y), atol=1e-9), c


@settings(**SETTINGS)
@given(st.lists(st.floats(-100, 100, allow_nan=False).map(lambda v: round(v, 1)), min_size=1, max_size=40),
       st.sampled_from([0.1, 0.25, 0.5, 0.88, 1.0]))
def test_bracketed_quantile_equals_numpy(spark, vals, q):
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    got = D.quantiles(df, "v", (q,), names=("q",)).first().q
    assert np.isclose(got, np.percentile(vals, q * 100))
