import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from shiftcast.operators import features as FT
from shiftcast.operators import forecast as FC

T0 = dt.datetime(2024, 1, 1, 0)


def _panel(spark, n_hours, f=lambda h: h % 24):
    return spark.createDataFrame([(T0 + dt.timedelta(hours=h), int(f(h))) for h in range(n_hours)],
                                 "timestamp_hour timestamp_ntz, y long")


def test_cutoffs_match_pandas_date_range(spark):
    p = _panel(spark, 24 * 40)
    got = [r.cutoff for r in FC.fold_cutoffs(p, n_splits=5, test_weeks=1, min_train_weeks=2).orderBy("fold").collect()]
    t_min, t_max = T0, T0 + dt.timedelta(hours=24 * 40 - 1)
    exp = pd.date_range(t_min + pd.Timedelta(weeks=2), t_max - pd.Timedelta(weeks=1), periods=5)
    assert [pd.Timestamp(g) for g in got] == list(exp)
    step = FC.fold_cutoffs(p, n_splits=5, test_weeks=1, min_train_weeks=2, mode="step").count()
    assert step == 3


def test_baseline_fallback_chain(spark):
    # two weeks of data; hour 2024-01-15 09:00 has a 168 h lag, a gap-hour uses the slot mean
    rows = [(T0 + dt.timedelta(days=d, hours=9), 10 * (d + 1)) for d in range(0, 15) if d != 7]
    p = spark.createDataFrame(rows, "timestamp_hour timestamp_ntz, y long")
    p = FT.clock_lags(p, "y", (168,))
    cut = spark.createDataFrame([(0, T0 + dt.timedelta(days=13), T0 + dt.timedelta(days=20))],
                                "fold int, cutoff timestamp_ntz, test_end timestamp_ntz")
    slots = FC.baseline_fit(p, "y", cut)
    test = FC.fold_rows(p, cut, "test")
    got = {r.timestamp_hour.day: r.pred for r in FC.baseline_predict(test, slots, "y_lag_168h").collect()}
    # day 15 (index 14): lag 168 h = day 8 (index 7) is missing → slot (9 h, Monday) mean of training values
    assert got[15] == 10.0  # only Monday 9 h in training: day 1 (index 0)


def test_metrics_mape_only_above_one_and_clipping(spark):
    df = spark.createDataFrame([(0, 0, -2.0), (0, 1, 3.0), (0, 4, 2.0)], "fold int, y long, pred double")
    m = FC.forecast_metrics(df, "y").first()
    assert np.isclose(m.mae, (0 + 2 + 2) / 3) and np.isclose(m.mape, 50.0)
    assert np.isclose(m.rmse, np.sqrt((0 + 4 + 4) / 3))


def test_val_split_tail(spark):
    p = _panel(spark, 300).withColumn("fold", F.lit(0))
    flagged = FC.val_split(p).filter("is_val").agg(F.min("timestamp_hour"), F.count(F.lit(1))).first()
    assert flagged[1] == 200 and flagged[0] == T0 + dt.timedelta(hours=100)
    cut = FC.val_split_cut(p).filter("is_val").agg(F.min("timestamp_hour"), F.count(F.lit(1))).first()
    assert (cut[0], cut[1]) == (flagged[0], 200)  # one row per time: the same tail
    twice = FC.val_split_cut(p.unionByName(p)).filter("is_val").count()
    assert twice == 200  # whole time steps
    assert FC.unfit_folds(FC.val_split_cut(p)).count() == 0
    short = _panel(spark, 150).withColumn("fold", F.lit(1))
    assert [(r.fold, r.n_rows) for r in FC.unfit_folds(FC.val_split_cut(short)).collect()] == [(1, 150)]


def test_next_day_stub_and_baseline(spark):
    p = _panel(spark, 24 * 9, f=lambda h: h)
    nd = FC.next_day_baseline(p, "y")
    rows = nd.orderBy("timestamp_hour").collect()
    assert len(rows) == 17
    assert rows[0].timestamp_hour == dt.datetime(2024, 1, 10, 0) and rows[-1].timestamp_hour.hour == 23
    assert rows[0].baseline_pred == float(24 * 2)   # value one week earlier
    assert rows[0].shift == "late_bar"
