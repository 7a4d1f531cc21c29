"""Operations on one long series against plain loops, across chunks and blocks."""

import datetime as dt
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftcast.operators import enrich as E
from shiftcast.operators import footfall as FF
from shiftcast.operators import series as SR

T0 = dt.datetime(2023, 11, 3)


@pytest.fixture()
def rows():
    rng = np.random.default_rng(4)
    out, t = [], T0
    for i in range(400):
        t += dt.timedelta(hours=int(rng.choice([1, 1, 5, 900], p=[0.5, 0.2, 0.28, 0.02])))
        gap = 90 < i < 180 or i < 5 or i > 390  # longer than chunks and blocks
        out.append((t, None if gap or rng.random() < 0.3 else round(float(rng.uniform(0, 99)), 1), i))
    return out


def _df(spark, rows):
    return spark.createDataFrame(rows, "timestamp_hour timestamp_ntz, v double, i int").repartition(6)


def _fill(x):
    x = list(x)
    for i in range(1, len(x)):
        x[i] = x[i - 1] if x[i] is None else x[i]
    for i in range(len(x) - 2, -1, -1):
        x[i] = x[i + 1] if x[i] is None else x[i]
    return x


@pytest.mark.parametrize("days,block", [(28, 4096), (1, 7)])
def test_equal_to_loops(spark, rows, monkeypatch, days, block):
    monkeypatch.setattr(SR, "CHUNK_DAYS", days)
    monkeypatch.setattr(SR, "BLOCK", block)
    df, v = _df(spark, rows), [r[1] for r in rows]
    got = {r.i: r.v for r in E.ffill_bfill(df, ["v"]).collect()}
    assert [got[i] for i in range(400)] == _fill(v)
    lagged = [None, *v[:-1]]
    want = [next((x for x in lagged[i:] if x is not None), None) for i in range(400)]
    got = {r.i: r.o for r in E.lag_bfill(df, "v", "o", order="timestamp_hour").collect()}
    assert [got[i] for i in range(400)] == want
    lags = {r.i: (r.l_1h, r.l_24h, r.l_168h) for r in FF.row_lags_filled(df, "v", (1, 24, 168), prefix="l_").collect()}
    z = [x or 0.0 for x in v]
    assert all(lags[i] == tuple(int(np.round(z[i - n])) if i >= n else 0 for n in (1, 24, 168)) for i in range(400))
    roll = {r.i: r.r for r in FF.rolling_mean_min(df, "v", "r").collect()}
    for i in range(400):
        part = z[max(0, i - 24):i]
        assert (roll[i] is None) == (len(part) < 4) and (roll[i] is None or abs(roll[i] - sum(part) / len(part)) <= 0.0501)


def test_no_window_without_partitions(spark, rows):
    df = _df(spark, rows)
    for out in (E.ffill_bfill(df, ["v"]), E.lag_bfill(df, "v", "o", order="timestamp_hour"), FF.row_lags_filled(df, "v"), FF.rolling_mean_min(df, "v")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        # over a chunk, a block, or the table of one row for each chunk of the calendar
        first = re.findall(r"windowspecdefinition\((\w+)#", plan)
        assert first and set(first) <= {"_chunk", "_block"}


def test_empty_series(spark):
    df = spark.createDataFrame([], "timestamp_hour timestamp_ntz, v double")
    assert E.ffill_bfill(df, ["v"]).count() == 0 and FF.row_lags_filled(df, "v").where(F.lit(True)).count() == 0
