"""Features at the forecast's origin against loops, and with the target day hidden."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from shiftcast.operators import features as FT
from shiftcast.operators import horizon as H
from shiftcast.plans.feature_table import build_feature_table

T0 = dt.datetime(2024, 1, 1)
HOURS = [9, 12, 15, 18, 21, 23]


def _panel(spark, days=40, keys=("a", "b"), seed=0):
    rng = np.random.default_rng(seed)
    rows = [(k, T0 + dt.timedelta(days=d, hours=h), int(rng.integers(0, 50)), int(rng.integers(0, 9)), float(d))
            for k in keys for d in range(days) for h in HOURS if rng.random() > 0.1]
    return rows, spark.createDataFrame(rows, "k string, timestamp_hour timestamp_ntz, orders_count long, food_tickets_count long, temp_c double").repartition(5)


def test_last_version_known_at_the_origin(spark):
    rng = np.random.default_rng(1)
    rows, panel = _panel(spark, 12)
    versions = [("a", T0 + dt.timedelta(days=d, hours=h), T0 + dt.timedelta(days=d - back, hours=int(rng.integers(0, 24))), float(rng.integers(0, 99)))
                for d in range(12) for h in HOURS for back in range(4) if rng.random() > 0.3]
    versions += [("a", T0, None, 5.0), (None, T0, T0, 6.0)]
    signal = spark.createDataFrame(versions, "k string, timestamp_hour timestamp_ntz, known_at timestamp_ntz, rain_mm double")
    origin = H.evening_before()
    got = {(r.k, r.timestamp_hour): r.rain_mm for r in H.point_in_time(panel.withColumn("rain_mm", F.lit(-1.0)), signal, origin, ["rain_mm"], ["k"]).collect()}
    assert len(got) == len(rows)
    for k, t, *_ in rows:
        at = dt.datetime(t.year, t.month, t.day) - dt.timedelta(hours=6)
        known = [(c, v) for kk, tt, c, v in versions if kk == k and tt == t and c is not None and c <= at]
        assert got[k, t] == (max(known)[1] if known else None)
    # the whole target day hidden: versions made on it are not seen
    day = T0 + dt.timedelta(days=8)
    early = signal.where(F.col("known_at") < F.lit(day))
    pick = lambda s: {(r.k, r.timestamp_hour, r.rain_mm) for r in H.point_in_time(panel.where(F.to_date("timestamp_hour") == F.lit(day.date())), s, origin, ["rain_mm"], ["k"]).collect()}
    assert pick(signal) == pick(early) and any(v is not None for *_, v in pick(early))


def test_statistics_end_at_the_origin(spark):
    rows, panel = _panel(spark, 30)
    spec = {"roll_mean_24": (24, "mean"), "roll_max_24": (24, "max"), "roll_std_24": (24, "std")}
    got = {(r.k, r.timestamp_hour): r for r in H.origin_statistics(panel.select("k", "timestamp_hour"), panel, "orders_count", H.evening_before(), ["k"], spec=spec).collect()}
    for k, t, *_ in rows:
        at = dt.datetime(t.year, t.month, t.day) - dt.timedelta(hours=6)
        past = [v for _, v in sorted((tt, v) for kk, tt, v, *_ in rows if kk == k and tt <= at)][-24:]
        r = got[k, t]
        if len(past) < 6:
            assert r.orders_count_roll_mean_24 is None
        else:
            assert abs(r.orders_count_roll_mean_24 - np.mean(past)) < 1e-9 and r.orders_count_roll_max_24 == max(past)
            assert abs(r.orders_count_roll_std_24 - np.std(past, ddof=1)) < 1e-9
    day = (T0 + dt.timedelta(days=20)).date()
    target = panel.where(F.to_date("timestamp_hour") == F.lit(day)).select("k", "timestamp_hour")
    stats = lambda hist: {tuple(r) for r in H.origin_statistics(target, hist, "orders_count", H.evening_before(), ["k"], spec=spec).collect()}
    assert stats(panel) == stats(panel.where(F.to_date("timestamp_hour") < F.lit(day)))
    one = H.origin_statistics(target.where("k = 'a'").drop("k"), panel.where("k = 'a'").drop("k"), "orders_count", H.evening_before(), spec=spec)
    assert {("a", *r) for r in one.collect()} == {x for x in stats(panel) if x[0] == "a"}


def test_tail_equals_full_rebuild(spark):
    _, panel = _panel(spark, 60)
    build = lambda df: build_feature_table(df, keys=["k"], drop_na=False)
    both = [H.next_day_features(panel, build, ["k"], carry=["temp_c"], tail=t) for t in (True, False)]
    one, two = (sorted(map(str, df.select(sorted(df.columns)).collect())) for df in both)
    assert one == two and len(one) == 2 * 17
    assert H.history_tail(panel, ["k"]).count() < panel.count()
    r = both[0].where("k = 'a' and hour(timestamp_hour) = 12").first()
    assert r.temp_c == 59.0 and r.orders_count is None and r.hour == 12 and r.orders_count_roll_mean_168 is not None


def test_asof_pick_ties_and_nulls(spark):
    left = spark.createDataFrame([("a", 5, "x"), ("a", 1, "y"), (None, 5, "z"), ("b", 5, "w")], "k string, t int, name string")
    right = spark.createDataFrame([("a", 5, 1), ("a", 5, 2), ("a", 6, 9), ("a", None, 7), (None, 1, 8), ("c", 1, 3)], "k string, at int, v int")
    got = {r.name: r.seen for r in H.asof_pick(left, right, ["k"], "t", "at", {"v": "seen"}).collect()}
    assert got == {"x": 2, "y": None, "z": None, "w": None}


def test_scenarios(spark):
    day = spark.createDataFrame([(T0, 1.0, 0), (T0 + dt.timedelta(hours=1), 2.0, 1)], "timestamp_hour timestamp_ntz, rain_mm double, flag int")
    out = H.scenario_rows(day, {"plan": {}, "wet": {"rain_mm": 9, "absent": 3}, "flagged": {"flag": 1, "rain_mm": 0}})
    assert out.schema["flag"].dataType.simpleString() == "int"
    got = {(r.scenario, r.timestamp_hour.hour): (r.rain_mm, r.flag) for r in out.collect()}
    assert got == {("plan", 0): (1.0, 0), ("plan", 1): (2.0, 1), ("wet", 0): (9.0, 0), ("wet", 1): (9.0, 1), ("flagged", 0): (0.0, 1), ("flagged", 1): (0.0, 1)}
    assert FT.warmup_columns(out.columns) == []
