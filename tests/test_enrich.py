import datetime as dt

from pyspark.sql import functions as F

from shiftcast.operators import enrich as E
from shiftcast.operators import footfall as FF
from shiftcast.sources import ingest as I

D = dt.date


def test_ffill_then_bfill_per_key(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5.0), ("a", 3, None), ("b", 1, None), ("b", 2, 7.0)],
                               "k string, t int, v double")
    got = {(r.k, r.t): r.v for r in E.ffill_bfill(df, ["v"], ["k"], "t").collect()}
    assert got == {("a", 1): 5.0, ("a", 2): 5.0, ("a", 3): 5.0, ("b", 1): 7.0, ("b", 2): 7.0}


def test_quarter_to_daily_and_lag_bfill(spark):
    df = spark.createDataFrame([("Q3 25", "1,234.5"), ("Q1 2024", "91"), ("bad", "1")], "q string, t string")
    d = E.quarter_to_daily(df, "q", "t")
    got = {r.date: r.airport_arrivals for r in d.collect()}
    assert got[D(2025, 7, 1)] == 1234500 // 92 and got[D(2025, 9, 30)] == 1234500 // 92
    assert got[D(2024, 3, 31)] == 91000 // 91 and len(got) == 92 + 91
    lb = {r.date: r.airport_arrivals_lag1 for r in E.lag_bfill(d, "airport_arrivals", "airport_arrivals_lag1").collect()}
    assert lb[D(2024, 1, 1)] == 1000 and lb[D(2025, 7, 1)] == 1000


def test_interval_counts_explode_equals_delta(spark):
    rows = [(D(2026, 7, 2), D(2026, 7, 4), True, False), (D(2026, 7, 3), None, False, True),
            (D(2026, 7, 5), D(2026, 7, 1), True, True), (D(2030, 12, 30), D(2031, 2, 1), False, False)]
    df = spark.createDataFrame(rows, "s date, e date, free boolean, fest boolean")
    flags = {"free_n": F.col("free"), "fest_n": F.col("fest")}
    assert E.interval_daily_counts(df, "s", "e").filter("date = '2031-02-01'").count() == 1  # no cut by default
    cap = "2030-12-31"
    ex = sorted(map(tuple, E.interval_daily_counts(df, "s", "e", flags, cap, method="explode").collect()))
    de = sorted(map(tuple, E.interval_daily_counts(df, "s", "e", flags, cap, method="delta")
                    .select("date", "failte_event_count", "free_n", "fest_n").collect()))
    assert ex == de
    got = {r[0]: r[1:] for r in ex}
    assert got[D(2026, 7, 3)] == (2, 1, 1) and D(2026, 7, 5) not in got and D(2031, 1, 1) not in got
    assert got[D(2030, 12, 31)] == (1, 0, 0)


def test_geo_radius(spark):
    # 0.0366° of latitude ≈ 4.07 km, 0.0466° ≈ 5.18 km
    df = spark.createDataFrame([(1, 53.3434, -6.2601), (2, 53.38, -6.2601), (3, 53.39, -6.2601)],
                               "id int, lat double, lon double")
    got = {r.id: r.dist_km for r in E.geo_radius(df, "lat", "lon").collect()}
    assert set(got) == {1, 2} and got[1] == 0.0 and abs(got[2] - 4.0698) < 1e-3


def test_merge_daily_replaces_and_merge_hourly_fills(spark):
    hourly = spark.createDataFrame([(dt.datetime(2024, 1, 1, 9), 1.0, 5), (dt.datetime(2024, 1, 2, 9), 2.0, 6)],
                                   "timestamp_hour timestamp_ntz, temp_c double, orders_count long")
    daily = spark.createDataFrame([(D(2024, 1, 1), 9.5, 1)], "date date, temp_c double, school_holiday_flag int")
    m = {r.timestamp_hour.day: r for r in E.merge_daily_replace(hourly, daily).collect()}
    assert m[1].temp_c == 9.5 and m[2].temp_c is None and m[1].school_holiday_flag == 1
    foot = spark.createDataFrame([(dt.datetime(2024, 1, 1, 9), "12")], "timestamp_hour timestamp_ntz, footfall string")
    h = {r.timestamp_hour.day: r.footfall for r in E.merge_hourly(hourly, foot, None, bound_rows=10).collect()}
    assert h == {1: 12.0, 2: 0.0}


def test_zscore_zero_std_is_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 3.0)], "k string, x double")
    got = {(r.k, r.x): r.z for r in E.zscore(df, "x", "z", ["k"]).collect()}
    assert got[("a", 1.0)] is None and abs(got[("b", 3.0)] - 0.7071067811865475) < 1e-12
    whole = E.zscore(df, "x", "z").agg(F.sum("z")).first()[0]
    assert abs(whole) < 1e-12


def test_footfall_block(spark):
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), (h % 5) if h % 9 else None, 10 + h % 3, None if h % 4 else 4)
            for h in range(200)]
    df = spark.createDataFrame(rows, "timestamp_hour timestamp_ntz, primary long, n1 long, n2 long")
    out = FF.footfall_features(df, "primary", ["n1", "n2"]).orderBy("timestamp_hour").toPandas()
    assert out["nearby_footfall_avg"].iloc[0] == 7.0      # mean of 10 and 4
    assert out["nearby_footfall_avg"].iloc[1] == 11.0     # n2 NULL is skipped
    assert (out["suffolk_footfall_lag_1h"].iloc[0] == 0) and out["suffolk_footfall_roll_24h"].iloc[:4].isna().all()
    assert out["suffolk_counter_is_live"].sum() == sum(1 for h in range(200) if h % 9)
    assert out["suffolk_nassau_footfall"].notna().all()


def test_read_csv_bom_encoding_and_bad_lines(spark, tmp_dir):
    path = f"{tmp_dir}/feed.csv"
    with open(path, "wb") as f:
        f.write("﻿Name, Start Date ,Lat\n".encode("utf-8"))
        f.write("Caf\xe9 night,02/07/2026,53.3\n".encode("latin-1"))
        f.write("short row,03/07/2026\n".encode("latin-1"))
        f.write("too,many,fields,here\n".encode("latin-1"))
    df = I.read_csv(spark, path)
    assert df.columns == ["Name", "Start Date", "Lat"]
    rows = sorted(df.collect(), key=lambda r: r.Name)
    assert [r.Name for r in rows] == ["Café night", "short row"]
    assert rows[1].Lat is None


def test_union_first_wins(spark):
    a = spark.createDataFrame([(1, 10.0), (2, 20.0)], "t int, x double")
    b = spark.createDataFrame([(2, 99.0, "b"), (3, 30.0, "b")], "t int, x double, extra string")
    got = {r.t: (r.x, r.extra) for r in I.union_first_wins([a, b], "t").collect()}
    assert got == {1: (10.0, None), 2: (20.0, None), 3: (30.0, "b")}


def test_contract_violations(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 30), 0, "busy"), (dt.datetime(2024, 1, 1, 9), 12, "meh")],
                               "timestamp_hour timestamp_ntz, hour int, busy_label string")
    rules = [I.Rule("timestamp_hour", required=True, on_the_hour=True), I.Rule("hour", range=(9, 23)),
             I.Rule("busy_label", values=["quiet", "normal", "busy", "slammed"]), I.Rule("orders_count", required=True)]
    got = {(r.column_name, r.check_name): r.n_violations for r in I.contract_violations(df, rules).collect()}
    assert got == {("timestamp_hour", "null"): 0, ("timestamp_hour", "on_the_hour"): 1, ("hour", "range"): 1,
                   ("busy_label", "values"): 1, ("orders_count", "missing"): -1}


def test_json_payloads(spark):
    df = spark.createDataFrame([('{"hourly": {"time": ["2026-07-02T00:00", "2026-07-02T01:00"], "t": [17.4, 16.9]}}',
                                 '{"k": 5}')], "j string, props string")
    rows = I.json_column_arrays(df, "j", "hourly", {"time": "string", "t": "double"}).collect()
    assert [(r.time, r.t) for r in rows] == [("2026-07-02T00:00", 17.4), ("2026-07-02T01:00", 16.9)]
    assert I.json_props(df, "props", {"k": "bigint"}).first().k == 5


def test_keyword_match(spark):
    df = spark.createDataFrame([("MSC Virtuosa", "Passenger"), ("Ulysses", "Ferry"), ("Aurora", "Cruise Liners")],
                               "vessel string, vtype string")
    got = [r.m for r in df.select(E.keyword_match("vessel", "vtype").alias("m")).collect()]
    assert got == [True, False, True]


def test_busy_flag_asof_uses_only_earlier_weeks(spark):
    t0 = dt.datetime(2024, 1, 1, 12)  # Monday noon, one row per week
    vals = [5, 1, 9, 2, 8]
    df = spark.createDataFrame([(t0 + dt.timedelta(weeks=i), float(v)) for i, v in enumerate(vals)],
                               "timestamp_hour timestamp_ntz, v double")
    got = [r.b for r in FF.busy_flag(df, "v", "b", asof=True).orderBy("timestamp_hour").collect()]
    # week 0 has no history; week 2: 9 > p70(5, 1) = 3.8; week 4: 8 > p70(5, 1, 9, 2) = 5.4
    assert got == [0, 0, 1, 0, 1]
    full = [r.b for r in FF.busy_flag(df, "v", "b").orderBy("timestamp_hour").collect()]
    assert full == [0, 0, 1, 0, 1]  # p70 of all five = 7.4
    future = df.filter(F.col("timestamp_hour") <= t0 + dt.timedelta(weeks=2))
    assert [r.b for r in FF.busy_flag(future, "v", "b", asof=True).orderBy("timestamp_hour").collect()] == got[:3]


def test_keyed_signals_reach_their_own_venue_only(spark):
    t = dt.datetime(2024, 1, 1, 10)
    panel = spark.createDataFrame([("a", t, 1), ("b", t, 2)], "venue string, timestamp_hour timestamp_ntz, orders_count int")
    daily = spark.createDataFrame([("a", t.date(), 7), ("a", t.date(), 9), ("b", t.date(), 8)], "venue string, date date, n int")
    got = {r.venue: r.n for r in E.merge_daily_replace(panel, daily, keys=["venue"]).collect()}
    assert got == {"a": 7, "b": 8}  # no row is multiplied
    city = spark.createDataFrame([(t.date(), 5)], "date date, n int")
    assert [r.n for r in E.merge_daily_replace(panel, city, keys=["venue"]).collect()] == [5, 5]
    foot = spark.createDataFrame([("b", t, 3)], "venue string, timestamp_hour timestamp_ntz, views int")
    wx = spark.createDataFrame([(t, 4.0)], "timestamp_hour timestamp_ntz, temp_c double")
    got = {r.venue: (r.views, r.temp_c) for r in E.merge_hourly(panel, foot, wx, keys=["venue"]).collect()}
    assert got == {"a": (0.0, 4.0), "b": (3.0, 4.0)}
    spine = spark.createDataFrame([("a", t.date()), ("b", t.date())], "venue string, date date")
    flag = spark.createDataFrame([("a", t.date(), 1)], "venue string, date date, x_flag int")
    assert {r.venue: r.x_flag for r in E.enrich_spine(spine, [flag], keys=["venue"]).collect()} == {"a": 1, "b": 0}
