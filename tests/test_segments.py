import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from shiftcast.operators import segments as S


def test_segment_variants_every_hour(spark):
    df = spark.range(24).select(F.col("id").cast("int").alias("h"))
    got = {r.h: r for r in df.select("h", *[S.segment("h", v).alias(v) for v in S.SEGMENT_VARIANTS]).collect()}
    assert (got[12].label, got[15].label, got[21].label, got[1].label, got[2].label) == \
        ("lunch", "none", "late_bar", "late_bar", "none")
    assert (got[15].model, got[16].model, got[2].model, got[5].model) == ("lunch", "off_peak", "late_bar", None)
    assert (got[5].hour_shift, got[21].eda, got[22].eda) == ("off_peak", "Evening", "Late Bar")


def _hourly(spark, vals):
    base = dt.datetime(2024, 1, 1)
    rows = [(base + dt.timedelta(days=d, hours=h), v) for (d, h), v in vals.items()]
    return spark.createDataFrame(rows, "timestamp_hour timestamp_ntz, y long")


def test_shift_totals_after_midnight_counts_to_same_calendar_date(spark):
    df = _hourly(spark, {(0, 12): 5, (0, 13): 1, (0, 23): 2, (1, 0): 3, (1, 10): 100})
    got = {(r.date.day, r.shift): r.y for r in S.shift_totals(df, "y").collect()}
    assert got == {(1, "lunch"): 6, (1, "late_bar"): 2, (2, "late_bar"): 3}
    biz = {(r.date.day, r.shift): r.y for r in S.shift_totals(df, "y", day_offset_hours=2).collect()}
    assert biz[(1, "late_bar")] == 5


def test_thresholds_match_numpy_and_labels(spark):
    vals = [3, 9, 1, 14, 8, 20, 6]
    tot = spark.createDataFrame([(dt.date(2024, 1, i + 1), "lunch", v) for i, v in enumerate(vals)],
                                "date date, shift string, y long")
    thr = S.shift_thresholds(tot, "y").first()
    assert np.allclose([thr.q_quiet, thr.q_normal, thr.q_busy], np.percentile(vals, [25, 65, 88]))
    new = spark.createDataFrame([(dt.date(2024, 2, 1), "lunch", 20), (dt.date(2024, 2, 1), "dinner", 40)],
                                "date date, shift string, y long")
    lab = {r.shift: r.label for r in S.shift_labels(new, S.shift_thresholds(tot, "y"), "y").collect()}
    assert lab == {"lunch": "slammed", "dinner": "busy"}   # unseen shift → defaults 10 / 30 / 50


def test_kpis_peak_hour_tie_and_asof_thresholds(spark):
    vals = {}
    for d in range(6):
        for h in (12, 13, 14, 21, 22, 23, 0):
            vals[(d, h)] = 10 + d
    fc = _hourly(spark, vals).withColumn("orders", F.col("y").cast("double")).withColumn("tickets", F.lit(1.0))
    k = {(r.date.day, r.shift): r for r in S.shift_kpis(fc, fc, "orders", "tickets", "y").collect()}
    assert k[(1, "Late bar")].peak_hour == 0 or k[(1, "Late bar")].peak_hour == 21
    assert k[(6, "Lunch")].peak_hour == 12                 # ties → earliest hour
    assert k[(1, "Lunch")].label == "normal"              # 30 with < 4 earlier days → defaults 20/40/70
    assert k[(6, "Lunch")].label == "slammed"              # 45 > p88 of the five earlier days
    assert k[(6, "Lunch")].orders == 45 and k[(6, "Lunch")].prep == "Maximum prep"


def test_day_pressure_rules(spark):
    rows = [(1, "slammed"), (1, "quiet"), (2, "busy"), (2, "busy"), (3, "busy"), (4, "normal")]
    df = spark.createDataFrame([(dt.date(2024, 1, d), l) for d, l in rows], "date date, label string")
    got = {r.date.day: r.pressure for r in S.day_pressure(df).collect()}
    assert got == {1: "slammed", 2: "busy", 3: "moderate", 4: "normal"}


def test_ratio_and_slot_percentile_labels(spark):
    # Monday 13 h: base 55 × 0.65 = 35.75 → ratios 0.28 / 0.84 / 1.12 / 1.68
    rows = [(dt.datetime(2024, 1, 1 + 7 * i, 13), v) for i, v in enumerate([10, 30, 40, 60])]
    df = spark.createDataFrame(rows, "timestamp_hour timestamp_ntz, orders_count long")
    got = [r.busy_label for r in S.ratio_label(df).orderBy("timestamp_hour").collect()]
    assert got == ["quiet", "normal", "busy", "slammed"]
    slot = {r.orders_count: r.busy_label for r in S.slot_percentile_label(df).collect()}
    assert slot[10] == "quiet" and slot[60] == "slammed"
