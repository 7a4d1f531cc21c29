import datetime as dt

from pyspark.sql import functions as F

from shiftcast.operators import panel as P
from conftest import ts


def _rows(spark, rows, schema="t string, kitchen string, customer_name string"):
    return spark.createDataFrame(rows, schema)


def test_hourly_rollup_open_hours_food_and_unparseable(spark):
    raw = _rows(spark, [
        ("2024-01-05 09:10:00", "yes", "a"),      # food hour, truthy
        ("2024-01-05 09:50:00", "1.0", "b"),      # "1.0" is not truthy
        ("2024-01-05 21:30:00", "FOOD", "c"),     # after food close → 0
        ("2024-01-05 23:59:59", "true", "d"),
        ("2024-01-06 00:30:00", "no", "e"),
        ("2024-01-06 01:15:00", None, "f"),
        ("2024-01-06 03:00:00", "yes", "g"),      # closed hour → dropped
        ("not a time", "yes", "h"),               # unparseable → dropped
    ])
    out = P.sanitize(raw, timestamp_col="t", food_col="kitchen")
    assert out.columns == ["timestamp_hour", "orders_count", "food_tickets_count"]
    got = {r.timestamp_hour: (r.orders_count, r.food_tickets_count) for r in out.collect()}
    assert got == {ts("2024-01-05 09:00"): (2, 1), ts("2024-01-05 21:00"): (1, 0),
                   ts("2024-01-05 23:00"): (1, 0), ts("2024-01-06 00:00"): (1, 0), ts("2024-01-06 01:00"): (1, 0)}
    assert dict(out.dtypes)["timestamp_hour"] == "timestamp_ntz"


def test_rollup_without_flag_estimates_food_hours_and_weight(spark):
    raw = spark.createDataFrame([(ts("2024-01-05 10:05"), 3), (ts("2024-01-05 10:40"), 2),
                                 (ts("2024-01-05 22:00"), 4)], "opened timestamp_ntz, n int")
    out = P.hourly_rollup(raw, "opened", weight="n")
    got = {r.timestamp_hour.hour: (r.orders_count, r.food_tickets_count) for r in out.collect()}
    assert got == {10: (5, 5), 22: (4, 0)}


def test_sum_preservation_and_key_independence(spark):
    import random

    rnd = random.Random(7)
    base = dt.datetime(2024, 3, 1)
    rows = [(rnd.choice(["a", "b", "c"]), base + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * 5)))
            for _ in range(500)]
    df = spark.createDataFrame(rows, "venue string, ts timestamp_ntz")
    full = P.hourly_rollup(df, "ts", keys=["venue"])
    kept = df.filter(P.is_open_hour(F.hour("ts"))).count()
    assert full.agg(F.sum("orders_count")).first()[0] == kept
    only_a = P.hourly_rollup(df.filter("venue = 'a'"), "ts", keys=["venue"])
    assert sorted(map(tuple, only_a.collect())) == sorted(map(tuple, full.filter("venue = 'a'").collect()))


def test_pii_detection_protects_timestamp(spark):
    cols = ["Created Time", "Customer Name", "Card Last4", "total", "company", "tickets"]
    assert P.pii_match("Customer Name") == "name"
    assert P.pii_match("company") == "pan"            # substring rule of the reference
    assert P.pii_match("company", token_boundary=True) is None
    assert P.detect_timestamp_col(cols) == "Created Time"
    assert P.detect_food_col(cols) == "tickets"
    df = spark.createDataFrame([tuple(range(6))], ", ".join(f"`{c}` int" for c in cols))
    kept = P.drop_pii(df, protect=["Created Time"]).columns
    assert kept == ["Created Time", "total", "tickets"]


def test_range_filter_inclusive_end_of_day(spark):
    df = spark.createDataFrame([(ts("2024-01-31 23:00"),), (ts("2024-02-01 00:00"),), (ts("2024-01-01 00:00"),)],
                               "t timestamp_ntz")
    out = P.range_filter(df, "t", "2024-01-01", "2024-01-31").collect()
    assert len(out) == 2


def test_panel_summary(spark):
    df = spark.createDataFrame([(ts("2024-01-01 09:00"), 4, 0), (ts("2024-01-01 10:00"), 6, 2)],
                               "timestamp_hour timestamp_ntz, orders_count long, food_tickets_count long")
    r = P.panel_summary(df).first()
    assert (r.n_rows, r.mean_orders, r.mean_food_positive) == (2, 5.0, 2.0)


def test_coerce_parse_day_first_and_numbers(spark):
    df = spark.createDataFrame([("05/07/2026", "12", "1-URGENT"), ("2026-07-05", "x", "3")], "d string, n string, p string")
    r = df.select(P.coerce_timestamp("d", ["dd/MM/yyyy"]).alias("t"), P.coerce_number("n", "int").alias("n"),
                  P.coerce_number("p", "int").alias("p")).collect()
    assert r[0].t == ts("2026-07-05 00:00") and r[0].n == 12 and r[0].p is None
    assert r[1].t is None and r[1].n is None and r[1].p == 3


def test_truthy_values(spark):
    df = spark.createDataFrame([("TRUE",), ("yes",), ("1",), ("Food",), ("1.0",), ("no",), (None,)], "v string")
    assert [r.f for r in df.select(P.truthy("v").alias("f")).collect()] == [1, 1, 1, 1, 0, 0, 0]
