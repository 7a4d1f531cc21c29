import time

from pyspark.sql import functions as F

from shiftcast.operators.panel import hourly_rollup
from shiftcast.streaming.rollup import start_rollup, stream_source, streaming_hourly_rollup

SF = "/root/testdata/sf0.001"


def test_streaming_rollup_equals_batch_for_closed_hours(spark, tmp_dir):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    src = stream_source(spark, SF, schema, glob="events.parquet")
    panel = streaming_hourly_rollup(src, "ts", flag=F.col("event_type") == "purchase")
    q = start_rollup(panel, f"{tmp_dir}/out", f"{tmp_dir}/ckpt")
    q.awaitTermination(300)
    streamed = spark.read.parquet(f"{tmp_dir}/out")
    batch = hourly_rollup(spark.read.parquet(f"{SF}/events.parquet"), "ts", flag=F.col("event_type") == "purchase")
    last = streamed.agg(F.max("timestamp_hour")).first()[0]
    assert last is not None
    closed = batch.filter(F.col("timestamp_hour") <= last)
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, closed.collect()))


def test_nowcast_features_equal_batch_across_a_restart(spark, tmp_dir):
    import datetime as dt

    import numpy as np

    from shiftcast.operators import features as FT
    from shiftcast.streaming.nowcast import nowcast_features

    rng = np.random.default_rng(3)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k, t0 + dt.timedelta(days=d, hours=h), int(rng.integers(0, 50))) for d in range(24) for h in (9, 10, 11, 12, 15, 18, 21, 22, 23)
            for k in "ab" if rng.random() > 0.1]
    schema = "k string, timestamp_hour timestamp_ntz, orders_count long"
    src, out, ckpt = (f"{tmp_dir}/{x}" for x in ("closed", "out", "ckpt"))

    def arrive(lo, hi, more=()):
        part = [r for r in rows if lo <= (r[1] - t0).days < hi]
        spark.createDataFrame([*part, *more], schema).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # files are read in the order of their times

    def run():
        feats = nowcast_features(stream_source(spark, src, schema, max_files=1), "orders_count", ["k"])
        start_rollup(feats, out, ckpt).awaitTermination(300)

    arrive(0, 9)
    arrive(9, 10)
    run()
    arrive(10, 24, [("a", t0, 999)])  # an hour long closed is left out
    run()
    names = ["orders_count_lag_1", "orders_count_lag_2", "orders_count_lag_3", "orders_count_lag_24h", "orders_count_lag_48h", "orders_count_lag_168h",
             "orders_count_lag_336h", *[f"orders_count_{n}" for n in FT.ROLLING]]
    batch = spark.createDataFrame(rows, schema)
    batch = FT.rolling_stats(FT.clock_lags(FT.row_lags(batch, "orders_count", (1, 2, 3), ["k"]), "orders_count", keys=["k"]), "orders_count", keys=["k"])
    pick = lambda df: sorted(map(str, df.select("k", "timestamp_hour", F.col("orders_count").cast("long").alias("n"),
                                                *[F.round(F.col(c).cast("double"), 9).alias(c) for c in names]).collect()))
    assert pick(spark.read.parquet(out)) == pick(batch)
