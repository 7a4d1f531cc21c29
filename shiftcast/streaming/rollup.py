"""Streaming hourly roll-up (survey §7.4 step 9, an extension of B8).

Raw transaction files arrive in a folder; a Structured Streaming query keeps
the hourly panel current.  Event time must be ``TIMESTAMP`` for watermarks,
so naive times are read as UTC instants (independent of the session zone) and
the closed hour is written back as a naive ``timestamp_hour``.  Rows later than the watermark
are dropped; every closed hour equals the batch roll-up of the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from shiftcast.functions.timecols import is_open_hour, truthy


def stream_source(spark: SparkSession, folder: str, schema: T.StructType | str, glob: str = "*.parquet",
                  fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema).option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(folder)


def streaming_hourly_rollup(stream: DataFrame, ts: str, flag=None, keys: Sequence[str] = (),
                            watermark: str = "2 hours", open_from: int = 9, close_after_midnight: int = 1,
                            food_from: int = 9, food_until: int = 21) -> DataFrame:
    """Same semantics as ``operators.panel.hourly_rollup`` on an unbounded input."""
    keys = list(keys)
    # naive time → an instant read as UTC, so hour windows align with the
    # naive clock hours whatever the session zone (also +05:30 zones)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    t = F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, F.col(ts)))
    staged = stream.select(*keys, t.alias("_et"),
                           (truthy(flag) if flag is not None else F.lit(None).cast("int")).alias("_flag"))
    h = F.hour(F.timestamp_add("MICROSECOND", F.unix_micros("_et"), epoch))
    staged = staged.filter(F.col("_et").isNotNull() & is_open_hour(h, open_from, close_after_midnight))
    food_hours = (h >= food_from) & (h < food_until)
    is_food = F.col("_flag") if flag is not None else food_hours.cast("int")
    agg = (staged.withWatermark("_et", watermark)
           .groupBy(*keys, F.window("_et", "1 hour").alias("w"))
           .agg(F.count(F.lit(1)).alias("orders_count"), F.sum(is_food).cast("long").alias("food_tickets_count")))
    start = F.timestamp_add("MICROSECOND", F.unix_micros(F.col("w.start")), epoch)
    return agg.select(*keys, start.alias("timestamp_hour"), "orders_count",
                      F.when(F.hour(start).between(food_from, food_until - 1), F.col("food_tickets_count"))
                      .otherwise(F.lit(0)).cast("long").alias("food_tickets_count"))


def start_rollup(panel_stream: DataFrame, sink_path: str, checkpoint: str, available_now: bool = True,
                 query_name: str | None = None) -> StreamingQuery:
    """Append closed hours to a Parquet sink; the checkpoint folder makes the
    query restartable after executor or driver loss (exactly-once file sink)."""
    w = (panel_stream.writeStream.format("parquet").outputMode("append")
         .option("path", sink_path).option("checkpointLocation", checkpoint))
    if query_name:
        w = w.queryName(query_name)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
