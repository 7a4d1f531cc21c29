"""External-signal stand-ins derived from the driver's tables.

The reference joins weather, airport, port, event and footfall feeds.  Those
feeds are landed files we do not have, so each signal is derived from the
given tables with the same shape (one row per day or hour) and pushed through
the same operators.  Every stand-in grows with the tables it reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftcast.operators import calendars as C
from shiftcast.operators import enrich as E
from shiftcast.sources.tables import read_table

SENSORS = {"s_af": ("A", "F"), "s_ao": ("A", "O"), "s_nf": ("N", "F"), "s_no": ("N", "O"),
           "s_rf": ("R", "F"), "s_ro": ("R", "O")}
PRIMARY_SENSOR = "s_rf"
NEARBY_SENSORS = [s for s in SENSORS if s != PRIMARY_SENSOR]


def weather_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Daily weather from lineitem ship days: quantity → temperature, discount →
    rain, tax → wind, discount in thousandths → weather code.  Integer sums
    taken modulo a range keep the values exact (no rounding ties) and varying
    at every scale."""
    li = read_table(spark, sf, "lineitem")
    d = li.groupBy(F.to_date("l_shipdate").alias("date")).agg(
        ((F.sum("l_quantity") % 30) / 2.0).alias("temp_c"),
        ((F.sum(F.round(F.col("l_discount") * 100)) % 13) * 1.0).alias("rain_mm"),
        ((F.sum(F.round(F.col("l_tax") * 100)) % 40) * 1.0).alias("wind_speed_kmh"),
        F.max(F.round(F.col("l_discount") * 1000).cast("int")).alias("weathercode"))
    return d.withColumn("weather_severity_flag", E.severity_flag("weathercode"))


def quarterly_arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """'Q<n> <yyyy>' labels with a total in thousands (orders revenue / 10^6)."""
    o = read_table(spark, sf, "orders")
    return o.groupBy(F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string"), F.lit(" "),
                              F.year("o_orderdate").cast("string")).alias("quarter")) \
        .agg(F.round(F.sum("o_totalprice") / 1e6, 3).alias("total_000"))


def airport_daily(spark: SparkSession, sf: str) -> DataFrame:
    daily = E.quarter_to_daily(quarterly_arrivals(spark, sf), "quarter", "total_000")
    return E.lag_bfill(daily, "airport_arrivals", "airport_arrivals_lag1")


def cruise_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Line items whose part looks like a 'vessel' of interest, per ship day."""
    li = read_table(spark, sf, "lineitem").select("l_partkey", "l_shipdate")
    p = read_table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type")
    match = E.keyword_match("p_name", "p_type", keywords=("RED ", "HOT "), type_word="small")
    return E.keyword_daily_counts(li.join(p, "l_partkey"), "l_shipdate", match)


VENUE_FLAGS = {"aviva_event_flag": ["F"], "croke_park_event_flag": ["O"], "nearby_venue_event_flag": ["P"]}


def event_list(spark: SparkSession, sf: str) -> DataFrame:
    """One event per (order day, priority, status): dimension-sized (≤ 15 a day)."""
    o = read_table(spark, sf, "orders")
    impact = (F.when(F.col("o_orderpriority") == "1-URGENT", "very_high")
              .when(F.col("o_orderpriority") == "2-HIGH", "high")
              .when(F.col("o_orderpriority") == "3-MEDIUM", "medium")
              .when(F.col("o_orderpriority") == "5-LOW", "low").otherwise(F.col("o_orderpriority")))
    return (o.groupBy(F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("event_name"),
                      F.col("o_orderstatus").alias("venue"), impact.alias("impact"))
            .agg(F.min("o_orderkey").alias("seq")))


def events_daily(spark: SparkSession, sf: str) -> DataFrame:
    return C.event_day_rollup(event_list(spark, sf), seq="seq", venue_flags=VENUE_FLAGS)


def order_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Event intervals: order day … day + (key mod 14); pending orders have no
    end (single day), low-priority ones end the day before they start."""
    o = read_table(spark, sf, "orders")
    d = F.to_date("o_orderdate")
    end = (F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("date"))
           .when(F.col("o_orderpriority") == "5-LOW", F.date_sub(d, 1))
           .otherwise(F.date_add(d, (F.col("o_orderkey") % 14).cast("int"))))
    return o.select(d.alias("start_date"), end.alias("end_date"),
                    (F.col("o_orderstatus") == "F").alias("is_free"),
                    F.col("o_orderpriority").startswith("1-").alias("is_festival"))


def failte_daily(spark: SparkSession, sf: str, method: str = "delta") -> DataFrame:
    iv = order_intervals(spark, sf)
    return E.interval_daily_counts(iv, "start_date", "end_date",
                                   {"failte_free_event_count": F.col("is_free"),
                                    "failte_festival_count": F.col("is_festival")},
                                   cap="2030-12-31", method=method)


def sensor_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Daily 'counter' columns: line items per (return flag, line status); NULL when none."""
    li = read_table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_shipdate").alias("timestamp_hour")).agg(
        *[F.sum(F.when((F.col("l_returnflag") == rf) & (F.col("l_linestatus") == ls), 1)).alias(name)
          for name, (rf, ls) in SENSORS.items()])


def events_hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly signals from events over all 24 h: counts and value statistics."""
    ev = read_table(spark, sf, "events")
    from shiftcast.functions.timecols import floor_hour
    return ev.groupBy(floor_hour("ts").alias("timestamp_hour")).agg(
        F.count_if(F.col("event_type") == "view").alias("footfall_views"),
        F.count_if(F.col("event_type") == "click").alias("footfall_clicks"),
        F.count_if(F.col("event_type") == "error").alias("n_errors"),
        ((F.sum(F.round(F.col("value") * 100)) % 3000) / 100.0).alias("temp_c"),
        F.round(F.sum("value") / 2, 4).alias("sales_total"))


def footfall_hourly(spark: SparkSession, sf: str) -> DataFrame:
    """The sensor block of ``sensor_panel`` (one row per ship day)."""
    from shiftcast.operators.footfall import footfall_features

    return footfall_features(sensor_panel(spark, sf), PRIMARY_SENSOR, NEARBY_SENSORS)


def weather_by_ts(spark: SparkSession, sf: str) -> DataFrame:
    w = weather_daily(spark, sf)
    return w.select(F.col("date").cast("timestamp_ntz").alias("timestamp_hour"), "temp_c", "rain_mm",
                    "wind_speed_kmh", "weather_severity_flag")
