"""Registered queries for survey 2.D (enrichment) and 2.E (sensor panel)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftcast.operators import calendars as C
from shiftcast.operators import enrich as E
from shiftcast.operators import footfall as FF
from shiftcast.functions import calendar as CAL
from shiftcast.plans import sqlstandins as SQ
from shiftcast.plans.calendar_queries import CAL_COLUMNS_SQL
from shiftcast.plans.sqlpanels import P1, P2, with_panels
from shiftcast.registry import register
from shiftcast.sources import standins as ST
from shiftcast.sources.tables import panel_p1, panel_p2, read_table

TS = "timestamp_hour"


@register("severity_flag", sql=SQ.WEATHER_DAILY)
def q_severity_flag(spark, sf):
    return ST.weather_daily(spark, sf)


@register("ffill_bfill", sql="""
WITH h AS (SELECT event_type, date_trunc('hour', ts) AS timestamp_hour,
                  max(CASE WHEN value > 100 THEN value END) AS temp_c,
                  max(CASE WHEN value < 5 THEN value END) AS rain_mm
           FROM events GROUP BY 1, 2)
SELECT event_type, timestamp_hour,
  coalesce(last_value(temp_c IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY timestamp_hour
                                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           first_value(temp_c IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY timestamp_hour
                                                  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS temp_c,
  coalesce(last_value(rain_mm IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY timestamp_hour
                                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           first_value(rain_mm IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY timestamp_hour
                                                   ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS rain_mm
FROM h""")
def q_ffill_bfill(spark, sf):
    from shiftcast.functions.timecols import floor_hour

    ev = read_table(spark, sf, "events")
    h = ev.groupBy("event_type", floor_hour("ts").alias(TS)).agg(
        F.max(F.when(F.col("value") > 100, F.col("value"))).alias("temp_c"),
        F.max(F.when(F.col("value") < 5, F.col("value"))).alias("rain_mm"))
    return E.ffill_bfill(h, ["temp_c", "rain_mm"], keys=["event_type"], order=TS)


@register("quarter_to_daily", sql=f"SELECT date, airport_arrivals FROM ({SQ.AIRPORT_DAILY})")
def q_quarter_to_daily(spark, sf):
    return E.quarter_to_daily(ST.quarterly_arrivals(spark, sf), "quarter", "total_000")


@register("lag_bfill", sql=SQ.AIRPORT_DAILY)
def q_lag_bfill(spark, sf):
    return ST.airport_daily(spark, sf)


@register("keyword_daily_counts", sql=SQ.CRUISE_DAILY)
def q_keyword_daily_counts(spark, sf):
    return ST.cruise_daily(spark, sf)


_GEO_PTS = """SELECT s_suppkey, 53.3434 + ((s_suppkey % 100) - 50) / 1000.0 AS lat,
                     -6.2601 + (s_nationkey - 12) / 100.0 AS lon FROM supplier"""


@register("geo_radius", sql=f"""
SELECT s_suppkey, round(d, 6) AS dist_km FROM (
  SELECT s_suppkey, 6371.0 * 2 * atan2(sqrt(a), sqrt(1 - a)) AS d FROM (
    SELECT s_suppkey, sin(radians(lat - 53.3434) / 2) ^ 2
           + cos(radians(53.3434)) * cos(radians(lat)) * sin(radians(lon + 6.2601) / 2) ^ 2 AS a
    FROM ({_GEO_PTS}) p) x) y
WHERE d <= 5.0""")
def q_geo_radius(spark, sf):
    s = read_table(spark, sf, "supplier")
    pts = s.select("s_suppkey", (53.3434 + ((F.col("s_suppkey") % 100) - 50) / 1000.0).alias("lat"),
                   (-6.2601 + (F.col("s_nationkey") - 12) / 100.0).alias("lon"))
    return E.geo_radius(pts, "lat", "lon").select("s_suppkey", F.round("dist_km", 6).alias("dist_km"))


@register("interval_daily_counts", sql=SQ.FAILTE_DAILY)
def q_interval_daily_counts(spark, sf):
    return ST.failte_daily(spark, sf, method="delta")


@register("names_per_day", sql="""
SELECT date, string_agg(c_mktsegment, ' | ' ORDER BY seq) AS event_names, 1 AS event_flag
FROM (SELECT CAST(o_orderdate AS DATE) AS date, c_mktsegment, min(o_orderkey) AS seq
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) x
GROUP BY date""")
def q_names_per_day(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    # one name per (day, segment): a dimension-sized list (≤ 5 names a day)
    pre = (o.join(c, "o_custkey").groupBy(F.to_date("o_orderdate").alias("date"), "c_mktsegment")
           .agg(F.min("o_orderkey").alias("seq")))
    return E.names_per_day(pre, "date", "c_mktsegment", "seq")


def enrichment_table(spark, sf):
    """D9–D11: order-date spine (+7 days) with airport, port, holiday, event and calendar signals."""
    o = read_table(spark, sf, "orders")
    spine = C.date_spine(o.agg(F.min("o_orderdate").alias("start"), F.max("o_orderdate").alias("end")),
                         extra_days=7)
    cal = spine.select("date", CAL.bank_holiday_flag("date").alias("bank_holiday_flag"),
                       CAL.school_holiday_flag("date").alias("school_holiday_flag"),
                       CAL.college_term_flag("date").alias("college_term_flag"),
                       CAL.payday_flag("date").alias("payday_period_flag"),
                       CAL.days_from_payday("date").alias("days_from_payday"),
                       *[c.alias(k) for k, c in CAL.annual_flags("date").items()])
    tables = [ST.airport_daily(spark, sf), ST.cruise_daily(spark, sf), ST.events_daily(spark, sf)]
    return E.enrich_spine(cal, tables, zero_int=("ships_in_port_count", "cruise_passenger_estimate",
                                                 "days_from_payday"),
                          fill_forward=("airport_arrivals", "airport_arrivals_lag1"), unique=True)  # each is grouped by its date


ENRICH_SQL = f"""
WITH b AS (SELECT min(CAST(o_orderdate AS DATE)) AS s, max(CAST(o_orderdate AS DATE)) + 7 AS e FROM orders),
spine AS (SELECT CAST(unnest(generate_series(s, e, INTERVAL 1 DAY)) AS DATE) AS date FROM b),
{CAL_COLUMNS_SQL},
j AS (SELECT c.*, a.airport_arrivals, a.airport_arrivals_lag1, cr.cruise_ship_flag AS cf,
             cr.ships_in_port_count AS sc, cr.cruise_passenger_estimate AS pe,
             ev.aviva_event_flag AS af, ev.croke_park_event_flag AS cpf, ev.nearby_venue_event_flag AS nf,
             ev.city_event_flag AS cef, ev.event_impact_score AS eis, ev.event_names
      FROM calcols c LEFT JOIN ({SQ.AIRPORT_DAILY}) a USING (date) LEFT JOIN ({SQ.CRUISE_DAILY}) cr USING (date)
      LEFT JOIN ({SQ.EVENTS_DAILY}) ev USING (date))
SELECT date, bank_holiday_flag, school_holiday_flag, college_term_flag, payday_period_flag, days_from_payday,
  st_patricks_week_flag, bloomsday_flag, bloomsday_week_flag, summer_tourism_flag, christmas_market_flag,
  new_years_eve_flag, new_years_day_flag,
  CAST(coalesce(coalesce(last_value(airport_arrivals IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                         first_value(airport_arrivals IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 0) AS BIGINT) AS airport_arrivals,
  CAST(coalesce(coalesce(last_value(airport_arrivals_lag1 IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                         first_value(airport_arrivals_lag1 IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 0) AS BIGINT) AS airport_arrivals_lag1,
  CAST(coalesce(cf, 0) AS INTEGER) AS cruise_ship_flag, CAST(coalesce(sc, 0) AS INTEGER) AS ships_in_port_count,
  CAST(coalesce(pe, 0) AS INTEGER) AS cruise_passenger_estimate,
  CAST(coalesce(af, 0) AS INTEGER) AS aviva_event_flag, CAST(coalesce(cpf, 0) AS INTEGER) AS croke_park_event_flag,
  CAST(coalesce(nf, 0) AS INTEGER) AS nearby_venue_event_flag, CAST(coalesce(cef, 0) AS INTEGER) AS city_event_flag,
  coalesce(eis, 0) AS event_impact_score, event_names,
  CAST(coalesce(af, 0) + coalesce(cpf, 0) > 0 AS INTEGER) AS major_sports_event_flag
FROM j"""


@register("enrich_spine", sql=ENRICH_SQL)
def q_enrich_spine(spark, sf):
    return enrichment_table(spark, sf)


@register("merge_daily_replace", sql=with_panels("""
SELECT p.c_mktsegment, p.timestamp_hour, p.orders_count, p.food_tickets_count,
       w.temp_c, w.rain_mm, w.sales_total
FROM p LEFT JOIN (SELECT CAST(l_shipdate AS DATE) AS date, (sum(l_quantity) % 30) / 2.0 AS temp_c,
                         CAST(sum(round(l_discount * 100)) % 13 AS DOUBLE) AS rain_mm,
                         round(sum(l_extendedprice), 2) AS sales_total
                  FROM lineitem GROUP BY 1) w ON w.date = CAST(p.timestamp_hour AS DATE)""", p=P2))
def q_merge_daily_replace(spark, sf):
    li = read_table(spark, sf, "lineitem")
    daily = li.groupBy(F.to_date("l_shipdate").alias("date")).agg(
        ((F.sum("l_quantity") % 30) / 2.0).alias("temp_c"),
        ((F.sum(F.round(F.col("l_discount") * 100)) % 13) * 1.0).alias("rain_mm"),
        F.round(F.sum("l_extendedprice"), 2).alias("sales_total"))
    return E.merge_daily_replace(panel_p2(spark, sf), daily)


@register("merge_hourly", sql=with_panels(f"""
SELECT p.timestamp_hour, p.orders_count,
       coalesce(CAST(f.footfall_views AS DOUBLE), 0.0) AS footfall_views,
       coalesce(CAST(f.footfall_clicks AS DOUBLE), 0.0) AS footfall_clicks,
       w.temp_c, w.sales_total
FROM p
LEFT JOIN (SELECT timestamp_hour, footfall_views, footfall_clicks FROM ({SQ.EVENTS_HOURLY})) f
  USING (timestamp_hour)
LEFT JOIN (SELECT timestamp_hour, temp_c, sales_total FROM ({SQ.EVENTS_HOURLY})) w USING (timestamp_hour)""", p=P1))
def q_merge_hourly(spark, sf):
    h = ST.events_hourly(spark, sf)
    foot = h.select(TS, "footfall_views", "footfall_clicks")
    wx = h.select(TS, "temp_c", "sales_total")
    out = E.merge_hourly(panel_p1(spark, sf), foot, wx)
    out = E.coerce_zero_fill(out, ["footfall_views", "footfall_clicks"])
    return out.select(TS, "orders_count", "footfall_views", "footfall_clicks", "temp_c", "sales_total")


@register("zscore", sql=with_panels("""
SELECT c_mktsegment, timestamp_hour,
  round(CASE WHEN sd > 0 THEN (orders_count - mu) / sd END, 6) AS orders_zscore
FROM p JOIN (SELECT c_mktsegment, avg(orders_count) AS mu, stddev_samp(orders_count) AS sd FROM p GROUP BY 1) s
  USING (c_mktsegment)""", p=P2))
def q_zscore(spark, sf):
    z = E.zscore(panel_p2(spark, sf), "orders_count", "orders_zscore", keys=["c_mktsegment"])
    return z.select("c_mktsegment", TS, F.round("orders_zscore", 6).alias("orders_zscore"))


@register("zscore_asof", sql=with_panels("""
SELECT c_mktsegment, timestamp_hour,
  round(CASE WHEN sd > 0 THEN (orders_count - mu) / sd END, 6) AS orders_zscore_asof
FROM (SELECT *, avg(orders_count) OVER w AS mu, stddev_samp(orders_count) OVER w AS sd FROM p
      WINDOW w AS (PARTITION BY c_mktsegment ORDER BY timestamp_hour
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""", p=P2))
def q_zscore_asof(spark, sf):
    z = E.zscore_asof(panel_p2(spark, sf), "orders_count", "orders_zscore_asof", keys=["c_mktsegment"], order=TS)
    return z.select("c_mktsegment", TS, F.round("orders_zscore_asof", 6).alias("orders_zscore_asof"))


# --- 2.E sensor panel ---------------------------------------------------------------

@register("rowwise_mean_sum", sql=f"SELECT timestamp_hour, nearby_footfall_avg, nearby_footfall_sum FROM ({SQ.SENSOR_E1})")
def q_rowwise_mean_sum(spark, sf):
    out = FF.rowwise_mean_sum(ST.sensor_panel(spark, sf), ST.NEARBY_SENSORS)
    return out.select(TS, "nearby_footfall_avg", "nearby_footfall_sum")


_IMPUTE_SQL = f"""
WITH e1 AS ({SQ.SENSOR_E1}),
st AS (SELECT count({ST.PRIMARY_SENSOR}) AS n_live,
              median(CASE WHEN {ST.PRIMARY_SENSOR} IS NOT NULL AND nearby_footfall_avg > 0
                          THEN {ST.PRIMARY_SENSOR} / nearby_footfall_avg END) AS scale FROM e1)
SELECT timestamp_hour, CAST({ST.PRIMARY_SENSOR} IS NOT NULL AS INTEGER) AS suffolk_counter_is_live,
  CAST(trunc(coalesce(CASE WHEN n_live > 100
                           THEN coalesce(CAST({ST.PRIMARY_SENSOR} AS DOUBLE), round_even(nearby_footfall_avg * scale, 0))
                           ELSE nearby_footfall_avg END, 0)) AS BIGINT) AS suffolk_nassau_footfall
FROM e1, st"""


@register("ratio_impute", sql=_IMPUTE_SQL)
def q_ratio_impute(spark, sf):
    e1 = FF.rowwise_mean_sum(ST.sensor_panel(spark, sf), ST.NEARBY_SENSORS)
    out = FF.ratio_impute(e1, ST.PRIMARY_SENSOR, "nearby_footfall_avg")
    return out.select(TS, "suffolk_counter_is_live", "suffolk_nassau_footfall")


def _e1_filled(spark, sf):
    e1 = FF.rowwise_mean_sum(ST.sensor_panel(spark, sf), ST.NEARBY_SENSORS)
    return e1.withColumn("_s", F.coalesce(F.col("nearby_footfall_avg"), F.lit(0.0)))


@register("row_lags_filled", sql=f"""
SELECT timestamp_hour,
  CAST(round_even(coalesce(lag(s, 1) OVER w, 0), 0) AS BIGINT) AS suffolk_footfall_lag_1h,
  CAST(round_even(coalesce(lag(s, 24) OVER w, 0), 0) AS BIGINT) AS suffolk_footfall_lag_24h,
  CAST(round_even(coalesce(lag(s, 168) OVER w, 0), 0) AS BIGINT) AS suffolk_footfall_lag_168h
FROM (SELECT *, coalesce(nearby_footfall_avg, 0) AS s FROM ({SQ.SENSOR_E1})) x
WINDOW w AS (ORDER BY timestamp_hour)""")
def q_row_lags_filled(spark, sf):
    out = FF.row_lags_filled(_e1_filled(spark, sf), "_s")
    return out.select(TS, "suffolk_footfall_lag_1h", "suffolk_footfall_lag_24h", "suffolk_footfall_lag_168h")


@register("rolling_24_min4", sql=f"""
SELECT timestamp_hour,
  CASE WHEN count(s) OVER w >= 4
       THEN round_even(sum(CAST(round(s * 10) AS BIGINT)) OVER w / (count(s) OVER w * 10.0), 1) END
    AS suffolk_footfall_roll_24h
FROM (SELECT *, coalesce(nearby_footfall_avg, 0) AS s FROM ({SQ.SENSOR_E1})) x
WINDOW w AS (ORDER BY timestamp_hour ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)""")
def q_rolling_24_min4(spark, sf):
    return FF.rolling_mean_min(_e1_filled(spark, sf), "_s").select(TS, "suffolk_footfall_roll_24h")


@register("busy_flag_p70", sql=f"""
WITH e1 AS (SELECT *, (isodow(timestamp_hour) - 1) * 24 + hour(timestamp_hour) AS how FROM ({SQ.SENSOR_E1}))
SELECT timestamp_hour, CAST(coalesce(nearby_footfall_avg > p, false) AS INTEGER) AS suffolk_is_busy_flag
FROM e1 LEFT JOIN (SELECT how, quantile_cont(nearby_footfall_avg, 0.7) AS p FROM e1 GROUP BY 1) q USING (how)""")
def q_busy_flag_p70(spark, sf):
    e1 = FF.rowwise_mean_sum(ST.sensor_panel(spark, sf), ST.NEARBY_SENSORS)
    return FF.busy_flag(e1, "nearby_footfall_avg").select(TS, "suffolk_is_busy_flag")


@register("busy_flag_p70_asof", sql=f"""
WITH e1 AS (SELECT *, (isodow(timestamp_hour) - 1) * 24 + hour(timestamp_hour) AS how FROM ({SQ.SENSOR_E1}))
SELECT timestamp_hour,
  CAST(coalesce(nearby_footfall_avg > quantile_cont(nearby_footfall_avg, 0.7) OVER (
         PARTITION BY how ORDER BY timestamp_hour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS INTEGER)
    AS suffolk_is_busy_flag
FROM e1""")
def q_busy_flag_p70_asof(spark, sf):
    e1 = FF.rowwise_mean_sum(ST.sensor_panel(spark, sf), ST.NEARBY_SENSORS)
    return FF.busy_flag(e1, "nearby_footfall_avg", asof=True).select(TS, "suffolk_is_busy_flag")
