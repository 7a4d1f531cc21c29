"""Registered queries for features known at the origin, next-day and scenario scoring (survey F8, H13, H14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftcast.operators import features as FT
from shiftcast.operators import horizon as H
from shiftcast.operators import models as M
from shiftcast.plans import incremental as I
from shiftcast.plans.feature_queries import _r6, _roll_sql
from shiftcast.plans.forecast_queries import _HOURS
from shiftcast.plans.model_queries import TARGET, _features, _tail, p1_model_table
from shiftcast.plans.segment_queries import _case
from shiftcast.plans.sqlpanels import P1, P1K, P2, with_panels
from shiftcast.registry import register
from shiftcast.session import cut_lineage
from shiftcast.sources.tables import panel_p1, panel_p2, read_table

TS = "timestamp_hour"
K = ["event_type"]
SEGMENT = ["c_mktsegment"]


def price_outlook(spark, sf):
    """A signal in versions: what orders known by a day say of a day up to four days later."""
    o = read_table(spark, sf, "orders")
    ahead = (F.col("o_orderkey") % 5).cast("int")
    return (o.groupBy(F.timestamp_add("DAY", ahead, F.col("o_orderdate")).alias("valid_day"), F.col("o_orderdate").alias("known_at"))
            .agg(F.count(F.lit(1)).alias("outlook_orders"), F.max("o_orderkey").alias("outlook_key")))


@register("point_in_time_signal", sql=with_panels("""
SELECT c_mktsegment, timestamp_hour, orders_count, outlook_orders, outlook_key FROM (
  SELECT p.c_mktsegment, p.timestamp_hour, p.orders_count, v.outlook_orders, v.outlook_key,
         row_number() OVER (PARTITION BY p.c_mktsegment, p.timestamp_hour ORDER BY v.known_at DESC NULLS LAST) AS rn
  FROM p LEFT JOIN v ON v.valid_day = p.timestamp_hour AND v.known_at <= CAST(CAST(p.timestamp_hour AS DATE) AS TIMESTAMP) - INTERVAL 6 HOUR)
WHERE rn = 1""", ctes="""
v AS (SELECT o_orderdate + to_days(CAST(o_orderkey % 5 AS INTEGER)) AS valid_day, o_orderdate AS known_at,
             count(*) AS outlook_orders, max(o_orderkey) AS outlook_key FROM orders GROUP BY 1, 2)""", p=P2))
def q_point_in_time_signal(spark, sf):
    out = H.point_in_time(panel_p2(spark, sf), price_outlook(spark, sf), H.evening_before(TS), ["outlook_orders", "outlook_key"], SEGMENT, TS, "valid_day")
    return out.select(*SEGMENT, TS, "orders_count", "outlook_orders", "outlook_key")


_ORIGIN_SPEC = {"roll_mean_24": (24, "mean"), "roll_std_24": (24, "std"), "roll_mean_168": (168, "mean")}


def _origin_sql(value: str) -> str:
    out = []
    for name, (w, how) in _ORIGIN_SPEC.items():
        fn = {"mean": "avg", "std": "stddev_samp"}[how]
        frame = f"OVER (PARTITION BY event_type ORDER BY timestamp_hour ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
        out.append(f"CASE WHEN count({value}) {frame} >= {w // 4} THEN {fn}({value}) {frame} END AS {value}_{name}")
    return ", ".join(out)


@register("origin_statistics", sql=with_panels("""
SELECT event_type, timestamp_hour, round(orders_count_roll_mean_24, 6) AS orders_count_roll_mean_24,
       round(orders_count_roll_std_24, 6) AS orders_count_roll_std_24, round(orders_count_roll_mean_168, 6) AS orders_count_roll_mean_168
FROM (SELECT p.event_type, p.timestamp_hour, s.orders_count_roll_mean_24, s.orders_count_roll_std_24, s.orders_count_roll_mean_168
      FROM p ASOF LEFT JOIN s ON s.event_type = p.event_type
        AND s.timestamp_hour <= CAST(CAST(p.timestamp_hour AS DATE) AS TIMESTAMP) - INTERVAL 6 HOUR)""",
                                               ctes=f"s AS (SELECT event_type, timestamp_hour, {_origin_sql('orders_count')} FROM p)", p=P1K))
def q_origin_statistics(spark, sf):
    p = panel_p1(spark, sf, keyed=True)
    out = H.origin_statistics(p.select(*K, TS), p, "orders_count", H.evening_before(TS), K, TS, _ORIGIN_SPEC)
    return out.select(*K, TS, *_r6([f"orders_count_{n}" for n in _ORIGIN_SPEC]))


def _lags(df):
    df = FT.rolling_stats(FT.clock_lags(df, "orders_count", (24, 48, 168, 336), K), "orders_count", FT.ROLLING, K)
    return FT.same_slot_mean(df, "orders_count", 4, K)


_LAGS = ", ".join(f"max(orders_count) OVER (PARTITION BY event_type ORDER BY timestamp_hour RANGE BETWEEN INTERVAL {h} HOURS PRECEDING "
                  f"AND INTERVAL {h} HOURS PRECEDING) AS {n}" for h, n in ((24, "orders_count_lag_24h"), (48, "orders_count_lag_48h"), (168, "orders_count_lag_168h"),
                                                                         (336, "orders_count_lag_336h"), (504, "w3"), (672, "w4")))


@register("next_day_features", sql=with_panels(f"""
SELECT event_type, timestamp_hour, sales_total, orders_count_lag_24h, orders_count_lag_48h, orders_count_lag_168h, orders_count_lag_336h,
  round(list_avg(list_filter([orders_count_lag_168h, orders_count_lag_336h, w3, w4], lambda x: x IS NOT NULL)), 6) AS orders_count_same_slot_4w_avg,
  {', '.join(f'orders_count_{n}' for n in FT.ROLLING)}
FROM (SELECT *, {_LAGS}, {_roll_sql('orders_count', True)} FROM b) WHERE is_stub""", ctes=f"""
l AS (SELECT event_type, max(timestamp_hour) AS lt, arg_max(sales_total, timestamp_hour) AS sales_total FROM p GROUP BY 1),
b AS (SELECT event_type, timestamp_hour, orders_count, sales_total, false AS is_stub FROM p
      UNION ALL
      SELECT event_type, CAST(CAST(lt AS DATE) + 1 AS TIMESTAMP) + to_hours(h), NULL, sales_total, true FROM l, (VALUES {_HOURS}) v(h))""", p=P1K))
def q_next_day_features(spark, sf):
    out = H.next_day_features(panel_p1(spark, sf, keyed=True), _lags, K, TS, ["sales_total"])
    return out.select(*K, TS, "sales_total", "orders_count_lag_24h", "orders_count_lag_48h", "orders_count_lag_168h", "orders_count_lag_336h",
                      *_r6(["orders_count_same_slot_4w_avg", *[f"orders_count_{n}" for n in FT.ROLLING]]))


@register("incremental_days", sql=with_panels("""
SELECT DISTINCT date FROM (
  SELECT date, greatest(max(new) OVER (PARTITION BY event_type ORDER BY timestamp_hour ROWS BETWEEN 20 PRECEDING AND CURRENT ROW),
                        max(new) OVER (PARTITION BY event_type ORDER BY timestamp_hour RANGE BETWEEN INTERVAL 36 HOURS PRECEDING AND CURRENT ROW)) AS hit
  FROM (SELECT event_type, timestamp_hour, CAST(timestamp_hour AS DATE) AS date,
               CAST(event_type = 'click' AND day(timestamp_hour) % 9 = 0 AS INTEGER) AS new FROM p))
WHERE hit = 1""", p=P1K))
def q_incremental_days(spark, sf):
    """Days to rebuild after changes of one key on every ninth day of a month, for features that reach back 20 rows or 36 hours."""
    p = panel_p1(spark, sf, keyed=True)
    changed = p.where((F.col("event_type") == "click") & (F.dayofmonth(TS) % 9 == 0)).select("event_type", F.to_date(TS).alias("date"))
    return I.reached_days(p, changed, K, TS, 20, 36)


def _forest(ft):
    return M.fit_segment_models(cut_lineage(_tail(ft)), _features(ft), TARGET, val_col="is_val")


@register("next_day_forecast")
def q_next_day_forecast(spark, sf):
    """The next day of the hourly panel by the routed boosters; signals of the last hour are carried."""
    from shiftcast.plans.feature_table import build_feature_table

    ft = p1_model_table(spark, sf, drop_na=False)
    signals = ["temp_c", "rain_mm", "suffolk_nassau_footfall", "suffolk_footfall_lag_24h"]
    history = ft.select(TS, "orders_count", "food_tickets_count", "sales_total", *[c for c in signals if c in ft.columns])
    day = H.next_day_features(history, lambda df: build_feature_table(df, drop_na=False), (), TS, [c for c in signals if c in ft.columns])
    return M.predict_routed(day, _forest(ft)).select(TS, "model_used", "pred")


# Values that a scenario overrides, by scenario.
SCENARIOS = {"as planned": {}, "heavy rain": {"rain_mm": 12.0, "temp_c": 6.0}, "heat": {"rain_mm": 0.0, "temp_c": 24.5},
             "bank holiday": {"bank_holiday_flag": 1}}


def _scored_scenarios(spark, sf):
    """The last day of the hourly panel under every scenario, scored by models of the days before in one pass."""
    ft = p1_model_table(spark, sf, drop_na=False)
    last = ft.groupBy().agg(F.to_date(F.max(TS)).alias("_day"))
    marked = ft.join(F.broadcast(last)).withColumn("_is_day", F.to_date(TS) == F.col("_day")).drop("_day")
    forest = _forest(marked.where(~F.col("_is_day")).drop("_is_day"))
    return M.predict_routed(H.scenario_rows(marked.where("_is_day").drop("_is_day"), SCENARIOS), forest)


@register("scenario_forecast")
def q_scenario_forecast(spark, sf):
    return _scored_scenarios(spark, sf).select("scenario", TS, "model_used", F.col(TARGET).alias("y"), "pred")


@register("scenario_routes", sql=with_panels(f"""
SELECT s.scenario, p.timestamp_hour, coalesce(CASE WHEN n.n >= 80 THEN {_case('model', 'hour(p.timestamp_hour)')} END, 'global') AS model_used, s.rain_mm
FROM p JOIN d ON CAST(p.timestamp_hour AS DATE) = d.day
CROSS JOIN (VALUES ('as planned', NULL), ('heavy rain', 12.0::DOUBLE), ('heat', 0.0::DOUBLE), ('bank holiday', NULL)) s(scenario, rain_mm)
LEFT JOIN n ON n.seg = {_case('model', 'hour(p.timestamp_hour)')}""", ctes=f"""
d AS (SELECT CAST(max(timestamp_hour) AS DATE) AS day FROM p),
n AS (SELECT {_case('model', 'hour(timestamp_hour)')} AS seg, count(*) AS n FROM p, d WHERE CAST(timestamp_hour AS DATE) < d.day GROUP BY 1)""", p=P1))
def q_scenario_routes(spark, sf):
    """Which model scores each hour of each scenario, and the value it sees."""
    out = _scored_scenarios(spark, sf)
    return out.select("scenario", TS, "model_used", F.when(F.col("scenario").isin("heavy rain", "heat"), F.col("rain_mm")).alias("rain_mm"))
