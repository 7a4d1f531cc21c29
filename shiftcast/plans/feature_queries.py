"""Registered queries for survey 2.F (leakage-safe features)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftcast.operators import features as FT
from shiftcast.plans.sqlpanels import P1, P1K, with_panels
from shiftcast.registry import register
from shiftcast.sources.tables import panel_p1

K = ["event_type"]
TS = "timestamp_hour"


def _r6(cols):
    return [F.round(c, 6).alias(c) for c in cols]


def _round6(c):
    """``round(c, 6) + 0.0``; whole numbers, most of the signals, skip the costly decimal rounding."""
    return F.when(F.rint(c) == F.col(c), F.col(c)).otherwise(F.round(c, 6)) + F.lit(0.0)


@register("row_lags", sql=with_panels("""
SELECT event_type, timestamp_hour, orders_count,
  lag(orders_count, 1) OVER w AS orders_count_lag_1,
  lag(orders_count, 2) OVER w AS orders_count_lag_2,
  lag(orders_count, 3) OVER w AS orders_count_lag_3
FROM p WINDOW w AS (PARTITION BY event_type ORDER BY timestamp_hour)""", p=P1K))
def q_row_lags(spark, sf):
    out = FT.row_lags(panel_p1(spark, sf, keyed=True), "orders_count", (1, 2, 3), K)
    return out.select(*K, TS, "orders_count", "orders_count_lag_1", "orders_count_lag_2", "orders_count_lag_3")


_CLOCK_SQL = """
SELECT p.event_type, p.timestamp_hour, p.orders_count,
  a.orders_count AS orders_count_lag_24h, b.orders_count AS orders_count_lag_48h,
  c.orders_count AS orders_count_lag_168h, d.orders_count AS orders_count_lag_336h
FROM p
LEFT JOIN p a ON a.event_type = p.event_type AND a.timestamp_hour = p.timestamp_hour - INTERVAL 24 HOUR
LEFT JOIN p b ON b.event_type = p.event_type AND b.timestamp_hour = p.timestamp_hour - INTERVAL 48 HOUR
LEFT JOIN p c ON c.event_type = p.event_type AND c.timestamp_hour = p.timestamp_hour - INTERVAL 168 HOUR
LEFT JOIN p d ON d.event_type = p.event_type AND d.timestamp_hour = p.timestamp_hour - INTERVAL 336 HOUR"""


@register("clock_lags", sql=with_panels(_CLOCK_SQL, p=P1K))
def q_clock_lags(spark, sf):
    out = FT.clock_lags(panel_p1(spark, sf, keyed=True), "orders_count", (24, 48, 168, 336), K)
    return out.select(*K, TS, "orders_count", "orders_count_lag_24h", "orders_count_lag_48h",
                      "orders_count_lag_168h", "orders_count_lag_336h")


@register("same_slot_4w", sql=with_panels("""
SELECT p.event_type, p.timestamp_hour,
  round(list_avg(list_filter([w1.food_tickets_count, w2.food_tickets_count, w3.food_tickets_count,
                              w4.food_tickets_count], lambda x: x IS NOT NULL)), 6) AS food_tickets_count_same_slot_4w_avg
FROM p
LEFT JOIN p w1 ON w1.event_type = p.event_type AND w1.timestamp_hour = p.timestamp_hour - INTERVAL 7 DAY
LEFT JOIN p w2 ON w2.event_type = p.event_type AND w2.timestamp_hour = p.timestamp_hour - INTERVAL 14 DAY
LEFT JOIN p w3 ON w3.event_type = p.event_type AND w3.timestamp_hour = p.timestamp_hour - INTERVAL 21 DAY
LEFT JOIN p w4 ON w4.event_type = p.event_type AND w4.timestamp_hour = p.timestamp_hour - INTERVAL 28 DAY""",
                                            p=P1K))
def q_same_slot_4w(spark, sf):
    out = FT.same_slot_mean(panel_p1(spark, sf, keyed=True), "food_tickets_count", 4, K)
    return out.select(*K, TS, F.round("food_tickets_count_same_slot_4w_avg", 6)
                      .alias("food_tickets_count_same_slot_4w_avg"))


def _roll_sql(value: str, keyed: bool) -> str:
    part = "PARTITION BY event_type " if keyed else ""
    parts = []
    for name, (w, how) in FT.ROLLING.items():
        fn = {"mean": "avg", "std": "stddev_samp", "max": "max"}[how]
        frame = f"OVER ({part}ORDER BY timestamp_hour ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
        parts.append(f"round(CASE WHEN count({value}) {frame} >= {max(1, w // 4)} "
                     f"THEN {fn}({value}) {frame} END, 6) AS {value}_{name}")
    return ",\n  ".join(parts)


_ROLL_COLS = [f"orders_count_{n}" for n in FT.ROLLING]


@register("rolling_stats", sql=with_panels(f"""
SELECT event_type, timestamp_hour, {_roll_sql('orders_count', True)} FROM p""", p=P1K))
def q_rolling_stats(spark, sf):
    out = FT.rolling_stats(panel_p1(spark, sf, keyed=True), "orders_count", FT.ROLLING, K)
    return out.select(*K, TS, *_r6(_ROLL_COLS))


def _all_lag_roll_sql(value: str) -> str:
    return f"""
  lag({value}, 1) OVER w AS {value}_lag_1, lag({value}, 2) OVER w AS {value}_lag_2,
  lag({value}, 3) OVER w AS {value}_lag_3,
  max({value}) OVER (ORDER BY timestamp_hour RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND INTERVAL 24 HOURS PRECEDING) AS {value}_lag_24h,
  max({value}) OVER (ORDER BY timestamp_hour RANGE BETWEEN INTERVAL 48 HOURS PRECEDING AND INTERVAL 48 HOURS PRECEDING) AS {value}_lag_48h,
  max({value}) OVER (ORDER BY timestamp_hour RANGE BETWEEN INTERVAL 168 HOURS PRECEDING AND INTERVAL 168 HOURS PRECEDING) AS {value}_lag_168h,
  max({value}) OVER (ORDER BY timestamp_hour RANGE BETWEEN INTERVAL 336 HOURS PRECEDING AND INTERVAL 336 HOURS PRECEDING) AS {value}_lag_336h,
  {_roll_sql(value, False)}"""


@register("warmup_drop", sql=with_panels(f"""
SELECT timestamp_hour, orders_count, orders_count_lag_336h, orders_count_roll_mean_168, orders_count_roll_std_24
FROM (SELECT timestamp_hour, orders_count, {_all_lag_roll_sql('orders_count')}
      FROM p WINDOW w AS (ORDER BY timestamp_hour)) f
WHERE orders_count_lag_1 IS NOT NULL AND orders_count_lag_2 IS NOT NULL AND orders_count_lag_3 IS NOT NULL
  AND orders_count_lag_24h IS NOT NULL AND orders_count_lag_48h IS NOT NULL
  AND orders_count_lag_168h IS NOT NULL AND orders_count_lag_336h IS NOT NULL
  AND {' AND '.join(f'{c} IS NOT NULL' for c in _ROLL_COLS)}""", p=P1))
def q_warmup_drop(spark, sf):
    p = panel_p1(spark, sf).select(TS, "orders_count")
    f = FT.add_rolling_features(FT.add_lag_features(p, "orders_count"), "orders_count")
    kept = FT.warmup_drop(f)
    return kept.select(TS, "orders_count", "orders_count_lag_336h",
                       *_r6(["orders_count_roll_mean_168", "orders_count_roll_std_24"]))


def p3_feature_table(spark, sf, drop_na: bool = False):
    """F7 on the keyed bench panel (supplier × ship day).  The daily series are
    sparse, so the warm-up drop would remove almost every row: it is off here
    and exercised on the hourly panel by ``warmup_drop``."""
    from shiftcast.operators.enrich import MAX_DAYS
    from shiftcast.plans.enrich_queries import enrichment_table
    from shiftcast.plans.feature_table import build_feature_table
    from shiftcast.sources import standins as ST
    from shiftcast.sources.tables import panel_p3, read_table

    # each signal is grouped by its ship day or calendar day, so it has one row for each
    return build_feature_table(panel_p3(spark, sf), keys=["l_suppkey"], enrichment=enrichment_table(spark, sf),
                               failte=ST.failte_daily(spark, sf), footfall=ST.footfall_hourly(spark, sf),
                               weather=ST.weather_by_ts(spark, sf), drop_na=drop_na,
                               signal_rows=MAX_DAYS, daily_rows=MAX_DAYS, unique_signals=True,
                               panel_rows=read_table(spark, sf, "lineitem").count())  # at most one panel row a line item


def _feature_table_sql() -> str:
    from shiftcast.plans import sqlstandins as SQ
    from shiftcast.plans.calendar_queries import CAL_COLUMNS_SQL
    from shiftcast.plans.enrich_queries import ENRICH_SQL
    from shiftcast.plans.sqlpanels import P3

    ff_cols = ["suffolk_nassau_footfall", "suffolk_counter_is_live", "nearby_footfall_avg", "nearby_footfall_sum",
               "city_footfall_zscore", "suffolk_footfall_lag_1h", "suffolk_footfall_lag_24h",
               "suffolk_footfall_lag_168h", "suffolk_footfall_roll_24h", "suffolk_is_busy_flag"]
    enr_int = ["school_holiday_flag", "college_term_flag", "payday_period_flag", "days_from_payday",
               "st_patricks_week_flag", "bloomsday_flag", "bloomsday_week_flag", "summer_tourism_flag",
               "christmas_market_flag", "new_years_eve_flag", "new_years_day_flag", "cruise_ship_flag",
               "ships_in_port_count", "cruise_passenger_estimate", "aviva_event_flag", "croke_park_event_flag",
               "nearby_venue_event_flag", "city_event_flag", "event_impact_score", "major_sports_event_flag"]
    offs = (24, 48, 168, 336, 504, 672)
    base_cols = ",\n    ".join(
        [f"coalesce(e.{c}, 0) AS {c}" for c in enr_int]
        + ["coalesce(e.airport_arrivals, 0) AS airport_arrivals",
           "coalesce(e.airport_arrivals_lag1, 0) AS airport_arrivals_lag1", "e.event_names",
           "CAST(coalesce(fl.failte_event_count, 0) AS INTEGER) AS failte_event_count",
           "CAST(coalesce(fl.failte_free_event_count, 0) AS INTEGER) AS failte_free_event_count",
           "CAST(coalesce(fl.failte_festival_count, 0) AS INTEGER) AS failte_festival_count"]
        + [f"coalesce(CAST(ff.{c} AS DOUBLE), 0.0) AS {c}" for c in ff_cols]
        + ["coalesce(wx.temp_c, 0.0) AS temp_c", "coalesce(wx.rain_mm, 0.0) AS rain_mm",
           "coalesce(wx.wind_speed_kmh, 0.0) AS wind_speed_kmh",
           "coalesce(wx.weather_severity_flag, 0) AS weather_severity_flag",
           "c.bank_holiday_flag",
           "CAST(hour(p.timestamp_hour) AS INTEGER) AS hour", "CAST(isodow(p.timestamp_hour) - 1 AS INTEGER) AS weekday",
           "CAST(month(p.timestamp_hour) AS INTEGER) AS month", "CAST(quarter(p.timestamp_hour) AS INTEGER) AS quarter",
           "CAST(weekofyear(p.timestamp_hour) AS INTEGER) AS week_of_year"]
        + [f"q{o}.orders_count AS o{o}, q{o}.food_tickets_count AS f{o}" for o in offs])
    joins = "\n".join(
        f"  LEFT JOIN p q{o} ON q{o}.l_suppkey = p.l_suppkey AND q{o}.timestamp_hour = p.timestamp_hour - INTERVAL {o} HOUR"
        for o in offs)
    win = "PARTITION BY l_suppkey ORDER BY timestamp_hour"

    def per_target(t: str, pre: str) -> list[str]:
        out = [f"lag({t}, {n}) OVER (w) AS {t}_lag_{n}" for n in (1, 2, 3)]
        out += [f"{pre}{o} AS {t}_lag_{o}h" for o in (24, 48, 168, 336)]
        lst = ", ".join(f"{pre}{o}" for o in (168, 336, 504, 672))
        out.append(f"round(list_avg(list_filter([{lst}], lambda x: x IS NOT NULL)), 6) + 0.0 AS {t}_same_slot_4w_avg")
        for name, (w, how) in FT.ROLLING.items():
            fn = {"mean": "avg", "std": "stddev_samp", "max": "max"}[how]
            frame = f"OVER ({win} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
            expr = f"CASE WHEN count({t}) {frame} >= {max(1, w // 4)} THEN {fn}({t}) {frame} END"
            out.append(f"{'round(' + expr + ', 6) + 0.0' if how != 'max' else expr} AS {t}_{name}")
        return out

    cyc = []
    for part, period in (("hour", 24), ("weekday", 7), ("month", 12)):
        cyc += [f"round(sin(2 * pi() * {part} / {period}), 6) + 0.0 AS {part}_sin",
                f"round(cos(2 * pi() * {part} / {period}), 6) + 0.0 AS {part}_cos"]
    final = ",\n  ".join(
        ["l_suppkey", "timestamp_hour", "orders_count", "food_tickets_count", "sales_total",
         "bank_holiday_flag", *enr_int, "airport_arrivals", "airport_arrivals_lag1", "event_names",
         "failte_event_count", "failte_free_event_count", "failte_festival_count",
         *[f"round({c}, 6) + 0.0 AS {c}" for c in ff_cols],
         "round(temp_c, 6) + 0.0 AS temp_c", "round(rain_mm, 6) + 0.0 AS rain_mm",
         "round(wind_speed_kmh, 6) + 0.0 AS wind_speed_kmh", "weather_severity_flag",
         *per_target("orders_count", "o"), *per_target("food_tickets_count", "f"),
         "hour", "weekday", "month", "quarter", "week_of_year",
         "CAST(weekday IN (5, 6) AS INTEGER) AS is_weekend", "CAST(weekday IN (4, 5) AS INTEGER) AS is_friday_saturday",
         *cyc,
         "CAST(hour < 21 AS INTEGER) AS is_food_service", "CAST(hour < 15 AS INTEGER) AS is_breakfast_window",
         "CAST(hour BETWEEN 12 AND 14 AS INTEGER) AS is_lunch_window",
         "CAST(hour BETWEEN 17 AND 20 AS INTEGER) AS is_dinner_window",
         "CAST(hour >= 21 AS INTEGER) AS is_after_food_close",
         "CAST(CASE WHEN hour >= 21 THEN hour - 21 ELSE 0 END AS INTEGER) AS hours_since_food_close",
         "CAST(hour >= 22 AS INTEGER) AS is_live_music_window",
         "round(az, 6) + 0.0 AS airport_arrivals_zscore",
         "CAST(weekday IN (5, 6) AS INTEGER) * CAST(hour >= 22 AS INTEGER) AS weekend_x_music",
         "round(rain_mm * CAST(weekday IN (5, 6) AS INTEGER), 6) + 0.0 AS rain_x_weekend",
         "bank_holiday_flag + major_sports_event_flag + city_event_flag + st_patricks_week_flag AS event_intensity",
         "round(az + CAST(cruise_ship_flag AS DOUBLE), 6) + 0.0 AS tourism_pressure"])
    return f"""
WITH p AS ({P3.strip()}),
enr AS ({ENRICH_SQL.strip()}),
fl AS ({SQ.FAILTE_DAILY.strip()}),
ff AS ({SQ.FOOTFALL.strip()}),
wx AS (SELECT CAST(date AS TIMESTAMP) AS timestamp_hour, temp_c, rain_mm, wind_speed_kmh, weather_severity_flag
       FROM ({SQ.WEATHER_DAILY.strip()}) w),
spine AS (SELECT DISTINCT CAST(timestamp_hour AS DATE) AS date FROM p),
{CAL_COLUMNS_SQL},
base AS (
  SELECT p.*,
    {base_cols}
  FROM p
  LEFT JOIN enr e ON e.date = CAST(p.timestamp_hour AS DATE)
  LEFT JOIN fl ON fl.date = CAST(p.timestamp_hour AS DATE)
  LEFT JOIN ff ON ff.timestamp_hour = p.timestamp_hour
  LEFT JOIN wx ON wx.timestamp_hour = p.timestamp_hour
  LEFT JOIN calcols c ON c.date = CAST(p.timestamp_hour AS DATE)
{joins}),
z AS (SELECT *, CASE WHEN stddev_samp(airport_arrivals) OVER (PARTITION BY l_suppkey) > 0
                     THEN (airport_arrivals - avg(airport_arrivals) OVER (PARTITION BY l_suppkey))
                          / stddev_samp(airport_arrivals) OVER (PARTITION BY l_suppkey) END AS az FROM base)
SELECT
  {final}
FROM z WINDOW w AS ({win})"""


def _register_feature_table():
    @register("feature_table", sql=_feature_table_sql())
    def q_feature_table(spark, sf):
        df = p3_feature_table(spark, sf)
        dbl = [c for c, t in df.dtypes if t == "double" and c != "sales_total"]
        return df.withColumns({c: _round6(c) for c in dbl})


_register_feature_table()


@register("interactions", sql=f"""
SELECT l_suppkey, timestamp_hour, weekend_x_music, rain_x_weekend, event_intensity, tourism_pressure
FROM ({_feature_table_sql()}) ft""")
def q_interactions(spark, sf):
    df = p3_feature_table(spark, sf)
    return df.select("l_suppkey", TS, "weekend_x_music", F.round("rain_x_weekend", 6).alias("rain_x_weekend"),
                     "event_intensity", (F.round("tourism_pressure", 6) + F.lit(0.0)).alias("tourism_pressure"))


def hourly_feature_table(spark, sf):
    """F7 on the hourly panel of each event type: all open hours occur, with hourly weather and footfall stand-ins."""
    from shiftcast.plans.feature_table import build_feature_table
    from shiftcast.sources import standins as ST

    h = ST.events_hourly(spark, sf)
    wx = h.select(TS, "temp_c", (F.col("footfall_clicks") / 2.0).alias("rain_mm"))
    ff = h.select(TS, (F.col("footfall_views") * 300).alias("suffolk_nassau_footfall"))
    return build_feature_table(panel_p1(spark, sf, keyed=True), keys=K, footfall=ff, weather=wx, drop_na=False, unique_signals=True)


def _hourly_feature_sql() -> str:
    from shiftcast.plans import sqlstandins as SQ
    from shiftcast.plans.calendar_queries import CAL_COLUMNS_SQL

    targets = ("orders_count", "food_tickets_count")

    def lag(t: str, h: int) -> str:
        return (f"max({t}) OVER (PARTITION BY event_type ORDER BY timestamp_hour "
                f"RANGE BETWEEN INTERVAL {h} HOURS PRECEDING AND INTERVAL {h} HOURS PRECEDING)")

    windows = ",\n  ".join(
        [f"lag({t}, {n}) OVER w AS {t}_lag_{n}" for t in targets for n in (1, 2, 3)]
        + [f"{lag(t, h)} AS {t}_lag_{h}h" for t in targets for h in (24, 48, 168, 336)]
        + [f"round(list_avg(list_filter([{', '.join(lag(t, 168 * k) for k in (1, 2, 3, 4))}], lambda x: x IS NOT NULL)), 6) AS {t}_same_slot_4w_avg" for t in targets]
        + [_roll_sql(t, True) for t in targets])
    cyclic = ", ".join(f"round({fn}(2 * pi() * {part} / {period}), 6) + 0.0 AS {part}_{fn}"
                       for part, period in (("hour", 24), ("weekday", 7), ("month", 12)) for fn in ("sin", "cos"))
    return with_panels(f"""
SELECT *, {cyclic},
  CAST(weekday IN (5, 6) AS INTEGER) AS is_weekend, CAST(weekday IN (4, 5) AS INTEGER) AS is_friday_saturday,
  CAST(hour < 21 AS INTEGER) AS is_food_service, CAST(hour < 15 AS INTEGER) AS is_breakfast_window,
  CAST(hour BETWEEN 12 AND 14 AS INTEGER) AS is_lunch_window, CAST(hour BETWEEN 17 AND 20 AS INTEGER) AS is_dinner_window,
  CAST(hour >= 21 AS INTEGER) AS is_after_food_close, CAST(greatest(hour - 21, 0) AS INTEGER) AS hours_since_food_close,
  CAST(hour >= 22 AS INTEGER) AS is_live_music_window,
  CAST(weekday IN (5, 6) AS INTEGER) * CAST(hour >= 22 AS INTEGER) AS weekend_x_music,
  round(rain_mm * CAST(weekday IN (5, 6) AS INTEGER), 6) + 0.0 AS rain_x_weekend, bank_holiday_flag AS event_intensity
FROM b""", ctes=f"""
h AS ({SQ.EVENTS_HOURLY.strip()}),
spine AS (SELECT DISTINCT CAST(timestamp_hour AS DATE) AS date FROM p),
{CAL_COLUMNS_SQL},
b AS (
SELECT p.*, c.bank_holiday_flag, coalesce(CAST(h.footfall_views * 300 AS DOUBLE), 0.0) AS suffolk_nassau_footfall,
  round(coalesce(h.temp_c, 0.0), 6) + 0.0 AS temp_c, round(coalesce(h.footfall_clicks / 2.0, 0.0), 6) + 0.0 AS rain_mm,
  CAST(hour(p.timestamp_hour) AS INTEGER) AS hour, CAST(isodow(p.timestamp_hour) - 1 AS INTEGER) AS weekday,
  CAST(month(p.timestamp_hour) AS INTEGER) AS month, CAST(quarter(p.timestamp_hour) AS INTEGER) AS quarter,
  CAST(weekofyear(p.timestamp_hour) AS INTEGER) AS week_of_year
FROM (SELECT *, {windows} FROM p WINDOW w AS (PARTITION BY event_type ORDER BY timestamp_hour)) p
LEFT JOIN h ON h.timestamp_hour = p.timestamp_hour LEFT JOIN calcols c ON c.date = CAST(p.timestamp_hour AS DATE))""", p=P1K)


def _register_hourly():
    @register("feature_table_hourly", sql=_hourly_feature_sql())
    def q_feature_table_hourly(spark, sf):
        df = hourly_feature_table(spark, sf)
        dbl = [c for c, t in df.dtypes if t == "double" and c != "sales_total"]
        return df.withColumns({c: _round6(c) for c in dbl})


_register_hourly()
