"""Registered queries for survey 2.J (serving), G9 (briefing), 2.K (rules), H14 (what-if)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shiftcast.functions import calendar as CAL
from shiftcast.operators import calendars as C
from shiftcast.operators import diagnostics as D
from shiftcast.operators import features as FT
from shiftcast.operators import rules as R
from shiftcast.operators import serving as SV
from shiftcast.plans import sqlstandins as SQ
from shiftcast.plans.diagnostic_queries import sql_corr
from shiftcast.plans.feature_queries import _feature_table_sql
from shiftcast.plans.segment_queries import _case
from shiftcast.plans.sqlpanels import P1, P1K, with_panels
from shiftcast.registry import register
from shiftcast.sources import standins as ST
from shiftcast.sources.tables import panel_p1, read_table

TS = "timestamp_hour"
K = ["event_type"]


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@register("full_days", sql=with_panels("""
SELECT event_type, date, n_rows, CAST(n_rows >= 12 AS INTEGER) AS is_full,
  CAST(date = coalesce(max(CASE WHEN n_rows >= 12 THEN date END) OVER (PARTITION BY event_type),
                       max(date) OVER (PARTITION BY event_type)) AS INTEGER) AS is_default
FROM (SELECT event_type, CAST(timestamp_hour AS DATE) AS date, count(*) AS n_rows FROM p GROUP BY 1, 2)""", p=P1K))
def q_full_days(spark, sf):
    return SV.full_days(panel_p1(spark, sf, keyed=True), K)


def _p1_signals(spark, sf):
    """P1 with hourly stand-in signals: temperature from event values, rain
    from clicks, footfall from views."""
    h = ST.events_hourly(spark, sf).select(TS, "temp_c", (F.col("footfall_clicks") / 2.0).alias("rain_mm"),
                                           (F.col("footfall_views") * 300).alias("suffolk_nassau_footfall"))
    return panel_p1(spark, sf).join(h, TS, "left")


_P1_SIG = f"""SELECT p.*, h.temp_c, h.footfall_clicks / 2.0 AS rain_mm, h.footfall_views * 300 AS suffolk_nassau_footfall
FROM p LEFT JOIN ({SQ.EVENTS_HOURLY}) h USING (timestamp_hour)"""


@register("day_defaults", sql=with_panels("""
SELECT date,
  least(greatest(coalesce(round_even(r * 2, 0) / 2, 1.0), 0.0), 20.0) AS rain_default,
  least(greatest(coalesce(round_even(t * 2, 0) / 2, 12.0), 0.0), 25.0) AS temp_default
FROM (SELECT CAST(timestamp_hour AS DATE) AS date,
             coalesce(avg(CASE WHEN hour(timestamp_hour) BETWEEN 12 AND 22 THEN rain_mm END), avg(rain_mm)) AS r,
             coalesce(avg(CASE WHEN hour(timestamp_hour) BETWEEN 12 AND 22 THEN temp_c END), avg(temp_c)) AS t
      FROM ps GROUP BY 1)""", p=P1, ps=_P1_SIG))
def q_day_defaults(spark, sf):
    return SV.day_defaults(_p1_signals(spark, sf))


@register("hourly_output", sql=with_panels(f"""
SELECT p.timestamp_hour, strftime(p.timestamp_hour, '%H:%M') AS "Time",
  coalesce({_case('kpi', 'hour(p.timestamp_hour)')}, '') AS "Shift",
  CAST(round_even(coalesce(list_avg(list_filter([w1.orders_count, w2.orders_count, w3.orders_count, w4.orders_count],
                                                lambda x: x IS NOT NULL)), 0.0), 0) AS BIGINT) AS "Orders",
  CAST(round_even(coalesce(list_avg(list_filter([w1.food_tickets_count, w2.food_tickets_count, w3.food_tickets_count,
                                                 w4.food_tickets_count], lambda x: x IS NOT NULL)), 0.0), 0) AS BIGINT)
    AS "Food",
  CAST(coalesce(w1.orders_count, 0) AS BIGINT) AS "Baseline"
FROM p
LEFT JOIN p w1 ON w1.timestamp_hour = p.timestamp_hour - INTERVAL 7 DAY
LEFT JOIN p w2 ON w2.timestamp_hour = p.timestamp_hour - INTERVAL 14 DAY
LEFT JOIN p w3 ON w3.timestamp_hour = p.timestamp_hour - INTERVAL 21 DAY
LEFT JOIN p w4 ON w4.timestamp_hour = p.timestamp_hour - INTERVAL 28 DAY""", p=P1))
def q_hourly_output(spark, sf):
    p = panel_p1(spark, sf)
    f = FT.same_slot_mean(FT.clock_lags(p, "orders_count", (168,)), "orders_count")
    f = FT.same_slot_mean(f, "food_tickets_count")
    f = f.withColumns({"orders_fc": F.coalesce("orders_count_same_slot_4w_avg", F.lit(0.0)),
                       "food_fc": F.coalesce("food_tickets_count_same_slot_4w_avg", F.lit(0.0)),
                       "base_fc": F.coalesce("orders_count_lag_168h", F.lit(0))})
    return SV.hourly_output(f, "orders_fc", "food_fc", "base_fc")


DRIVER_CANDIDATES = ["orders_count_lag_168h", "food_tickets_count_lag_168h", "orders_count_roll_mean_24",
                     "suffolk_footfall_lag_24h", "suffolk_footfall_roll_24h", "event_intensity",
                     "airport_arrivals_zscore", "tourism_pressure", "is_weekend", "is_friday_saturday",
                     "payday_period_flag", "school_holiday_flag", "failte_event_count", "temp_c", "rain_mm"]


def _rounded_ft(spark, sf):
    """The feature table exactly as the ``feature_table`` query returns it."""
    from shiftcast.registry import queries

    return queries()["feature_table"](spark, sf)


def _importance(ft, target: str = "orders_count"):
    """|corr(target, feature)| as a data-driven importance, as a share of the total.

    One aggregate with one correlation per candidate; the share is a window
    over the (candidate-sized) result, not a join back."""
    imp = D.target_corr(ft, DRIVER_CANDIDATES, target)
    imp = imp.select("feature", F.round(F.abs(F.col(target)), 9).alias("importance")).na.drop()
    tot = F.sum("importance").over(Window.partitionBy(F.lit(0)))
    return imp.select("feature", "importance", (F.try_divide(F.col("importance"), tot) * 100).alias("importance_pct"))


def _top_drivers_sql() -> str:
    labels = "MAP {" + ", ".join(f"{_q(k)}: {_q(v)}" for k, v in SV.HUMAN_LABELS.items()) + "}"
    unions = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(abs({sql_corr('CAST(orders_count AS DOUBLE)', f'CAST({c} AS DOUBLE)')}), 9)"
        " AS importance FROM ft"
        for c in DRIVER_CANDIDATES)
    return f"""
WITH ft AS ({_feature_table_sql()}),
imp AS (SELECT * FROM ({unions}) u WHERE importance IS NOT NULL),
pct AS (SELECT feature, importance, importance / sum(importance) OVER () * 100 AS importance_pct FROM imp),
top AS (SELECT *, row_number() OVER (ORDER BY importance_pct DESC, feature) AS rank FROM pct)
SELECT CAST(rank AS INTEGER) AS rank, feature,
  coalesce(({labels})[feature],
           array_to_string(list_transform(string_split(replace(feature, '_', ' '), ' '),
                                          lambda w: upper(w[1]) || lower(w[2:])), ' ')) AS label,
  round(importance_pct, 6) AS importance_pct,
  CAST(floor(importance_pct / max(importance_pct) OVER () * 100) AS INTEGER) AS bar_width
FROM top WHERE rank <= 7"""


@register("top_drivers", sql=_top_drivers_sql())
def q_top_drivers(spark, sf):
    td = SV.top_drivers(_importance(_rounded_ft(spark, sf)))
    return td.select("rank", "feature", "label", F.round("importance_pct", 6).alias("importance_pct"), "bar_width")


def _briefing_sql() -> str:
    T = SV.briefing_text()
    absent = {"special_event_flag"}  # not produced by the feature table
    sig = ", ".join((f"max(coalesce(TRY_CAST({c} AS DOUBLE), 0.0)) AS {c}" if c not in absent else f"0.0 AS {c}")
                    for c in SV.BRIEFING_SIGNALS)

    def nums(key, *vals):
        parts = T[key]
        out = [_q(parts[0])]
        for i, v in enumerate(vals):
            out += [v, _q(parts[i + 1])]
        return " || ".join(out)

    f0 = lambda x: f"printf('%.0f', round_even({x}, 0))"
    f1 = lambda x: f"printf('%.1f', round_even({x}, 1))"
    day = "['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'][isodow(date)]"
    wknd = "(isodow(date) - 1 >= 4)"
    sports_only = "(major_sports_event_flag <> 0 AND aviva_event_flag = 0 AND croke_park_event_flag = 0)"
    named = [("new_years_eve_flag <> 0", T["h_nye"]), ("bloomsday_flag <> 0", T["h_bloomsday"]),
             ("st_patricks_week_flag <> 0", T["h_st_pats"]), ("aviva_event_flag <> 0", T["h_aviva"]),
             ("croke_park_event_flag <> 0", T["h_croke"]), (sports_only, T["h_sports"]),
             ("special_event_flag <> 0", T["h_special"]), ("cruise_ship_flag <> 0", T["h_cruise"]),
             ("bank_holiday_flag <> 0", T["h_bank_hol"])]
    named_list = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {_q(t)} END" for c, t in named) + \
        "], lambda x: x IS NOT NULL)"
    fallback = (f"list_filter([CASE WHEN is_live_music_window <> 0 THEN {_q(T['h_music'])} END, "
                f"CASE WHEN is_live_music_window = 0 AND rain_mm > 8 THEN {_q(T['h_rain'])} END], lambda x: x IS NOT NULL)")
    ev = [("new_years_eve_flag <> 0", _q(T["nye"])),
          ("bloomsday_flag <> 0 OR bloomsday_week_flag <> 0",
           f"CASE WHEN bloomsday_flag <> 0 THEN {_q(T['bloomsday'])} ELSE {_q(T['bloomsweek'])} END"),
          ("st_patricks_week_flag <> 0", _q(T["st_pats"])), ("christmas_market_flag <> 0", _q(T["xmas"])),
          ("aviva_event_flag <> 0", _q(T["aviva"])), ("croke_park_event_flag <> 0", _q(T["croke"])),
          (sports_only, _q(T["sports"])), ("bank_holiday_flag <> 0", _q(T["bank_hol"])),
          ("special_event_flag <> 0", _q(T["special"])),
          ("is_live_music_window <> 0",
           nums("music", f"CASE WHEN {wknd} THEN '22:00–01:00' ELSE '21:30–23:30' END"))]
    ev_list = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {v} END" for c, v in ev) + "], lambda x: x IS NOT NULL)"
    ctx = [("payday_period_flag <> 0", T["payday"]),
           ("college_term_flag <> 0 AND school_holiday_flag = 0", T["college"]),
           ("school_holiday_flag <> 0", T["school"])]
    ctx_list = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {_q(t)} END" for c, t in ctx) + \
        "], lambda x: x IS NOT NULL)"
    return f"""
WITH ft AS ({_feature_table_sql()}),
g AS (SELECT l_suppkey, CAST(timestamp_hour AS DATE) AS date, {sig}, avg(TRY_CAST(temp_c AS DOUBLE)) AS temp_c,
             sum(CAST(sales_total / 100.0 AS DOUBLE)) AS total, floor(max(coalesce(TRY_CAST(failte_event_count AS DOUBLE), 0.0))) AS failte_n
      FROM ft GROUP BY 1, 2),
v AS (SELECT *, CASE WHEN coalesce(total, 0) > 650 THEN 'Slammed' WHEN coalesce(total, 0) > 450 THEN 'Busy'
                     WHEN coalesce(total, 0) > 280 THEN 'Standard' ELSE 'Quiet' END AS vibe,
             {day} AS dayname,
             CASE WHEN len({named_list}) > 0 THEN {named_list} ELSE {fallback} END AS drivers FROM g)
SELECT l_suppkey, date, vibe,
  CASE WHEN len(drivers) > 0 THEN vibe || ' ' || dayname || ' — ' || array_to_string(drivers[1:2], ', ') || '.'
       ELSE 'Standard ' || dayname || {_q(T['standard'])} END AS headline,
  concat_ws(' ',
    CASE WHEN cruise_ship_flag <> 0 AND airport_arrivals_zscore > 0.5 THEN {_q(T['cruise_airport'])}
         WHEN cruise_ship_flag <> 0 THEN {_q(T['cruise'])}
         WHEN airport_arrivals_zscore > 1.0 THEN {_q(T['airport_high'])}
         WHEN airport_arrivals_zscore < -1.0 AND cruise_ship_flag = 0 THEN {_q(T['airport_low'])}
         ELSE {_q(T['no_tourism'])} END,
    CASE WHEN summer_tourism_flag <> 0 THEN {_q(T['summer'])} END,
    CASE WHEN failte_n >= 2 THEN CAST(CAST(failte_n AS BIGINT) AS VARCHAR) || {_q(T['failte_many'])}
         WHEN failte_n = 1 THEN {_q(T['failte_one'])} END,
    CASE WHEN city_event_flag <> 0 OR nearby_venue_event_flag <> 0 THEN {_q(T['city_event'])} END) AS tourism,
  CASE WHEN rain_mm > 8 THEN {nums('heavy_rain', f0('rain_mm'), f0('temp_c'))}
       WHEN rain_mm > 3 THEN {nums('rain', f0('rain_mm'), f0('temp_c'))}
       WHEN rain_mm > 0.5 THEN {nums('showers', f1('rain_mm'), f0('temp_c'))}
       WHEN temp_c > 18 THEN {nums('warm', f0('temp_c'))}
       WHEN temp_c < 7 THEN {nums('cold', f0('temp_c'))}
       ELSE {nums('mild', f0('temp_c'))} END AS weather,
  CASE WHEN len({ev_list}) > 0 THEN array_to_string({ev_list}, ' ') ELSE {_q(T['no_events'])} END AS events,
  CASE WHEN len({ctx_list}) > 0 THEN array_to_string({ctx_list}, ' ')
       WHEN {wknd} THEN dayname || {_q(T['weekend'])} ELSE dayname || {_q(T['weekday'])} END AS context
FROM v"""


@register("daily_briefing", sql=_briefing_sql())
def q_daily_briefing(spark, sf):
    ft = _rounded_ft(spark, sf).withColumn("_orders_fc", F.col("sales_total") / 100.0)
    return SV.daily_briefing(ft, "_orders_fc", keys=["l_suppkey"])


# --- 2.K rule-based expected demand, H14 what-if ----------------------------------------

def _rule_input(spark, sf):
    """P1 with temperature through the fallback chain (real hourly where the
    hour had errors logged, else the day's mean event value, else 12 °C),
    rain, footfall, calendar flags and weekend-aware music hours."""
    ev = read_table(spark, sf, "events")
    h = ST.events_hourly(spark, sf)
    hourly = h.select(TS, "temp_c")
    daily = ev.groupBy(F.to_date("ts").alias("date")).agg(
        ((F.sum(F.round(F.col("value") * 100)) % 2500) / 100.0).alias("temp_c"))
    p = panel_p1(spark, sf).join(h.select(TS, (F.col("footfall_clicks") / 2.0).alias("rain_mm"),
                                          (F.col("footfall_views") * 300).alias("suffolk_nassau_footfall")), TS, "left")
    p = R.fallback_chain(p, "temp_c", hourly, daily, default=F.lit(12.0))
    d = F.to_date(TS)
    p = p.withColumns({"st_patricks_week_flag": CAL.annual_flags(d)["st_patricks_week_flag"],
                       "bank_holiday_flag": CAL.bank_holiday_flag(d)})
    return C.music_hours(p)


def _dmap(d: dict) -> str:
    return "MAP {" + ", ".join(f"{k}: CAST({float(v)} AS DOUBLE)" for k, v in d.items()) + "}"


def _dbl(case: str) -> str:
    return f"CAST({case} AS DOUBLE)"


def _expected_sql(rain="rain_mm", temp="temp_c", stp="st_patricks_week_flag", music="is_live_music_hour") -> str:
    """The rule in the same multiplication order as ``rules.expected_demand``."""
    base = f"coalesce(({_dmap(R.BASE_ORDERS)})[h], 10.0)"
    weather = (_dbl(f"CASE WHEN {rain} > 5 THEN 0.90 WHEN {rain} > 2 THEN 0.95 ELSE 1.0 END") + " * "
               + _dbl(f"CASE WHEN {temp} < 5 THEN 1.05 WHEN {temp} > 18 THEN 1.08 ELSE 1.0 END"))
    event = (_dbl(f"CASE WHEN {stp} > 0 THEN 2.0 ELSE 1.0 END") + " * "
             + _dbl("CASE WHEN bank_holiday_flag > 0 THEN 1.30 ELSE 1.0 END"))
    music_m = _dbl(f"CASE WHEN {music} > 0 AND h >= 21 AND h >= 22 AND h <= (CASE WHEN wd IN (4, 5) THEN 26 ELSE 24 END)"
                   " THEN 1.40 ELSE 1.0 END")
    foot = _dbl("CASE WHEN coalesce(suffolk_nassau_footfall, 0) > 3000 THEN 1.35"
                " WHEN coalesce(suffolk_nassau_footfall, 0) > 2000 THEN 1.20"
                " WHEN coalesce(suffolk_nassau_footfall, 0) > 1000 THEN 1.10 ELSE 1.0 END")
    return (f"{base} * ({_dmap(R.WEEKDAY_MULT)})[wd] * ({_dmap(R.MONTH_MULT)})[mo] * ({weather}) * ({event})"
            f" * {music_m} * {foot}")


_RATIO_SQL = f"coalesce(({_dmap(R.FOOD_TICKET_RATIO)})[h], 0.0)"


def _rule_sql(body: str) -> str:
    return with_panels(body, ctes=f"""
x AS (SELECT p.timestamp_hour, p.orders_count, hs.footfall_clicks / 2.0 AS rain_mm,
             hs.footfall_views * 300 AS suffolk_nassau_footfall,
             coalesce(hr.temp_c, dy.temp_c, CAST(12.0 AS DOUBLE)) AS temp_c,
             CAST(month(p.timestamp_hour) = 3 AND day(p.timestamp_hour) BETWEEN 13 AND 17 AS INTEGER)
               AS st_patricks_week_flag,
             CAST((month(p.timestamp_hour) = 1 AND day(p.timestamp_hour) = 1)
                  OR (month(p.timestamp_hour) = 12 AND day(p.timestamp_hour) IN (25, 26))
                  OR (month(p.timestamp_hour) = 3 AND day(p.timestamp_hour) = 17)
                  OR (year(p.timestamp_hour) >= 2023 AND month(p.timestamp_hour) = 2 AND isodow(p.timestamp_hour) = 1
                      AND day(p.timestamp_hour) <= 7 AND isodow(make_date(year(p.timestamp_hour), 2, 1)) <> 5)
                  OR (year(p.timestamp_hour) >= 2023 AND month(p.timestamp_hour) = 2 AND day(p.timestamp_hour) = 1
                      AND isodow(p.timestamp_hour) = 5)
                  OR (month(p.timestamp_hour) IN (5, 6, 8) AND isodow(p.timestamp_hour) = 1 AND day(p.timestamp_hour) <= 7)
                  OR (month(p.timestamp_hour) = 10 AND isodow(p.timestamp_hour) = 1 AND day(p.timestamp_hour) >= 25)
                 AS INTEGER) AS bank_holiday_flag,
             CAST(CASE WHEN isodow(p.timestamp_hour) IN (5, 6) THEN hour(p.timestamp_hour) >= 22 OR hour(p.timestamp_hour) <= 1
                       ELSE hour(p.timestamp_hour) BETWEEN 22 AND 23 END AS INTEGER) AS is_live_music_hour,
             hour(p.timestamp_hour) AS h, isodow(p.timestamp_hour) - 1 AS wd, month(p.timestamp_hour) AS mo
      FROM p
      LEFT JOIN ({SQ.EVENTS_HOURLY}) hs USING (timestamp_hour)
      LEFT JOIN (SELECT timestamp_hour, temp_c FROM ({SQ.EVENTS_HOURLY})) hr USING (timestamp_hour)
      LEFT JOIN (SELECT CAST(ts AS DATE) AS d, (sum(round(value * 100)) % 2500) / 100.0 AS temp_c
                 FROM events GROUP BY 1) dy
        ON dy.d = CAST(p.timestamp_hour AS DATE))""", p=P1)


@register("rule_expected_demand", sql=_rule_sql(f"""
SELECT timestamp_hour, temp_c, round({_expected_sql()}, 6) AS expected_orders,
       round(({_expected_sql()}) * {_RATIO_SQL}, 6) AS expected_food_tickets FROM x"""))
def q_rule_expected_demand(spark, sf):
    e = R.expected_demand(_rule_input(spark, sf))
    return e.select(TS, "temp_c", F.round("expected_orders", 6).alias("expected_orders"),
                    F.round("expected_food_tickets", 6).alias("expected_food_tickets"))


WHAT_IF = {"rain_mm": 10.0, "temp_c": 20.0, "st_patricks_week_flag": 1, "is_live_music_hour": 1}


@register("what_if", sql=_rule_sql(f"""
SELECT timestamp_hour, round({_expected_sql()}, 6) AS expected_orders,
       round({_expected_sql("CAST(10.0 AS DOUBLE)", "CAST(20.0 AS DOUBLE)", "1", "1")}, 6) AS expected_orders_what_if
FROM x"""))
def q_what_if(spark, sf):
    x = _rule_input(spark, sf)
    # both sides on the same row: no second read of the input, no self-join
    base = R.expected_demand(x).select(*x.columns, F.col("expected_orders").alias("_base"))
    alt = R.expected_demand(SV.what_if(base, WHAT_IF))
    return alt.select(TS, F.round("_base", 6).alias("expected_orders"),
                      F.round("expected_orders", 6).alias("expected_orders_what_if"))
