"""Registered queries for survey 2.C (calendar tables and time features)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftcast.operators import calendars as C
from shiftcast.plans.sqlpanels import P1, with_panels
from shiftcast.registry import register
from shiftcast.sources.tables import panel_p1, read_table


def _year_spine(spark, sf):
    """Whole calendar years covering every order date and every event time."""
    o = read_table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d"))
    e = read_table(spark, sf, "events").select(F.to_date("ts").alias("d"))
    bounds = o.unionByName(e).agg(F.min("d").alias("start"), F.max("d").alias("end"))
    return C.date_spine(bounds, whole_years=True)


_YEAR_SPINE_SQL = """
b AS (SELECT min(d) AS s, max(d) AS e FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders
                                             UNION ALL SELECT CAST(ts AS DATE) FROM events)),
spine AS (SELECT CAST(unnest(generate_series(make_date(year(s), 1, 1), make_date(year(e), 12, 31),
                                             INTERVAL 1 DAY)) AS DATE) AS date FROM b)"""

# Calendar parts of every spine date, with Easter Sunday (integer computus).
_EASTER_SQL = """
e1 AS (SELECT date, year(date) AS y FROM spine),
e2 AS (SELECT *, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM e1),
e3 AS (SELECT *, b // 4 AS d, b % 4 AS e, (b + 8) // 25 AS f, c // 4 AS i, c % 4 AS k FROM e2),
e4 AS (SELECT *, (19 * a + b - d - ((b - f + 1) // 3) + 15) % 30 AS h FROM e3),
e5 AS (SELECT *, (32 + 2 * e + 2 * i - h - k) % 7 AS l FROM e4),
e6 AS (SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM e5),
cal AS (SELECT date, y, month(date) AS mo, day(date) AS dom, isodow(date) - 1 AS wd,
               make_date(y, CAST((h + l - 7 * m + 114) // 31 AS INTEGER),
                         CAST((h + l - 7 * m + 114) % 31 + 1 AS INTEGER)) AS easter,
               month(date) * 100 + day(date) AS md
        FROM e6)"""

_SPINE_SQL = _YEAR_SPINE_SQL + ",\n" + _EASTER_SQL.strip()

_HOLIDAY_CASE = """CASE
    WHEN mo = 1 AND dom = 1 THEN 'New Year''s Day'
    WHEN y >= 2023 AND mo = 2 AND (
         (isodow(make_date(y, 2, 1)) = 5 AND dom = 1)
      OR (isodow(make_date(y, 2, 1)) <> 5 AND wd = 0 AND dom <= 7)) THEN 'Saint Brigid''s Day'
    WHEN mo = 3 AND dom = 17 THEN 'Saint Patrick''s Day'
    WHEN date = easter + 1 THEN 'Easter Monday'
    WHEN mo = 5 AND wd = 0 AND dom <= 7 THEN 'May Day'
    WHEN mo = 6 AND wd = 0 AND dom <= 7 THEN 'June Bank Holiday'
    WHEN mo = 8 AND wd = 0 AND dom <= 7 THEN 'August Bank Holiday'
    WHEN mo = 10 AND wd = 0 AND dom >= 25 THEN 'October Bank Holiday'
    WHEN mo = 12 AND dom = 25 THEN 'Christmas Day'
    WHEN mo = 12 AND dom = 26 THEN 'Saint Stephen''s Day' END"""

_SCHOOL = ("md BETWEEN 625 AND 831 OR md BETWEEN 1223 AND 1231 OR md BETWEEN 101 AND 106 "
           "OR md BETWEEN 1026 AND 1101 OR md BETWEEN 216 AND 220 OR date BETWEEN easter - 2 AND easter + 11")
_COLLEGE = "md BETWEEN 907 AND 1212 OR md BETWEEN 115 AND 428 OR md BETWEEN 501 AND 529"
_ANNUAL = """
  CAST(mo = 3 AND dom BETWEEN 13 AND 17 AS INTEGER) AS st_patricks_week_flag,
  CAST(mo = 6 AND dom = 16 AS INTEGER) AS bloomsday_flag,
  CAST(mo = 6 AND dom BETWEEN 11 AND 16 AS INTEGER) AS bloomsday_week_flag,
  CAST((mo = 6 AND dom >= 20) OR mo IN (7, 8) AS INTEGER) AS summer_tourism_flag,
  CAST((mo = 11 AND dom >= 20) OR (mo = 12 AND dom <= 23) AS INTEGER) AS christmas_market_flag,
  CAST(mo = 12 AND dom = 31 AS INTEGER) AS new_years_eve_flag,
  CAST(mo = 1 AND dom = 1 AS INTEGER) AS new_years_day_flag"""

# Every calendar column of a ``spine`` CTE, as CTE ``calcols``.
CAL_COLUMNS_SQL = _EASTER_SQL.strip() + f""",
calcols AS (SELECT date, CAST(({_HOLIDAY_CASE}) IS NOT NULL AS INTEGER) AS bank_holiday_flag,
  CAST({_SCHOOL} AS INTEGER) AS school_holiday_flag, CAST({_COLLEGE} AS INTEGER) AS college_term_flag,
  CAST(dom >= 25 OR dom <= 5 AS INTEGER) AS payday_period_flag,
  CAST(CASE WHEN dom >= 25 THEN dom - 25 ELSE dom - 5 END AS INTEGER) AS days_from_payday,
  {_ANNUAL.strip()}
  FROM cal)"""


@register("cal_payday", sql=f"""
WITH {_SPINE_SQL}
SELECT date, CAST(dom >= 25 OR dom <= 5 AS INTEGER) AS payday_period_flag,
       CAST(CASE WHEN dom >= 25 THEN dom - 25 ELSE dom - 5 END AS INTEGER) AS days_from_payday FROM cal""")
def q_cal_payday(spark, sf):
    return C.payday_calendar(_year_spine(spark, sf))


@register("cal_school", sql=f"""
WITH {_SPINE_SQL}
SELECT date, CAST(md BETWEEN 625 AND 831 OR md BETWEEN 1223 AND 1231 OR md BETWEEN 101 AND 106
                  OR md BETWEEN 1026 AND 1101 OR md BETWEEN 216 AND 220
                  OR date BETWEEN easter - 2 AND easter + 11 AS INTEGER) AS school_holiday_flag FROM cal""")
def q_cal_school(spark, sf):
    return C.school_calendar(_year_spine(spark, sf))


@register("cal_college", sql=f"""
WITH {_SPINE_SQL}
SELECT date, CAST(md BETWEEN 907 AND 1212 OR md BETWEEN 115 AND 428 OR md BETWEEN 501 AND 529 AS INTEGER)
  AS college_term_flag FROM cal""")
def q_cal_college(spark, sf):
    return C.college_calendar(_year_spine(spark, sf))


@register("cal_annual", sql=f"""
WITH {_SPINE_SQL}
SELECT date,
  CAST(mo = 3 AND dom BETWEEN 13 AND 17 AS INTEGER) AS st_patricks_week_flag,
  CAST(mo = 6 AND dom = 16 AS INTEGER) AS bloomsday_flag,
  CAST(mo = 6 AND dom BETWEEN 11 AND 16 AS INTEGER) AS bloomsday_week_flag,
  CAST((mo = 6 AND dom >= 20) OR mo IN (7, 8) AS INTEGER) AS summer_tourism_flag,
  CAST((mo = 11 AND dom >= 20) OR (mo = 12 AND dom <= 23) AS INTEGER) AS christmas_market_flag,
  CAST(mo = 12 AND dom = 31 AS INTEGER) AS new_years_eve_flag,
  CAST(mo = 1 AND dom = 1 AS INTEGER) AS new_years_day_flag
FROM cal""")
def q_cal_annual(spark, sf):
    return C.annual_calendar(_year_spine(spark, sf))


@register("cal_bank_holidays", sql=f"""
WITH {_SPINE_SQL},
named AS (SELECT date, CASE
    WHEN mo = 1 AND dom = 1 THEN 'New Year''s Day'
    WHEN y >= 2023 AND mo = 2 AND (
         (isodow(make_date(y, 2, 1)) = 5 AND dom = 1)
      OR (isodow(make_date(y, 2, 1)) <> 5 AND wd = 0 AND dom <= 7)) THEN 'Saint Brigid''s Day'
    WHEN mo = 3 AND dom = 17 THEN 'Saint Patrick''s Day'
    WHEN date = easter + 1 THEN 'Easter Monday'
    WHEN mo = 5 AND wd = 0 AND dom <= 7 THEN 'May Day'
    WHEN mo = 6 AND wd = 0 AND dom <= 7 THEN 'June Bank Holiday'
    WHEN mo = 8 AND wd = 0 AND dom <= 7 THEN 'August Bank Holiday'
    WHEN mo = 10 AND wd = 0 AND dom >= 25 THEN 'October Bank Holiday'
    WHEN mo = 12 AND dom = 25 THEN 'Christmas Day'
    WHEN mo = 12 AND dom = 26 THEN 'Saint Stephen''s Day' END AS holiday_name FROM cal)
SELECT date, 1 AS bank_holiday_flag, holiday_name FROM named WHERE holiday_name IS NOT NULL""")
def q_cal_bank_holidays(spark, sf):
    return C.bank_holidays(_year_spine(spark, sf))


# Event list stand-in: one record per (order day, priority, status) – a
# pre-aggregated, dimension-sized list (≤ 15 records a day).
_VENUES = {"aviva_event_flag": ["F"], "croke_park_event_flag": ["O"], "nearby_venue_event_flag": ["P"]}


@register("event_day_rollup", sql="""
WITH ev AS (
  SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS event_name, o_orderstatus AS venue,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'very_high' WHEN '2-HIGH' THEN 'high'
              WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' ELSE o_orderpriority END AS impact,
         min(o_orderkey) AS seq
  FROM orders GROUP BY 1, 2, 3, 4)
SELECT date,
  max(CAST(venue = 'F' AS INTEGER)) AS aviva_event_flag,
  max(CAST(venue = 'O' AS INTEGER)) AS croke_park_event_flag,
  max(CAST(venue = 'P' AS INTEGER)) AS nearby_venue_event_flag,
  1 AS city_event_flag,
  max(CASE lower(impact) WHEN 'very_high' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 1 END)
    AS event_impact_score,
  string_agg(event_name, ' | ' ORDER BY seq) AS event_names
FROM ev GROUP BY date""")
def q_event_day_rollup(spark, sf):
    o = read_table(spark, sf, "orders")
    impact = (F.when(F.col("o_orderpriority") == "1-URGENT", "very_high")
              .when(F.col("o_orderpriority") == "2-HIGH", "high")
              .when(F.col("o_orderpriority") == "3-MEDIUM", "medium")
              .when(F.col("o_orderpriority") == "5-LOW", "low").otherwise(F.col("o_orderpriority")))
    ev = (o.groupBy(F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("event_name"),
                    F.col("o_orderstatus").alias("venue"), impact.alias("impact"))
          .agg(F.min("o_orderkey").alias("seq")))
    return C.event_day_rollup(ev, seq="seq", venue_flags=_VENUES)


_P1_PARTS = "SELECT *, CAST(hour(timestamp_hour) AS INTEGER) AS hour, CAST(isodow(timestamp_hour) - 1 AS INTEGER) AS weekday, CAST(month(timestamp_hour) AS INTEGER) AS month FROM p"


@register("time_parts", sql=with_panels("""
SELECT timestamp_hour, hour, weekday, month, CAST(quarter(timestamp_hour) AS INTEGER) AS quarter,
       CAST(weekofyear(timestamp_hour) AS INTEGER) AS week_of_year,
       CAST(weekday IN (5, 6) AS INTEGER) AS is_weekend, CAST(weekday IN (4, 5) AS INTEGER) AS is_friday_saturday
FROM x""", p=P1, x=_P1_PARTS))
def q_time_parts(spark, sf):
    out = C.add_time_parts(panel_p1(spark, sf))
    return out.select("timestamp_hour", "hour", "weekday", "month", "quarter", "week_of_year",
                      "is_weekend", "is_friday_saturday")


@register("cyclic", sql=with_panels("""
SELECT timestamp_hour,
  round(sin(2 * pi() * hour / 24), 6) + 0.0 AS hour_sin, round(cos(2 * pi() * hour / 24), 6) + 0.0 AS hour_cos,
  round(sin(2 * pi() * weekday / 7), 6) + 0.0 AS weekday_sin, round(cos(2 * pi() * weekday / 7), 6) + 0.0 AS weekday_cos,
  round(sin(2 * pi() * month / 12), 6) + 0.0 AS month_sin, round(cos(2 * pi() * month / 12), 6) + 0.0 AS month_cos
FROM x""", p=P1, x=_P1_PARTS))
def q_cyclic(spark, sf):
    out = C.add_cyclic(C.add_time_parts(panel_p1(spark, sf)))
    cols = [f"{p}_{f}" for p in ("hour", "weekday", "month") for f in ("sin", "cos")]
    return out.select("timestamp_hour", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in cols])


@register("venue_windows", sql=with_panels("""
SELECT timestamp_hour,
  CAST(hour < 21 AS INTEGER) AS is_food_service, CAST(hour < 15 AS INTEGER) AS is_breakfast_window,
  CAST(hour BETWEEN 12 AND 14 AS INTEGER) AS is_lunch_window, CAST(hour BETWEEN 17 AND 20 AS INTEGER) AS is_dinner_window,
  CAST(hour >= 21 AS INTEGER) AS is_after_food_close,
  CAST(CASE WHEN hour >= 21 THEN hour - 21 ELSE 0 END AS INTEGER) AS hours_since_food_close,
  CAST(hour >= 22 AS INTEGER) AS is_live_music_window
FROM x""", p=P1, x=_P1_PARTS))
def q_venue_windows(spark, sf):
    out = C.add_venue_windows(panel_p1(spark, sf))
    return out.select("timestamp_hour", "is_food_service", "is_breakfast_window", "is_lunch_window",
                      "is_dinner_window", "is_after_food_close", "hours_since_food_close", "is_live_music_window")


@register("music_hours", sql=with_panels("""
SELECT timestamp_hour,
  CAST(CASE WHEN weekday IN (4, 5) THEN hour >= 22 OR hour <= 1 ELSE hour BETWEEN 22 AND 23 END AS INTEGER)
    AS is_live_music_hour,
  CAST(CASE WHEN weekday IN (4, 5) THEN hour >= 9 OR hour <= 2 ELSE hour >= 9 OR hour <= 1 END AS INTEGER)
    AS bar_is_open
FROM x""", p=P1, x=_P1_PARTS))
def q_music_hours(spark, sf):
    return C.music_hours(panel_p1(spark, sf)).select("timestamp_hour", "is_live_music_hour", "bar_is_open")
