"""Calendar dimension tables and per-row time features (survey 2.C)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftcast.functions import calendar as cal
from shiftcast.functions.timecols import col, cyclic, weekday

# Impact words → score; unknown words score 1.
IMPACT_SCORE = {"very_high": 4, "high": 3, "medium": 2, "low": 1}


def date_spine(bounds: DataFrame, start: str = "start", end: str = "end",
               extra_days: int = 0, whole_years: bool = False) -> DataFrame:
    """One row per day between ``start`` and ``end`` (+ ``extra_days``), inclusive.

    ``bounds`` is a one-row frame (usually ``agg(min, max)`` of a fact table),
    so the spine is built on the executors and its size is the day count.
    """
    s = F.to_date(col(start))
    e = F.date_add(F.to_date(col(end)), extra_days)
    if whole_years:
        s = F.make_date(F.year(s), F.lit(1), F.lit(1))
        e = F.make_date(F.year(e), F.lit(12), F.lit(31))
    return bounds.select(F.explode(F.sequence(s, e, F.expr("INTERVAL 1 DAY"))).alias("date"))


def calendar_dimension(df: DataFrame, ts: str = "timestamp_hour", holidays_only: bool = False) -> DataFrame:
    """One row per date of ``df``'s date range with every calendar column.

    Calendar rules (Easter computus, holiday rules) are evaluated once per
    date here, then joined to the rows (a broadcast of at most one row per
    day) instead of being re-evaluated on every row of a large panel.
    """
    bounds = df.agg(F.min(F.to_date(ts)).alias("start"), F.max(F.to_date(ts)).alias("end"))
    spine = date_spine(bounds)
    cols = [cal.bank_holiday_flag("date").alias("bank_holiday_flag")]
    if not holidays_only:
        cols += [cal.school_holiday_flag("date").alias("school_holiday_flag"),
                 cal.college_term_flag("date").alias("college_term_flag"),
                 cal.payday_flag("date").alias("payday_period_flag"),
                 cal.days_from_payday("date").alias("days_from_payday"),
                 *[c.alias(k) for k, c in cal.annual_flags("date").items()]]
    return spine.select("date", *cols)


def payday_calendar(spine: DataFrame, date: str = "date") -> DataFrame:
    return spine.select(date, cal.payday_flag(date).alias("payday_period_flag"),
                        cal.days_from_payday(date).alias("days_from_payday"))


def school_calendar(spine: DataFrame, date: str = "date") -> DataFrame:
    return spine.select(date, cal.school_holiday_flag(date).alias("school_holiday_flag"))


def college_calendar(spine: DataFrame, date: str = "date") -> DataFrame:
    return spine.select(date, cal.college_term_flag(date).alias("college_term_flag"))


def annual_calendar(spine: DataFrame, date: str = "date") -> DataFrame:
    return spine.select(date, *[c.alias(k) for k, c in cal.annual_flags(date).items()])


def bank_holidays(spine: DataFrame, date: str = "date", brigid_from_year: int = 2023) -> DataFrame:
    """Only the holiday dates: (date, bank_holiday_flag=1, holiday_name)."""
    named = spine.select(date, cal.bank_holiday_name(date, brigid_from_year).alias("holiday_name"))
    return named.filter(F.col("holiday_name").isNotNull()).select(
        date, F.lit(1).alias("bank_holiday_flag"), "holiday_name")


def impact_score(word) -> Column:
    w = F.lower(col(word))
    expr = None
    for k, v in IMPACT_SCORE.items():
        expr = (F.when(w == k, v) if expr is None else expr.when(w == k, v))
    return expr.otherwise(1)


def event_day_rollup(events: DataFrame, date: str = "date", name: str = "event_name",
                     venue: str = "venue", impact: str = "impact", seq: str | None = None,
                     venue_flags: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Event list → one row per day.

    Venue flags are any-of, impact is the max score, names are joined with
    " | " in input order (``seq``).  Meant for dimension-sized event lists;
    feed it pre-aggregated rows when the source is a fact table.
    """
    venue_flags = venue_flags or {}
    order = col(seq) if seq else F.monotonically_increasing_id()
    aggs = [F.max(F.col(venue).isin(*vals).cast("int")).alias(flag) for flag, vals in venue_flags.items()]
    return events.groupBy(F.col(date).alias("date")).agg(
        *aggs,
        F.lit(1).alias("city_event_flag"),
        F.max(impact_score(impact)).alias("event_impact_score"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col(name).alias("n")))),
                                 lambda s: s["n"]), " | ").alias("event_names"),
    )


def add_time_parts(df: DataFrame, ts: str = "timestamp_hour") -> DataFrame:
    t = F.col(ts)
    wd = weekday(t)
    return df.withColumns({
        "hour": F.hour(t),
        "weekday": wd,
        "month": F.month(t),
        "quarter": F.quarter(t),
        "week_of_year": F.weekofyear(t),
        "is_weekend": wd.isin(5, 6).cast("int"),
        "is_friday_saturday": wd.isin(4, 5).cast("int"),
    })


def add_cyclic(df: DataFrame, parts: dict[str, int] | None = None) -> DataFrame:
    parts = parts or {"hour": 24, "weekday": 7, "month": 12}
    cols = {}
    for name, period in parts.items():
        s, c = cyclic(name, period)
        cols[f"{name}_sin"] = s
        cols[f"{name}_cos"] = c
    return df.withColumns(cols)


def add_venue_windows(df: DataFrame, ts: str = "timestamp_hour", music_flag: str | None = None,
                      food_close: int = 21, breakfast_end: int = 15, lunch=(12, 14), dinner=(17, 20),
                      music_start: int = 22) -> DataFrame:
    h = F.hour(F.col(ts))
    music = (F.col(music_flag).cast("int") if music_flag and music_flag in df.columns
             else (h >= music_start).cast("int"))
    return df.withColumns({
        "is_food_service": (h < food_close).cast("int"),
        "is_breakfast_window": (h < breakfast_end).cast("int"),
        "is_lunch_window": h.between(*lunch).cast("int"),
        "is_dinner_window": h.between(*dinner).cast("int"),
        "is_after_food_close": (h >= food_close).cast("int"),
        "hours_since_food_close": F.greatest(h - food_close, F.lit(0)).cast("int"),
        "is_live_music_window": music,
    })


def music_hours(df: DataFrame, ts: str = "timestamp_hour") -> DataFrame:
    """Weekend-aware predicates: music Fri/Sat ≥22 or ≤1, other days 22–23;
    open Fri/Sat except 3–8 h, other days except 2–8 h."""
    t = F.col(ts)
    h, wd = F.hour(t), weekday(t)
    fri_sat = wd.isin(4, 5)
    return df.withColumns({
        "is_live_music_hour": F.when(fri_sat, (h >= 22) | (h <= 1)).otherwise(h.between(22, 23)).cast("int"),
        "bar_is_open": F.when(fri_sat, (h >= 9) | (h <= 2)).otherwise((h >= 9) | (h <= 1)).cast("int"),
    })
