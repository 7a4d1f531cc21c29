"""Rule-based expected demand (survey 2.K): the deterministic part of the
reference's demand model as column expressions over map literals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftcast.functions.timecols import col, weekday

# Base orders per open hour (average Tuesday, peak season).
BASE_ORDERS = {9: 8, 10: 12, 11: 20, 12: 42, 13: 55, 14: 48, 15: 28, 16: 22, 17: 30, 18: 42,
               19: 52, 20: 46, 21: 35, 22: 40, 23: 38, 0: 25, 1: 12}
# Share of orders that are food tickets, per hour.
FOOD_TICKET_RATIO = {9: 0.70, 10: 0.65, 11: 0.60, 12: 0.75, 13: 0.78, 14: 0.72, 15: 0.60, 16: 0.45,
                     17: 0.50, 18: 0.65, 19: 0.72, 20: 0.68, 21: 0.0, 22: 0.0, 23: 0.0, 0: 0.0, 1: 0.0}
# Weekday (Mon = 0) and month multipliers.
WEEKDAY_MULT = {0: 0.65, 1: 0.70, 2: 0.80, 3: 0.90, 4: 1.15, 5: 1.35, 6: 1.00}
MONTH_MULT = {1: 0.68, 2: 0.72, 3: 1.20, 4: 0.90, 5: 0.95, 6: 1.10, 7: 1.15, 8: 1.10, 9: 0.95,
              10: 0.90, 11: 0.80, 12: 1.15}


def lookup(mapping: dict, key) -> Column:
    """Map-literal lookup (NULL for a missing key); stays a JVM expression."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(float(v)))])
    return m[col(key)]


def _flag(df: DataFrame, name: str) -> Column:
    return (F.coalesce(F.col(name).cast("int"), F.lit(0)) > 0) if name in df.columns else F.lit(False)


def _num(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in df.columns else F.lit(0.0)


def weather_mult(temp_c, rain_mm) -> Column:
    t, r = col(temp_c), col(rain_mm)
    rain = F.when(r > 5, 0.90).when(r > 2, 0.95).otherwise(1.0)
    temp = F.when(t < 5, 1.05).when(t > 18, 1.08).otherwise(1.0)
    return rain * temp


def event_mult(df: DataFrame) -> Column:
    m = F.when(_flag(df, "st_patricks_week_flag"), 2.0).when(_flag(df, "city_event_flag"), 1.20).otherwise(1.0)
    for name, k in (("major_sports_event_flag", 1.35), ("bank_holiday_flag", 1.30),
                    ("cruise_ship_flag", 1.10), ("special_event_flag", 1.25)):
        m = m * F.when(_flag(df, name), k).otherwise(1.0)
    fc = _num(df, "failte_event_count")
    return m * F.when(fc > 10, 1.15).when(fc > 3, 1.05).otherwise(1.0)


def footfall_mult(count) -> Column:
    c = F.coalesce(col(count).cast("double"), F.lit(0.0))
    return F.when(c > 3000, 1.35).when(c > 2000, 1.20).when(c > 1000, 1.10).otherwise(1.0)


def live_music_mult(hour, wd, music_flag) -> Column:
    h, w = col(hour), col(wd)
    start = F.lit(22)
    end = F.when(w.isin(4, 5), 26).otherwise(24)
    on = (F.coalesce(col(music_flag).cast("int"), F.lit(0)) > 0) & (h >= 21) & (h >= start) & (h <= end)
    return F.when(on, 1.40).otherwise(1.0)


def expected_demand(df: DataFrame, ts: str = "timestamp_hour", temp_c: str = "temp_c", rain_mm: str = "rain_mm",
                    music_flag: str = "is_live_music_hour", footfall: str = "suffolk_nassau_footfall") -> DataFrame:
    """expected_orders = base[hour] × weekday × month × weather × events × music × footfall;
    expected_food_tickets = expected_orders × ratio[hour].  Unknown hours use base 10."""
    h, wd = F.hour(ts), weekday(ts)
    t = F.col(temp_c) if temp_c in df.columns else F.lit(10.0)
    r = F.col(rain_mm) if rain_mm in df.columns else F.lit(0.0)
    mf = F.col(music_flag) if music_flag in df.columns else F.lit(0)
    ff = F.col(footfall) if footfall in df.columns else F.lit(0)
    orders = (F.coalesce(lookup(BASE_ORDERS, h), F.lit(10.0)) * lookup(WEEKDAY_MULT, wd)
              * lookup(MONTH_MULT, F.month(ts)) * weather_mult(t, r) * event_mult(df)
              * live_music_mult(h, wd, mf) * footfall_mult(ff))
    return df.withColumns({
        "expected_orders": orders,
        "expected_food_tickets": orders * F.coalesce(lookup(FOOD_TICKET_RATIO, h), F.lit(0.0)),
    })


def fallback_chain(df: DataFrame, column: str, hourly: DataFrame | None, daily: DataFrame | None,
                   ts: str = "timestamp_hour", default: Column | None = None) -> DataFrame:
    """Real hourly value, else real daily value, else ``default`` (a synthetic value)."""
    out = df
    cands = []
    if hourly is not None:
        out = out.join(hourly.select(F.col(ts), F.col(column).alias("_hourly")), ts, "left")
        cands.append(F.col("_hourly"))
    if daily is not None:
        out = out.withColumn("_d", F.to_date(ts)).join(
            daily.select(F.col("date").alias("_d"), F.col(column).alias("_daily")), "_d", "left").drop("_d")
        cands.append(F.col("_daily"))
    if column in df.columns:
        cands.append(F.col(column))
    if default is not None:
        cands.append(default)
    return out.withColumn(column, F.coalesce(*cands)).drop("_hourly", "_daily")
