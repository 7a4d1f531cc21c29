"""The feature-table job (survey F7): panel → per-target lags and rolling
statistics → daily and hourly enrichment → calendar, venue and external
columns → interactions → optional warm-up drop.

All per-target windows share one ``PARTITION BY keys ORDER BY ts`` spec, so
the whole table needs one shuffle on the keys and one sort.  The windows run
before the joins (they only read the targets), so the window operator buffers
narrow rows; the signal joins afterwards are broadcasts of date/hour tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftcast.operators import calendars as C
from shiftcast.operators import enrich as E
from shiftcast.operators import features as FT
from shiftcast.session import key_partitions

# External signal columns that are coerced to numbers and zero-filled.
EXTERNAL_COLS = (
    "temp_c", "rain_mm", "wind_speed_kmh", "weather_severity_flag",
    "airport_arrivals", "airport_arrivals_lag1",
    "cruise_ship_flag", "ships_in_port_count", "cruise_passenger_estimate",
    "school_holiday_flag", "payday_period_flag", "days_from_payday",
    "college_term_flag", "bloomsday_flag", "bloomsday_week_flag",
    "summer_tourism_flag", "christmas_market_flag",
    "new_years_eve_flag", "new_years_day_flag",
    "major_sports_event_flag", "city_event_flag", "st_patricks_week_flag",
    "aviva_event_flag", "croke_park_event_flag", "nearby_venue_event_flag",
    "event_impact_score",
    "failte_event_count", "failte_free_event_count", "failte_festival_count",
    "special_event_flag",
    "suffolk_nassau_footfall", "nearby_footfall_avg", "nearby_footfall_sum",
    "city_footfall_zscore",
    "suffolk_footfall_lag_1h", "suffolk_footfall_lag_24h", "suffolk_footfall_lag_168h",
    "suffolk_footfall_roll_24h", "suffolk_is_busy_flag",
)
FAILTE_COLS = ("failte_event_count", "failte_free_event_count", "failte_festival_count")


def build_feature_table(panel: DataFrame, keys: Sequence[str] = (), ts: str = "timestamp_hour",
                        targets: Sequence[str] = ("orders_count", "food_tickets_count"),
                        enrichment: DataFrame | None = None, failte: DataFrame | None = None,
                        footfall: DataFrame | None = None, weather: DataFrame | None = None,
                        drop_na: bool = True, music_flag: str | None = "live_music_flag",
                        signal_rows: int | None = None, daily_rows: int | None = None, unique_signals: bool = False,
                        panel_rows: int | None = None) -> DataFrame:
    """``signal_rows``: proven row bound of the footfall / weather tables
    (one row per hour or day of their range); ``daily_rows`` that of the daily
    tables; they enable broadcasting.  Signals that carry some of ``keys`` join
    on them, others hold for every key.  ``unique_signals``: they have one row per join key
    (:func:`enrich.stored_signal` sees to it).  ``panel_rows``: upper bound of the panel's rows; the narrow
    panel is then dealt by ``keys`` into parts of about ``session.TASK_ROWS`` rows, which later windows and
    groupings on the keys reuse, so a task's memory does not grow with the panel."""
    keys = list(keys)
    rows = panel.repartition(key_partitions(panel.sparkSession, panel_rows), *keys) if keys and panel_rows is not None else panel
    # 1. all windows first, on the narrow panel: every lag / rolling column of
    #    every target in one sorted pass that buffers only (keys, ts, targets)
    have = [t for t in targets if t in panel.columns]
    df = FT.add_rolling_features(FT.add_lag_features(rows, have, keys, ts), have, keys, ts)
    df = df.select(*panel.columns, *[c for t in have for c in df.columns if c not in panel.columns and c.startswith(f"{t}_")])
    # 2. then the signal joins: broadcasts of date / hour dimensions, no shuffle
    if enrichment is not None:
        df = E.merge_daily_replace(df, enrichment, ts, daily_rows, keys, unique_signals)
    if failte is not None:
        df = E.merge_daily_replace(df, failte, ts, daily_rows, keys, unique_signals)
        df = df.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("int") for c in FAILTE_COLS if c in df.columns})
    df = E.merge_hourly(df, footfall, weather, ts, bound_rows=signal_rows, keys=keys, unique=unique_signals)
    df = C.add_cyclic(C.add_time_parts(df, ts))
    # single source for the holiday flag: the rule set, evaluated once per date
    hol = C.calendar_dimension(panel, ts, holidays_only=True).withColumnRenamed("date", "_hdate")
    df = E.join_dimension(df.drop("bank_holiday_flag").withColumn("_hdate", F.to_date(ts)), hol, "_hdate", "left",
                          bound_rows=E.MAX_DAYS).drop("_hdate")
    df = C.add_venue_windows(df, ts, music_flag=music_flag)
    df = E.coerce_zero_fill(df, EXTERNAL_COLS)
    if "airport_arrivals" in df.columns:
        df = E.zscore(df, "airport_arrivals", "airport_arrivals_zscore", keys)
    df = FT.add_interactions(df)
    return FT.warmup_drop(df) if drop_na else df
