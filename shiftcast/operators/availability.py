"""Feature availability classes (survey F8, A14) and ablation groups.

SAFE columns are known the evening before (lags ≥ 24 h, calendars, forecasts);
FULL adds same-day momentum for nowcasting.  A leakage property test checks
that SAFE features at time T do not change when data after T is removed.
"""

from __future__ import annotations

from collections.abc import Sequence

# Features usable for next-day forecasts.
SAFE_FOR_NEXT_DAY = (
    "orders_count_lag_24h", "orders_count_lag_48h",
    "orders_count_lag_168h", "orders_count_lag_336h",
    "food_tickets_count_lag_24h", "food_tickets_count_lag_48h",
    "food_tickets_count_lag_168h", "food_tickets_count_lag_336h",
    "orders_count_roll_mean_24", "orders_count_roll_mean_168",
    "orders_count_roll_std_24",
    "food_tickets_count_roll_mean_24", "food_tickets_count_roll_mean_168",
    "hour", "weekday", "month", "quarter", "is_weekend", "is_friday_saturday",
    "week_of_year", "bank_holiday_flag", "school_holiday_flag", "payday_period_flag",
    "hour_sin", "hour_cos", "weekday_sin", "weekday_cos", "month_sin", "month_cos",
    "is_food_service", "is_breakfast_window", "is_lunch_window",
    "is_dinner_window", "is_after_food_close", "hours_since_food_close",
    "is_live_music_window",
    "temp_c", "rain_mm", "wind_speed_kmh", "weather_severity_flag",
    "airport_arrivals", "airport_arrivals_lag1", "airport_arrivals_zscore",
    "cruise_ship_flag", "ships_in_port_count", "cruise_passenger_estimate",
    "major_sports_event_flag", "city_event_flag", "st_patricks_week_flag",
    "special_event_flag", "event_intensity", "tourism_pressure",
    "weekend_x_music", "rain_x_weekend",
    "aviva_event_flag", "croke_park_event_flag", "nearby_venue_event_flag",
    "event_impact_score",
    "bloomsday_flag", "bloomsday_week_flag", "summer_tourism_flag",
    "christmas_market_flag", "new_years_eve_flag", "new_years_day_flag",
    "college_term_flag", "days_from_payday",
    "failte_event_count", "failte_free_event_count", "failte_festival_count",
    "suffolk_footfall_lag_24h", "suffolk_footfall_lag_168h",
    "suffolk_footfall_roll_24h",
    "orders_count_same_slot_4w_avg",
    "food_tickets_count_same_slot_4w_avg",
)
# Extra same-day features for nowcasting.
NOWCAST_EXTRA = (
    "orders_count_lag_1", "orders_count_lag_2", "orders_count_lag_3",
    "food_tickets_count_lag_1", "food_tickets_count_lag_2", "food_tickets_count_lag_3",
    "orders_count_roll_mean_3", "orders_count_roll_mean_6", "orders_count_roll_mean_12",
    "food_tickets_count_roll_mean_3", "food_tickets_count_roll_mean_6",
    "suffolk_nassau_footfall", "nearby_footfall_avg", "city_footfall_zscore",
    "suffolk_footfall_lag_1h", "suffolk_is_busy_flag",
)
FULL_FEATURES = SAFE_FOR_NEXT_DAY + NOWCAST_EXTRA

# Cumulative ablation groups.
TEMPORAL = (
    "orders_count_lag_24h", "orders_count_lag_48h", "orders_count_lag_168h", "orders_count_lag_336h",
    "food_tickets_count_lag_24h", "food_tickets_count_lag_48h", "food_tickets_count_lag_168h",
    "food_tickets_count_lag_336h", "orders_count_roll_mean_24", "orders_count_roll_mean_168",
    "orders_count_roll_std_24", "food_tickets_count_roll_mean_24", "food_tickets_count_roll_mean_168",
    "hour", "weekday", "month", "quarter", "is_weekend", "is_friday_saturday", "week_of_year",
    "hour_sin", "hour_cos", "weekday_sin", "weekday_cos", "month_sin", "month_cos",
    "is_food_service", "is_breakfast_window", "is_lunch_window", "is_dinner_window", "is_after_food_close",
    "hours_since_food_close", "is_live_music_window", "weekend_x_music",
)
WEATHER = ("temp_c", "rain_mm", "wind_speed_kmh", "weather_severity_flag", "rain_x_weekend")
EVENTS = (
    "major_sports_event_flag", "city_event_flag", "st_patricks_week_flag", "special_event_flag", "event_intensity",
    "aviva_event_flag", "croke_park_event_flag", "nearby_venue_event_flag", "event_impact_score",
    "bloomsday_flag", "bloomsday_week_flag", "summer_tourism_flag", "christmas_market_flag", "new_years_eve_flag",
    "new_years_day_flag", "bank_holiday_flag", "school_holiday_flag",
)
FOOTFALL = ("suffolk_footfall_lag_24h", "suffolk_footfall_lag_168h", "suffolk_footfall_roll_24h")
AIRPORT_CRUISE = ("airport_arrivals", "airport_arrivals_lag1", "airport_arrivals_zscore", "cruise_ship_flag",
                  "ships_in_port_count", "cruise_passenger_estimate")
PROXIES = ("failte_event_count", "failte_free_event_count", "failte_festival_count", "college_term_flag",
           "days_from_payday")
ABLATION_GROUPS = {
    "A1: Temporal": TEMPORAL,
    "A2: +Weather": TEMPORAL + WEATHER,
    "A3: +Events": TEMPORAL + WEATHER + EVENTS,
    "A4: +Footfall": TEMPORAL + WEATHER + EVENTS + FOOTFALL,
    "A5: +Airport/Cruise": TEMPORAL + WEATHER + EVENTS + FOOTFALL + AIRPORT_CRUISE,
    "A6: +Failte/Proxies": TEMPORAL + WEATHER + EVENTS + FOOTFALL + AIRPORT_CRUISE + PROXIES,
}


def feature_cols(columns: Sequence[str], wanted: Sequence[str]) -> list[str]:
    """The wanted features that exist, in list order."""
    have = set(columns)
    return [c for c in wanted if c in have]


def feature_columns_by_exclusion(columns: Sequence[str], targets: Sequence[str]) -> list[str]:
    """Everything except targets, time and raw/operational columns (exclusion rule)."""
    exclude = {"timestamp_hour", *targets, "sales_total", "covers_count", "busy_label", "bar_staff_count",
               "kitchen_staff_count", "stockout_flag", "menu_change_flag", "promo_flag", "live_music_flag",
               "hour", "weekday", "month", "is_weekend"}
    return [c for c in columns if c not in exclude]
