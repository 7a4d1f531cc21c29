import datetime as dt

from pyspark.sql import functions as F

from shiftcast.functions import calendar as CAL
from shiftcast.operators import calendars as C


def _spine(spark, start, end):
    b = spark.createDataFrame([(dt.date.fromisoformat(start), dt.date.fromisoformat(end))], "start date, end date")
    return C.date_spine(b)


def test_payday_fixture_excerpt(spark):
    got = C.payday_calendar(_spine(spark, "2023-01-01", "2023-01-03")).orderBy("date").collect()
    assert [(r.payday_period_flag, r.days_from_payday) for r in got] == [(1, -4), (1, -3), (1, -2)]


def test_bank_holidays_2023_2026(spark):
    hol = C.bank_holidays(_spine(spark, "2023-01-01", "2026-12-31")).collect()
    assert len(hol) == 40
    named = {r.date.isoformat(): r.holiday_name for r in hol}
    assert named["2023-02-06"] == "Saint Brigid's Day"
    assert named["2024-04-01"] == "Easter Monday"
    assert named["2025-10-27"] == "October Bank Holiday"
    assert named["2023-12-26"] == "Saint Stephen's Day"


def test_brigid_friday_rule_and_before_2023(spark):
    hol = {r.date.isoformat() for r in C.bank_holidays(_spine(spark, "2022-01-01", "2030-12-31")).collect()}
    assert "2030-02-01" in hol and "2030-02-04" not in hol   # 1 Feb 2030 is a Friday
    assert not any(d.startswith("2022-02") for d in hol)     # rule starts in 2023


def test_easter_dates(spark):
    df = spark.createDataFrame([(y,) for y in (2024, 2025, 2026, 1995, 2000)], "y int")
    got = {r.y: r.e.isoformat() for r in df.select("y", CAL.easter_sunday("y").alias("e")).collect()}
    assert got == {2024: "2024-03-31", 2025: "2025-04-20", 2026: "2026-04-05", 1995: "1995-04-16",
                   2000: "2000-04-23"}


def test_school_college_annual(spark):
    sp = _spine(spark, "2024-01-01", "2024-12-31")
    s = {r.date.isoformat(): r.school_holiday_flag for r in C.school_calendar(sp).collect()}
    assert s["2024-03-29"] == 1 and s["2024-04-11"] == 1 and s["2024-04-12"] == 0   # Good Friday … Easter+11
    assert s["2024-02-29"] == 0 and s["2024-06-25"] == 1 and s["2024-06-24"] == 0
    c = {r.date.isoformat(): r.college_term_flag for r in C.college_calendar(sp).collect()}
    assert c["2024-04-28"] == 1 and c["2024-04-29"] == 0 and c["2024-05-29"] == 1
    a = {r.date.isoformat(): r for r in C.annual_calendar(sp).collect()}
    assert a["2024-03-13"].st_patricks_week_flag == 1 and a["2024-06-16"].bloomsday_flag == 1
    assert a["2024-12-31"].new_years_eve_flag == 1 and a["2024-11-20"].christmas_market_flag == 1


def test_time_parts_iso_week_and_weekday(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 12, 30, 9),), (dt.datetime(2024, 2, 29, 23),)], "timestamp_hour timestamp_ntz")
    got = {r.timestamp_hour.date().isoformat(): r for r in C.add_time_parts(df).collect()}
    assert got["2024-12-30"].week_of_year == 1 and got["2024-12-30"].weekday == 0
    assert got["2024-02-29"].weekday == 3 and got["2024-02-29"].quarter == 1


def test_event_day_rollup_order_and_scores(spark):
    ev = spark.createDataFrame([
        (dt.date(2026, 7, 4), "B", "Croke Park", "high", 2),
        (dt.date(2026, 7, 4), "A", "Aviva Stadium", "weird", 1),
        (dt.date(2026, 7, 5), "C", "3Arena", "low", 3)], "date date, event_name string, venue string, impact string, seq int")
    flags = {"aviva_event_flag": ["Aviva Stadium"], "croke_park_event_flag": ["Croke Park"],
             "nearby_venue_event_flag": ["3Arena", "RDS"]}
    got = {r.date.isoformat(): r for r in C.event_day_rollup(ev, seq="seq", venue_flags=flags).collect()}
    assert got["2026-07-04"].event_names == "A | B"
    assert got["2026-07-04"].event_impact_score == 3 and got["2026-07-05"].event_impact_score == 1
    assert (got["2026-07-04"].aviva_event_flag, got["2026-07-05"].nearby_venue_event_flag) == (1, 1)


def test_venue_and_music_hours(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 5, h),) for h in (0, 1, 2, 12, 21, 22)], "timestamp_hour timestamp_ntz")
    v = {r.timestamp_hour.hour: r for r in C.music_hours(C.add_venue_windows(df)).collect()}
    assert v[0].is_food_service == 1 and v[22].hours_since_food_close == 1 and v[0].hours_since_food_close == 0
    assert v[1].is_live_music_hour == 1 and v[2].bar_is_open == 1   # Friday night
