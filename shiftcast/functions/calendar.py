"""Calendar rules as column expressions on a DATE column.

Every rule is a pure built-in expression, so a calendar flag costs one
projection: no lookup table, no join, no shuffle.  The date-range tables in
``shiftcast.operators.calendars`` are just a date spine with these columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shiftcast.functions.timecols import col


def _div(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b)).cast("int")


def easter_sunday(year) -> Column:
    """Gregorian Easter Sunday (anonymous computus) in integer column math."""
    y = col(year).cast("int")
    a = y % 19
    b = _div(y, 100)
    c = y % 100
    d = _div(b, 4)
    e = b % 4
    f = _div(b + 8, 25)
    g = _div(b - f + 1, 3)
    h = (19 * a + b - d - g + 15) % 30
    i = _div(c, 4)
    k = c % 4
    l_ = (32 + 2 * e + 2 * i - h - k) % 7
    m = _div(a + 11 * h + 22 * l_, 451)
    n = h + l_ - 7 * m + 114
    return F.make_date(y, _div(n, 31), (n % 31) + 1)


def _md(d: Column) -> Column:
    return F.month(d) * 100 + F.dayofmonth(d)


def _in_md(d: Column, lo: int, hi: int) -> Column:
    md = _md(d)
    return (md >= lo) & (md <= hi)


def _weekday(d: Column) -> Column:
    return (F.dayofweek(d) + 5) % 7  # Monday = 0


def payday_flag(d) -> Column:
    dom = F.dayofmonth(col(d))
    return ((dom >= 25) | (dom <= 5)).cast("int")


def days_from_payday(d) -> Column:
    dom = F.dayofmonth(col(d))
    return F.when(dom >= 25, dom - 25).otherwise(dom - 5).cast("int")


def school_holiday_flag(d) -> Column:
    x = col(d)
    easter = easter_sunday(F.year(x))
    # Fixed values (month*100+day, inclusive): summer, Christmas (two parts),
    # October mid-term, February mid-term.  Plus Good Friday … Easter + 11.
    fixed = (_in_md(x, 625, 831) | _in_md(x, 1223, 1231) | _in_md(x, 101, 106)
             | _in_md(x, 1026, 1101) | _in_md(x, 216, 220))
    easter_break = (x >= F.date_sub(easter, 2)) & (x <= F.date_add(easter, 11))
    return (fixed | easter_break).cast("int")


def college_term_flag(d) -> Column:
    x = col(d)
    # Terms 7 Sep–12 Dec, 15 Jan–28 Apr, 1–29 May.
    return (_in_md(x, 907, 1212) | _in_md(x, 115, 428) | _in_md(x, 501, 529)).cast("int")


def annual_flags(d) -> dict[str, Column]:
    x = col(d)
    m, dom = F.month(x), F.dayofmonth(x)
    return {
        "st_patricks_week_flag": _in_md(x, 313, 317).cast("int"),
        "bloomsday_flag": ((m == 6) & (dom == 16)).cast("int"),
        "bloomsday_week_flag": _in_md(x, 611, 616).cast("int"),
        "summer_tourism_flag": (((m == 6) & (dom >= 20)) | m.isin(7, 8)).cast("int"),
        "christmas_market_flag": (((m == 11) & (dom >= 20)) | ((m == 12) & (dom <= 23))).cast("int"),
        "new_years_eve_flag": ((m == 12) & (dom == 31)).cast("int"),
        "new_years_day_flag": ((m == 1) & (dom == 1)).cast("int"),
    }


def bank_holiday_name(d, brigid_from_year: int = 2023) -> Column:
    """Irish public holiday name of a date, NULL on other days (no observed-day shift)."""
    x = col(d)
    y, m, dom, wd = F.year(x), F.month(x), F.dayofmonth(x), _weekday(x)
    monday = wd == 0
    first_monday = monday & (dom <= 7)
    easter = easter_sunday(y)
    feb1_friday = _weekday(F.make_date(y, F.lit(2), F.lit(1))) == 4
    brigid = (y >= brigid_from_year) & (m == 2) & (
        (feb1_friday & (dom == 1)) | (~feb1_friday & first_monday))
    # Holiday names.
    return (F.when((m == 1) & (dom == 1), "New Year's Day")
            .when(brigid, "Saint Brigid's Day")
            .when((m == 3) & (dom == 17), "Saint Patrick's Day")
            .when(x == F.date_add(easter, 1), "Easter Monday")
            .when((m == 5) & first_monday, "May Day")
            .when((m == 6) & first_monday, "June Bank Holiday")
            .when((m == 8) & first_monday, "August Bank Holiday")
            .when((m == 10) & monday & (dom >= 25), "October Bank Holiday")
            .when((m == 12) & (dom == 25), "Christmas Day")
            .when((m == 12) & (dom == 26), "Saint Stephen's Day"))


def bank_holiday_flag(d, brigid_from_year: int = 2023) -> Column:
    return bank_holiday_name(d, brigid_from_year).isNotNull().cast("int")
