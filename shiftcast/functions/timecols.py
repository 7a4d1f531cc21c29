"""Column expressions on naive (TIMESTAMP_NTZ) time columns.

All of them are JVM built-ins, so they stay inside whole-stage codegen and do
not depend on the session time zone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def floor_hour(ts) -> Column:
    """Truncate a naive timestamp to the hour and keep it naive."""
    t = col(ts)
    return F.make_timestamp_ntz(F.year(t), F.month(t), F.dayofmonth(t), F.hour(t),
                                F.lit(0), F.lit(0))


def weekday(ts) -> Column:
    """Day of week with Monday = 0 … Sunday = 6."""
    return ((F.dayofweek(col(ts)) + 5) % 7).cast("int")


def is_open_hour(hour, open_from: int = 9, close_after_midnight: int = 1) -> Column:
    """Service hours: ``open_from`` … 23 and 0 … ``close_after_midnight``."""
    h = col(hour)
    return ((h >= open_from) & (h <= 23)) | (h <= close_after_midnight)


def truthy(c, values=("true", "yes", "1", "food")) -> Column:
    """1 when the lower-cased text is one of ``values``, else 0 (null → 0)."""
    return F.coalesce(F.lower(col(c).cast("string")).isin(*values).cast("int"), F.lit(0))


def cyclic(x, period: int) -> tuple[Column, Column]:
    a = 2 * math.pi * col(x) / F.lit(period)
    return F.sin(a), F.cos(a)


def hour_index(ts) -> Column:
    """Whole hours since 1970-01-01 00:00 of a naive timestamp (TZ free)."""
    t = col(ts)
    return (F.datediff(F.to_date(t), F.lit("1970-01-01").cast("date")).cast("long") * 24
            + F.hour(t))
