"""Raw transaction rows → clean hourly panel (survey 2.B).

Every function is ``DataFrame -> DataFrame`` and keyed: ``keys`` are entity
columns (venue, sensor, …) and may be empty for a single series.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftcast.functions.timecols import col, floor_hour, is_open_hour, truthy

# Fixed values that must equal the reference for the same audit result:
# substrings that mark a column as personal or payment data.
PII_PATTERNS = (
    "name", "staff", "employee", "operator", "cashier", "server",
    "customer", "member", "loyalty", "card", "pan", "last4", "last_4",
    "payment_ref", "transaction_id", "txn_id", "receipt", "auth_code",
    "email", "phone", "mobile", "address", "postcode", "eircode",
    "ip_", "device_id", "terminal_id",
)
# Substrings that mark a timestamp column and a food-flag column.
TIMESTAMP_HINTS = ("time", "date", "datetime", "created", "opened", "ts")
FOOD_HINTS = ("food", "kitchen", "ticket", "meal", "cover")

PANEL_COLUMNS = ("timestamp_hour", "orders_count", "food_tickets_count")


def _norm(name: str) -> str:
    return name.lower().replace(" ", "_")


def pii_match(column: str, token_boundary: bool = False) -> str | None:
    """First PII pattern found in ``column`` (substring rule, or whole tokens)."""
    c = _norm(column)
    for pat in PII_PATTERNS:
        if token_boundary:
            if re.search(r"(^|_)" + re.escape(pat.strip("_")) + r"($|_)", c):
                return pat
        elif pat in c:
            return pat
    return None


def pii_audit(tables: dict[str, DataFrame], token_boundary: bool = False) -> DataFrame | None:
    """(table, column, pattern, n_values) for every flagged column: how many rows hold a value there.

    One scan per table that reads the flagged columns only; None if no column is flagged.
    """
    out = None
    for name, df in tables.items():
        found = [(c, p) for c in df.columns if (p := pii_match(c, token_boundary)) is not None]
        if not found:
            continue
        counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, (c, _) in enumerate(found)])
        rows = counts.select(F.inline(F.array(*[
            F.struct(F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), F.lit(p).alias("pattern"),
                     F.col(f"n{i}").alias("n_values")) for i, (c, p) in enumerate(found)])))
        out = rows if out is None else out.unionByName(rows)
    return out


def drop_pii(df: DataFrame, protect: Sequence[str] = (), token_boundary: bool = False) -> DataFrame:
    flagged = [c for c in df.columns if c not in protect and pii_match(c, token_boundary)]
    return df.drop(*flagged)


def detect_timestamp_col(columns: Sequence[str]) -> str:
    for c in columns:
        if any(k in c.lower() for k in TIMESTAMP_HINTS):
            return c
    raise ValueError(f"no timestamp-like column among {list(columns)}")


def detect_food_col(columns: Sequence[str]) -> str | None:
    for c in columns:
        if any(k in c.lower() for k in FOOD_HINTS):
            return c
    return None


def coerce_timestamp(c, formats: Sequence[str] = ()) -> Column:
    """Parse text to a naive timestamp; unparseable → NULL (never an error)."""
    x = col(c)
    if not formats:
        return F.try_to_timestamp(x.cast("string")).cast("timestamp_ntz")
    return F.coalesce(*[F.try_to_timestamp(x.cast("string"), F.lit(f)) for f in formats]).cast("timestamp_ntz")


def coerce_number(c, to: str = "double") -> Column:
    return col(c).try_cast(to)


def hourly_rollup(df: DataFrame, ts: str | Column, flag: str | Column | None = None,
                  keys: Sequence[str] = (), weight: str | Column | None = None,
                  sums: dict[str, str | Column] | None = None,
                  open_from: int = 9, close_after_midnight: int = 1,
                  food_from: int = 9, food_until: int = 21) -> DataFrame:
    """Raw rows → one row per (keys, open hour): ``orders_count``, ``food_tickets_count``.

    * rows with an unparseable time are dropped,
    * time floored to the hour, only service hours kept,
    * flag counted with the truthy rule, or estimated as food hours when absent,
    * food tickets forced to 0 outside food hours,
    * ``weight`` turns the count into a sum (pre-aggregated exports),
    * ``sums`` adds extra summed columns (e.g. sales).

    Plan: one partial+final hash aggregate on (keys, hour); the map side
    collapses a hot key to one row per hour before the shuffle.
    """
    keys = list(keys)
    t = col(ts)
    if isinstance(ts, str) and dict(df.dtypes).get(ts) == "string":
        t = coerce_timestamp(ts)
    staged = df.select(*keys, floor_hour(t).alias("timestamp_hour"),
                       (truthy(flag) if flag is not None else F.lit(None)).alias("_flag"),
                       (col(weight).cast("long") if weight is not None else F.lit(1)).alias("_w"),
                       *[col(v).alias(k) for k, v in (sums or {}).items()])
    h = F.hour("timestamp_hour")
    staged = staged.filter(F.col("timestamp_hour").isNotNull() & is_open_hour(h, open_from, close_after_midnight))
    food_hours = (h >= food_from) & (h < food_until)
    is_food = F.col("_flag") if flag is not None else food_hours.cast("int")
    agg = (staged.groupBy(*keys, "timestamp_hour")
           .agg(F.sum("_w").cast("long").alias("orders_count"),
                F.sum(is_food * F.col("_w")).cast("long").alias("food_tickets_count"),
                *[F.sum(k).alias(k) for k in (sums or {})]))
    return agg.select(*keys, "timestamp_hour", "orders_count",
                      F.when(F.hour("timestamp_hour").between(food_from, food_until - 1),
                             F.col("food_tickets_count")).otherwise(F.lit(0)).cast("long")
                      .alias("food_tickets_count"),
                      *list(sums or {}))


def sanitize(df: DataFrame, timestamp_col: str | None = None, food_col: str | None = None,
             keys: Sequence[str] = (), token_boundary: bool = False) -> DataFrame:
    """Detect columns, drop PII (never the time column), roll up, allow-list."""
    ts = timestamp_col or detect_timestamp_col(df.columns)
    food = food_col or detect_food_col(df.columns)
    clean = drop_pii(df, protect=[ts, *([food] if food else []), *keys], token_boundary=token_boundary)
    out = hourly_rollup(clean, ts, food, keys=keys)
    return out.select(*keys, *PANEL_COLUMNS)


def panel_summary(panel: DataFrame, keys: Sequence[str] = (), value: str = "orders_count",
                  food: str = "food_tickets_count") -> DataFrame:
    return panel.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("timestamp_hour").alias("ts_min"),
        F.max("timestamp_hour").alias("ts_max"),
        F.round(F.avg(F.col(value).cast("double")), 6).alias("mean_orders"),
        F.round(F.avg(F.when(F.col(food) > 0, F.col(food).cast("double"))), 6).alias("mean_food_positive"),
    )


def range_filter(df: DataFrame, ts: str, start: str, end: str, hourly: bool = True) -> DataFrame:
    """Inclusive date range; for hourly data the end is end-date 23:00."""
    lo = F.lit(start).cast("timestamp_ntz")
    hi = F.lit(end).cast("timestamp_ntz")
    if hourly:
        hi = hi + F.expr("INTERVAL 23 HOURS")
    return df.filter((F.col(ts) >= lo) & (F.col(ts) <= hi))
