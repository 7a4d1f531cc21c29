"""Incremental feature refresh (survey A6, L1): only the days that changed rows can reach are rebuilt.

A feature of a row looks back at most ``reach_rows`` rows of its key and ``reach_hours`` by
the clock.  So a new, late or corrected row changes the features of the rows up to that far
after it; the days of these are rebuilt, for all keys, from the rows up to that far before
them, and replace the day partitions of the table.  Both reaches are keyed windows on the
panel; which days that are is a table bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftcast.operators.horizon import TAIL_HOURS, TAIL_ROWS
from shiftcast.session import cut_lineage
from shiftcast.sources.ingest import write_parquet


def _near(flag: str, keys: Sequence[str], ts: str, rows: int, hours: int, ahead: bool) -> Column:
    """Whether ``flag`` holds for the row itself or one of the rows within reach before (or ``ahead``: after) it."""
    by = ", ".join(f"`{k}`" for k in keys)
    over = f"{'PARTITION BY ' + by if by else ''} ORDER BY `{ts}`"
    side = "FOLLOWING" if ahead else "PRECEDING"
    ends = ("CURRENT ROW AND {}" if ahead else "{} AND CURRENT ROW")
    by_rows = ends.format(f"{rows} {side}")
    by_clock = ends.format(f"INTERVAL {hours} HOURS {side}")
    return F.expr(f"greatest(max({flag}) OVER ({over} ROWS BETWEEN {by_rows}), max({flag}) OVER ({over} RANGE BETWEEN {by_clock}))")


def reached_days(panel: DataFrame, changed: DataFrame, keys: Sequence[str] = (), ts: str = "timestamp_hour", rows: int = TAIL_ROWS,
                 hours: int = TAIL_HOURS) -> DataFrame:
    """(date) of all days with a row that changes of ``changed`` (date, and those of ``keys`` that it has) can reach."""
    by = list(keys) or ["_series"]
    df = panel if keys else panel.withColumn("_series", F.lit(0))
    on = [*[k for k in keys if k in changed.columns], "_date"]
    marks = changed.select(*on[:-1], F.col("date").alias("_date")).distinct().withColumn("_new", F.lit(1))
    marked = df.select(*by, ts, F.to_date(ts).alias("_date")).join(marks, on, "left").withColumn("_new", F.coalesce("_new", F.lit(0)))
    touched = marked.withColumn("_hit", _near("_new", by, ts, rows, hours, ahead=False)).where("_hit = 1")
    # a day whose last row went is rewritten as well
    return touched.select(F.col("_date").alias("date")).unionByName(changed.select("date")).distinct()


def needed_rows(panel: DataFrame, days: DataFrame, keys: Sequence[str] = (), ts: str = "timestamp_hour", rows: int = TAIL_ROWS,
                hours: int = TAIL_HOURS) -> DataFrame:
    """The rows that features of the ``days`` read."""
    by = list(keys) or ["_series"]
    df = panel if keys else panel.withColumn("_series", F.lit(0))
    marks = days.select(F.col("date").alias("_date")).withColumn("_new", F.lit(1))
    marked = df.withColumn("_date", F.to_date(ts)).join(marks, "_date", "left").withColumn("_new", F.coalesce("_new", F.lit(0)))
    return marked.withColumn("_hit", _near("_new", by, ts, rows, hours, ahead=True)).where("_hit = 1").select(*panel.columns)


def refresh_days(panel: DataFrame, changed: DataFrame, build: Callable[[DataFrame], DataFrame], path: str, keys: Sequence[str] = (),
                 ts: str = "timestamp_hour", rows: int = TAIL_ROWS, hours: int = TAIL_HOURS) -> DataFrame:
    """Rebuild the days that ``changed`` reaches and replace their partitions (``date=...``) of the table at ``path``.

    ``build`` makes the features of a panel from each row's own past within the reach (whole-sample
    statistics don't belong here: their as-of variants do).  Returns the days that were rebuilt.
    """
    days = cut_lineage(reached_days(panel, changed, keys, ts, rows, hours))
    made = build(needed_rows(panel, days, keys, ts, rows, hours)).withColumn("date", F.to_date(ts))
    write_parquet(made.join(days, "date", "left_semi"), path, ["date"])
    return days
