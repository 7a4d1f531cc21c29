"""Features as they are known at a forecast's origin (survey F8, A14, H13, H14).

* ``asof_pick``: an as-of join; both sides are united, dealt by their keys and sorted by
  time once, so a row never meets more than the one version it takes.
* ``point_in_time``: signals that carry ``known_at`` (a weather forecast, a booking count)
  give each target row the last version that was known at its origin.
* ``origin_statistics``: trailing statistics that end at the origin, not one row before
  the target, so the target's own day is never read.
* ``next_day_features``: the next day's rows with rebuilt features, from a tail of the history.
* ``scenario_rows``: a day's rows once for each scenario, scored together.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftcast.operators import features as FT
from shiftcast.operators import forecast as FC

#: Longest look-back of the features: four weeks by the clock and 168 rows.
TAIL_HOURS, TAIL_ROWS = 28 * 24, 168


def evening_before(ts: str = "timestamp_hour", hour: int = 18) -> Column:
    """The origin of a day's forecast: ``hour`` of the day before the row's date."""
    return F.timestamp_add("HOUR", F.lit(hour - 24), F.to_date(ts).cast("timestamp_ntz"))


def asof_pick(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, cols: Mapping[str, str]) -> DataFrame:
    """``left`` with columns of the last ``right`` row of the same ``by`` whose time is not after the left row's.

    ``cols`` maps a column of ``right`` to its new name; rows without such a row get nulls.  Of
    right rows of one time the largest by its columns counts.  Null keys never meet.
    """
    by = list(by)
    row, hit = F.struct(*left.columns), F.struct(*cols)
    kinds = {f.name: f.dataType for f in right.schema.fields}
    a = left.select(*by, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), row.alias("_row"), F.lit(None).cast(right.select(hit.alias("x")).schema["x"].dataType).alias("_hit"))
    b = right.select(*by, F.col(right_time).cast(left.schema[left_time].dataType).alias("_t"), F.lit(0).alias("_side"),
                     F.lit(None).cast(left.select(row.alias("x")).schema["x"].dataType).alias("_row"), hit.alias("_hit"))
    b = b.where(F.col("_t").isNotNull())
    seen = Window.partitionBy(*by).orderBy("_t", "_side", "_hit").rowsBetween(Window.unboundedPreceding, 0)
    met = a.unionByName(b).withColumn("_last", F.last("_hit", ignorenulls=True).over(seen)).where("_side = 1")
    known = F.lit(True)
    for k in by:
        known = known & F.col(k).isNotNull()
    return met.select("_row.*", *[F.when(known, F.col("_last")[c]).cast(kinds[c]).alias(new) for c, new in cols.items()])


def point_in_time(panel: DataFrame, signal: DataFrame, origin: Column, cols: Sequence[str], keys: Sequence[str] = (), ts: str = "timestamp_hour",
                  valid: str = "timestamp_hour", known_at: str = "known_at") -> DataFrame:
    """``panel`` with the ``cols`` of the signal's last version for the row's time that was known at its ``origin``.

    The signal has a row for each (keys that it has, ``valid``, ``known_at``); versions known later are not
    seen, and a row without a version known in time gets nulls.
    """
    on = [k for k in keys if k in signal.columns]
    named = signal.select(*on, F.col(valid).alias("_valid"), F.col(known_at).alias("_known"), *cols)
    kind = signal.schema[valid].dataType
    target = panel.drop(*cols).withColumn("_origin", origin).withColumn("_valid", F.col(ts).cast(kind))
    return asof_pick(target, named, [*on, "_valid"], "_origin", "_known", {c: c for c in cols}).drop("_origin", "_valid")


def origin_statistics(targets: DataFrame, history: DataFrame, value: str, origin: Column, keys: Sequence[str] = (), ts: str = "timestamp_hour",
                      spec: Mapping[str, tuple[int, str]] | None = None) -> DataFrame:
    """``targets`` with trailing statistics of ``history`` that end with the last row at or before each row's ``origin``.

    Names, widths and least counts are those of :func:`features.rolling_stats`.
    """
    spec = dict(spec or FT.ROLLING)
    base = FT.ordered_window(list(keys), ts)
    x, made = F.col(value), {}
    kinds: dict[str, Callable] = {"mean": F.avg, "std": F.stddev_samp, "max": F.max, "min": F.min, "sum": F.sum}
    for name, (w, how) in spec.items():
        frame = base.rowsBetween(-(w - 1), 0)
        made[f"{value}_{name}"] = F.when(F.count(x).over(frame) >= max(1, w // 4), kinds[how](x).over(frame))
    ended = history.select(*keys, ts, value).withColumns(made).select(*keys, F.col(ts).alias("_at"), *made)
    by = list(keys)
    rows = targets.drop(*made).withColumn("_origin", origin)
    if not by:  # one series
        by, rows, ended = ["_series"], rows.withColumn("_series", F.lit(0)), ended.withColumn("_series", F.lit(0))
    return asof_pick(rows, ended, by, "_origin", "_at", {c: c for c in made}).drop("_origin", "_series")


def history_tail(history: DataFrame, keys: Sequence[str] = (), ts: str = "timestamp_hour", hours: int = TAIL_HOURS, rows: int = TAIL_ROWS) -> DataFrame:
    """Each key's rows that features of the next day can reach: ``hours`` before its last row and the last ``rows``."""
    by = list(keys) or ["_series"]
    df = history if keys else history.withColumn("_series", F.lit(0))
    last = F.max(ts).over(Window.partitionBy(*by))
    late = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(ts).desc()))
    marked = df.withColumns({"_last": last, "_late": late})
    near = F.col(ts) >= F.timestamp_add("HOUR", F.lit(-hours), F.col("_last"))
    return marked.where(near | (F.col("_late") <= rows)).select(*history.columns)


def next_day_features(history: DataFrame, build: Callable[[DataFrame], DataFrame], keys: Sequence[str] = (), ts: str = "timestamp_hour",
                      carry: Sequence[str] = (), targets: Sequence[str] = ("orders_count", "food_tickets_count"), tail: bool = True) -> DataFrame:
    """The features of the day after each key's last row.

    The day's open hours are appended without targets and with the last known value of the ``carry`` columns, and
    ``build`` (say, the feature table) runs on them and the tail of the history only; ``tail=False`` rebuilds
    all of it, with the same result.
    """
    keys = list(keys)
    past = history_tail(history, keys, ts) if tail else history
    stub = FC.next_day_stub(past, keys, ts, carry, targets)
    both = past.unionByName(stub, allowMissingColumns=True)
    return build(both).join(stub.select(*keys, ts), [*keys, ts], "left_semi")


def scenario_rows(day: DataFrame, scenarios: Mapping[str, Mapping[str, object]], out: str = "scenario") -> DataFrame:
    """``day`` once for each scenario, with the scenario's values in the columns that it names (and that exist)."""
    rows = day.withColumn(out, F.explode(F.array(*[F.lit(s) for s in scenarios])))
    kinds = dict(day.dtypes)
    changed: dict[str, Column] = {}
    for s, values in scenarios.items():
        for c, v in values.items():
            if c in kinds:
                now = F.lit(v).cast(kinds[c])
                changed[c] = changed[c].when(F.col(out) == s, now) if c in changed else F.when(F.col(out) == s, now)
    return rows.withColumns({c: x.otherwise(F.col(c)) for c, x in changed.items()})
