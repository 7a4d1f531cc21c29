"""Shift segments, busy labels and daily KPIs (survey 2.G).

Thresholds are per-(key, shift) percentiles of *daily shift totals*, so every
percentile buffer holds one value per day — bounded by the calendar, not by the
raw data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftcast.functions.timecols import col, hour_index, weekday
from shiftcast.operators.asof import asof_quantiles

# Segment definitions (name → inclusive hour ranges), in the
# order they are tested (first match wins), and the value for other hours.
SEGMENT_VARIANTS: dict[str, tuple[list[tuple[str, list[tuple[int, int]]]], str | None]] = {
    # busy-label shifts
    "label": ([("lunch", [(12, 14)]), ("dinner", [(17, 20)]), ("late_bar", [(21, 23), (0, 1)])], "none"),
    # per-segment model routing
    "model": ([("lunch", [(12, 15)]), ("evening", [(17, 20)]), ("late_bar", [(21, 23), (0, 2)]),
               ("off_peak", [(9, 11), (16, 16)])], None),
    # single-hour lookup: same as model, everything else off-peak
    "hour_shift": ([("lunch", [(12, 15)]), ("evening", [(17, 20)]), ("late_bar", [(21, 23), (0, 2)])],
                   "off_peak"),
    # exploratory analysis (evening includes 21 because it is tested first)
    "eda": ([("Lunch", [(12, 15)]), ("Evening", [(17, 21)]), ("Late Bar", [(21, 23), (0, 2)])], "Off-Peak"),
    # dashboard KPI shifts
    "kpi": ([("Lunch", [(12, 14)]), ("Evening", [(17, 20)]), ("Late bar", [(21, 23), (0, 1)])], None),
    # the same shifts as seen by the KPI history (the late shift stops at 23 h)
    "kpi_history": ([("Lunch", [(12, 14)]), ("Evening", [(17, 20)]), ("Late bar", [(21, 23)])], None),
}
# Percentiles of training shift totals that split the labels.
LABEL_PERCENTILES = (0.25, 0.65, 0.88)
DEFAULT_THRESHOLDS = (10.0, 30.0, 50.0)
KPI_DEFAULT_THRESHOLDS = (20.0, 40.0, 70.0)
LABELS = ("quiet", "normal", "busy", "slammed")
# Prep advice per label (title, description).
SHIFT_PREP = {
    "quiet": ("Normal prep", "No extra staffing needed."),
    "normal": ("Standard prep", "Follow usual levels."),
    "busy": ("Increase prep", "Higher than usual — check stock."),
    "slammed": ("Maximum prep", "All hands on deck."),
}


def segment(hour, variant: str = "label") -> Column:
    segs, other = SEGMENT_VARIANTS[variant]
    h = col(hour)
    expr = None
    for name, ranges in segs:
        cond = None
        for lo, hi in ranges:
            c = h.between(lo, hi)
            cond = c if cond is None else (cond | c)
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return expr.otherwise(F.lit(other)) if other is not None else expr


def business_date(ts, day_offset_hours: int = 0) -> Column:
    """Calendar date of ``ts``; with an offset, early hours count to the previous day."""
    t = col(ts)
    if day_offset_hours:
        t = t - F.make_dt_interval(F.lit(0), F.lit(day_offset_hours))
    return F.to_date(t)


def shift_totals(df: DataFrame, value: str, keys: Sequence[str] = (), ts: str = "timestamp_hour",
                 variant: str = "label", day_offset_hours: int = 0, out: str | None = None) -> DataFrame:
    """Sum of ``value`` per (keys, date, shift); hours outside every shift are dropped."""
    keys = list(keys)
    s = segment(F.hour(ts), variant)
    staged = df.select(*keys, business_date(ts, day_offset_hours).alias("date"), s.alias("shift"),
                       F.col(value).alias("_v"))
    _, other = SEGMENT_VARIANTS[variant]
    drop = other if variant == "label" else None
    staged = staged.filter(F.col("shift").isNotNull() & ((F.col("shift") != drop) if drop else F.lit(True)))
    return staged.groupBy(*keys, "date", "shift").agg(F.sum("_v").alias(out or value))


def shift_thresholds(totals: DataFrame, value: str, keys: Sequence[str] = (),
                     percentiles: Sequence[float] = LABEL_PERCENTILES, approx: bool = False) -> DataFrame:
    """Linear-interpolation percentiles of shift totals per (keys, shift).

    ``approx=True`` swaps the exact buffer for ``percentile_approx`` when a
    group is not calendar-bounded.
    """
    v = F.col(value).cast("double")
    p = (F.percentile_approx(v, list(percentiles), 10000) if approx
         else F.percentile(v, F.array(*[F.lit(x) for x in percentiles])))
    agg = totals.groupBy(*keys, "shift").agg(p.alias("_q"))
    return agg.select(*keys, "shift", *[F.col("_q")[i].alias(n) for i, n in
                                        enumerate(("q_quiet", "q_normal", "q_busy"))])


def label_from_thresholds(v, q_quiet, q_normal, q_busy) -> Column:
    v = col(v)
    return (F.when(v <= col(q_quiet), "quiet").when(v <= col(q_normal), "normal")
            .when(v <= col(q_busy), "busy").otherwise("slammed"))


def with_default_thresholds(df: DataFrame, defaults=DEFAULT_THRESHOLDS) -> DataFrame:
    return df.withColumns({n: F.coalesce(F.col(n), F.lit(float(d)))
                           for n, d in zip(("q_quiet", "q_normal", "q_busy"), defaults)})


def shift_labels(totals: DataFrame, thresholds: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Label each (date, shift) total; a shift unseen in training gets the defaults."""
    j = with_default_thresholds(totals.join(thresholds, [*keys, "shift"], "left"))
    return j.withColumn("label", label_from_thresholds(value, "q_quiet", "q_normal", "q_busy"))


def shift_label_accuracy(actual: DataFrame, predicted: DataFrame, thresholds: DataFrame,
                         value: str, pred: str, keys: Sequence[str] = (),
                         group: Sequence[str] = ()) -> DataFrame:
    """Share of (date, shift) whose predicted label equals the actual label.

    ``actual``/``predicted`` are shift totals; they meet on an inner join.
    """
    keys = list(keys)
    j = actual.join(predicted.select(*keys, *group, "date", "shift", pred), [*keys, *group, "date", "shift"])
    j = with_default_thresholds(j.join(thresholds, [*keys, *group, "shift"], "left"))
    same = (label_from_thresholds(value, "q_quiet", "q_normal", "q_busy")
            == label_from_thresholds(pred, "q_quiet", "q_normal", "q_busy"))
    return j.groupBy(*keys, *group).agg(F.avg(same.cast("double")).alias("shift_accuracy"),
                                        F.count(F.lit(1)).alias("n_shifts"))


def shift_kpis(forecast: DataFrame, history: DataFrame, orders: str, tickets: str,
               actual: str = "orders_count", keys: Sequence[str] = (), ts: str = "timestamp_hour",
               min_days: int = 3) -> DataFrame:
    """Per (keys, date, shift): Σ orders, Σ tickets, first peak hour and a label
    against percentiles of *strictly earlier* days' actual totals.

    The as-of percentiles come block by block (:mod:`shiftcast.operators.asof`), so
    a day costs the same whatever the length of its history.  History uses
    shift hours up to 23 h.
    """
    keys = list(keys)
    kpi = F.col("shift")
    f = forecast.select(*keys, F.to_date(ts).alias("date"), F.hour(ts).alias("hour"),
                        segment(F.hour(ts), "kpi").alias("shift"), orders, tickets,
                        F.col(ts).alias("_ts")).filter(kpi.isNotNull())
    fc = f.groupBy(*keys, "date", "shift").agg(
        F.floor(F.sum(orders)).cast("long").alias("orders"),
        F.floor(F.sum(tickets)).cast("long").alias("tickets"),
        F.max_by("hour", F.struct(F.col(orders), -hour_index("_ts")))
        .alias("peak_hour"),
        F.sum(orders).alias("_orders_raw"))
    h = history.select(*keys, F.to_date(ts).alias("date"), F.hour(ts).alias("hour"), actual)
    h = h.withColumn("shift", segment("hour", "kpi_history")).filter(kpi.isNotNull())
    hd = h.groupBy(*keys, "date", "shift").agg(F.sum(actual).cast("double").alias("_hist_total"))
    days = fc.join(hd, [*keys, "date", "shift"], "full")
    days = asof_quantiles(days, [*keys, "shift"], "date", "_hist_total", LABEL_PERCENTILES, "_q", "_n")
    enough = F.col("_n") > min_days
    thr = {n: F.when(enough, F.col("_q")[i]).otherwise(F.lit(d))
           for i, (n, d) in enumerate(zip(("q_quiet", "q_normal", "q_busy"), KPI_DEFAULT_THRESHOLDS))}
    out = days.filter(F.col("orders").isNotNull()).withColumns(thr)
    prep = F.create_map(*[x for k, (t, _) in SHIFT_PREP.items() for x in (F.lit(k), F.lit(t))])
    return out.select(*keys, "date", "shift", "orders", "tickets", "peak_hour",
                      label_from_thresholds("_orders_raw", "q_quiet", "q_normal", "q_busy").alias("label"),
                      ).withColumn("prep", prep[F.col("label")])


def day_pressure(kpis: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Any slammed shift → slammed; ≥ 2 busy → busy; 1 busy → moderate; else normal."""
    agg = kpis.groupBy(*keys, "date").agg(F.count_if(F.col("label") == "slammed").alias("n_slammed"),
                                          F.count_if(F.col("label") == "busy").alias("n_busy"))
    return agg.select(*keys, "date", F.when(F.col("n_slammed") > 0, "slammed")
                      .when(F.col("n_busy") >= 2, "busy").when(F.col("n_busy") == 1, "moderate")
                      .otherwise("normal").alias("pressure"), "n_slammed", "n_busy")


def ratio_label(df: DataFrame, value: str = "orders_count", ts: str = "timestamp_hour",
                base: dict[int, float] | None = None, weekday_mult: dict[int, float] | None = None) -> DataFrame:
    """value / max(base[hour] × weekday multiplier, 1) cut at 0.5 / 0.9 / 1.4."""
    from shiftcast.operators.rules import BASE_ORDERS, WEEKDAY_MULT, lookup

    base = base or BASE_ORDERS
    weekday_mult = weekday_mult or WEEKDAY_MULT
    b = F.coalesce(lookup(base, F.hour(ts)), F.lit(10.0)) * lookup(weekday_mult, weekday(ts))
    p = F.col(value) / F.greatest(b, F.lit(1.0))
    return df.withColumn("busy_label", F.when(p < 0.5, "quiet").when(p < 0.9, "normal")
                         .when(p < 1.4, "busy").otherwise("slammed"))


def slot_percentile_label(df: DataFrame, value: str = "orders_count", keys: Sequence[str] = (),
                          ts: str = "timestamp_hour") -> DataFrame:
    """Contract variant: label by the value's percentile within its (hour, weekday) slot."""
    slot = [*keys, F.hour(ts).alias("_h"), weekday(ts).alias("_wd")]
    s = df.select("*", *slot[len(keys):])
    q = (s.groupBy(*keys, "_h", "_wd")
         .agg(F.percentile(F.col(value).cast("double"),
                           F.array(*[F.lit(x) for x in LABEL_PERCENTILES])).alias("_q")))
    j = s.join(q, [*keys, "_h", "_wd"])
    return j.withColumn("busy_label", label_from_thresholds(value, F.col("_q")[0], F.col("_q")[1],
                                                            F.col("_q")[2])).drop("_h", "_wd", "_q")
