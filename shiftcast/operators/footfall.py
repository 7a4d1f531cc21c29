"""Sensor (footfall) panel features (survey 2.E).

Rounding is half-to-even (``bround``), the rule of the reference's numeric
library.

Input is one row per timestamp and key with one column per counter.
Row-based lags and the rolling mean follow the reference (row order, not
clock); the busy flag compares against the 70th percentile of the same
hour-of-week, computed as a grouped aggregate and joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftcast.functions.timecols import weekday
from shiftcast.operators import series as SR
from shiftcast.operators.asof import asof_quantiles
from shiftcast.operators.diagnostics import quantiles


def rowwise_mean_sum(df: DataFrame, cols: Sequence[str], mean_out: str = "nearby_footfall_avg",
                     sum_out: str = "nearby_footfall_sum", digits: int = 1) -> DataFrame:
    """Mean over the non-null counters (rounded) and their integer sum (all null → 0)."""
    arr = F.filter(F.array(*[F.col(c).cast("double") for c in cols]), lambda x: x.isNotNull())
    total = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)
    n = F.size(arr)
    return df.withColumns({
        mean_out: F.when(n > 0, F.bround(total / n, digits)),
        sum_out: total.cast("long"),
    })


def ratio_impute(df: DataFrame, primary: str, nearby: str, keys: Sequence[str] = (),
                 out: str = "suffolk_nassau_footfall", live_out: str = "suffolk_counter_is_live",
                 min_live: int = 100) -> DataFrame:
    """Fill gaps of the primary counter from the nearby average.

    With more than ``min_live`` live rows: gap := round(nearby × median(primary /
    nearby)), the median over live rows with nearby > 0; otherwise the primary
    series is replaced by nearby.  Remaining NULLs → 0.
    """
    keys = list(keys)
    live = F.col(primary).isNotNull()
    ratio = F.when(live & (F.col(nearby) > 0), F.col(primary).cast("double") / F.col(nearby))
    by = keys or ["_all"]
    all_rows = df if keys else df.withColumn("_all", F.lit(0))
    stats = all_rows.groupBy(*by).agg(F.count_if(live).alias("_n_live")).join(
        quantiles(all_rows.select(*by, ratio.alias("_r")), "_r", (0.5,), by, names=["_scale"],
                  bound_groups=None if keys else 1), by, "left")
    j = all_rows.join(stats if keys else F.broadcast(stats), by, "left")  # unkeyed: one row
    j = j if keys else j.drop("_all")
    filled = F.when(F.col("_n_live") > min_live,
                    F.coalesce(F.col(primary).cast("double"), F.bround(F.col(nearby) * F.col("_scale"), 0))
                    ).otherwise(F.col(nearby))
    return j.withColumns({live_out: live.cast("int"),
                          out: F.coalesce(filled, F.lit(0.0)).cast("long")}).drop("_n_live", "_scale")


def row_lags_filled(df: DataFrame, c: str, lags: Sequence[int] = (1, 24, 168), keys: Sequence[str] = (),
                    ts: str = "timestamp_hour", prefix: str = "suffolk_footfall_lag_") -> DataFrame:
    """Row-based lags with NULL → 0, rounded to whole numbers."""
    v = F.coalesce(F.col(c), F.lit(0.0))

    def columns(w):
        return {f"{prefix}{n}h": F.bround(F.coalesce(F.lag(v, n).over(w), F.lit(0.0)), 0).cast("long") for n in lags}

    if not keys:
        return SR.windowed(df, columns, ts, max(lags))
    return df.withColumns(columns(Window.partitionBy(*keys).orderBy(ts)))


def rolling_mean_min(df: DataFrame, c: str, out: str = "suffolk_footfall_roll_24h", rows: int = 24,
                     min_periods: int = 4, keys: Sequence[str] = (), ts: str = "timestamp_hour",
                     digits: int = 1, value_digits: int | None = 1) -> DataFrame:
    """Mean of the previous ``rows`` rows (the window ends one row back), NULL below ``min_periods``.

    With ``value_digits`` (the input's decimals) the window sum is exact
    integer arithmetic, so a mean that lands on a rounding tie rounds the same
    way whatever order the rows are added in.
    """
    v = F.coalesce(F.col(c), F.lit(0.0))

    def columns(order):
        w = order.rowsBetween(-rows, -1)
        if value_digits is None:
            mean = F.avg(v).over(w)
        else:
            scale = 10 ** value_digits
            mean = F.sum(F.round(v * scale).cast("long")).over(w) / (F.count(v).over(w) * scale)
        return {out: F.when(F.count(v).over(w) >= min_periods, F.bround(mean, digits))}

    if not keys:
        return SR.windowed(df, columns, ts, rows)
    return df.withColumns(columns(Window.partitionBy(*keys).orderBy(ts)))


def busy_flag(df: DataFrame, c: str, out: str = "suffolk_is_busy_flag", q: float = 0.70,
              keys: Sequence[str] = (), ts: str = "timestamp_hour", asof: bool = False) -> DataFrame:
    """1 when the value exceeds the ``q`` percentile of its hour-of-week (weekday × 24 + hour).

    ``asof=True`` is the leakage-safe variant: the percentile of strictly
    earlier rows of the same hour-of-week, 0 when there is no earlier row.
    """
    keys = list(keys)
    how = (weekday(ts) * 24 + F.hour(ts)).alias("_how")
    staged = df.withColumn("_how", how)
    if asof:
        found = asof_quantiles(staged, [*keys, "_how"], ts, c, (q,), "_p")
        return found.withColumn(out, F.coalesce((F.col(c) > F.col("_p")[0]).cast("int"), F.lit(0))).drop("_how", "_p")
    p = staged.groupBy(*keys, "_how").agg(F.percentile(F.col(c).cast("double"), F.lit(q)).alias("_p"))
    # ≤ 168 rows per key: hour-of-week groups are bounded by construction
    j = staged.join(F.broadcast(p) if not keys else p, [*keys, "_how"], "left")
    return j.withColumn(out, F.coalesce((F.col(c) > F.col("_p")).cast("int"), F.lit(0))).drop("_how", "_p")


def footfall_features(df: DataFrame, primary: str, nearby_cols: Sequence[str], keys: Sequence[str] = (),
                      ts: str = "timestamp_hour") -> DataFrame:
    """The full sensor block: nearby mean/sum, imputed primary, z-score, lags,
    rolling mean and busy flag, on the nearby average."""
    from shiftcast.operators.enrich import zscore

    keys = list(keys)
    out = rowwise_mean_sum(df, nearby_cols)
    out = ratio_impute(out, primary, "nearby_footfall_avg", keys)
    out = out.withColumn("_s", F.coalesce(F.col("nearby_footfall_avg"), F.lit(0.0)))
    out = zscore(out, "_s", "city_footfall_zscore", keys, digits=3)
    out = row_lags_filled(out, "_s", (1, 24, 168), keys, ts)
    out = rolling_mean_min(out, "_s", keys=keys, ts=ts)
    out = busy_flag(out, "nearby_footfall_avg", keys=keys, ts=ts)
    return out.select(*keys, ts, "suffolk_nassau_footfall", "suffolk_counter_is_live", "nearby_footfall_avg",
                      "nearby_footfall_sum", "city_footfall_zscore", "suffolk_footfall_lag_1h",
                      "suffolk_footfall_lag_24h", "suffolk_footfall_lag_168h", "suffolk_footfall_roll_24h",
                      "suffolk_is_busy_flag")
