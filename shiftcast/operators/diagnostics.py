"""Diagnostics (survey 2.I): correlations, box statistics, ACF/PACF,
cross-correlation, describe and profiles.

Quantiles default to an exact method that scales: a per-(group, value)
frequency table (map-side combined, bounded by the number of distinct values)
followed by a running count, so no group is ever buffered whole in a task.
``method="approx"`` switches to ``percentile_approx`` for continuous values
with very many distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftcast.functions.timecols import weekday
from shiftcast.operators import segments as S
from shiftcast.session import join_dimension

# Weekday names, Monday first.
DAY_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def safe_corr(x, y) -> Column:
    """Pearson correlation over rows where both are present; NULL (not an
    error, not NaN) when either side has zero variance or < 2 pairs."""
    x, y = (F.col(x) if isinstance(x, str) else x).cast("double"), (F.col(y) if isinstance(y, str) else y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    xx, yy = F.when(both, x), F.when(both, y)
    sx, sy = F.stddev_samp(xx), F.stddev_samp(yy)
    return F.when((sx > 0) & (sy > 0), F.try_divide(F.covar_samp(xx, yy), sx * sy))


def corr_matrix(df: DataFrame, cols: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of every column pair (pairwise-complete rows), one aggregate; both orders of a pair share it."""
    at = range(len(cols))
    wide = df.groupBy(*group).agg(*[safe_corr(cols[i], cols[j]).alias(f"_c{i}_{j}") for i in at for j in at if i <= j])
    rows = F.array(*[F.struct(F.lit(cols[i]).alias("col_a"), F.lit(cols[j]).alias("col_b"),
                              F.col(f"_c{min(i, j)}_{max(i, j)}").alias("corr")) for i in at for j in at])
    return wide.select(*group, F.inline(rows))


def target_corr(df: DataFrame, cols: Sequence[str], target: str, group: Sequence[str] = ()) -> DataFrame:
    """Correlation of each column with ``target`` (one aggregate, one row per column)."""
    aggs = [safe_corr(c, target).alias(f"_c{i}") for i, c in enumerate(cols)]
    wide = df.groupBy(*group).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_c{i}").alias(target)) for i, c in enumerate(cols)])
    return wide.select(*group, F.inline(rows))


#: Accuracy of the sketch that brackets an exact quantile: of a group's rows about 4 / ACCURACY are sorted.
ACCURACY = 10_000


def _join_group(df: DataFrame, small: DataFrame, group: Sequence[str], bound_groups: int | None = None) -> DataFrame:
    """Rows with their group's row of ``small`` (a null group value meets a null).

    Few groups (``bound_groups``) are broadcast: dealt out by group, a group's rows would all be sorted by one task."""
    if not group:  # one row of statistics
        return df.withColumn("_all", F.lit(0)).join(F.broadcast(small.withColumn("_all", F.lit(0))), "_all").drop("_all")
    right = small.select(*[F.col(c).alias(f"_g{i}") if c in group else F.col(c) for i, c in enumerate(small.columns)])
    at = {c: f"_g{i}" for i, c in enumerate(small.columns) if c in group}
    on = [df[c].eqNullSafe(right[at[c]]) for c in group]
    return join_dimension(df, right, on, "inner", bound_groups).drop(*at.values())


def bracketed_quantiles(df: DataFrame, value: str, qs: Sequence[float], group: Sequence[str],
                        names: Sequence[str], bound_groups: int | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles without sorting a group in one task.

    A mergeable sketch (``percentile_approx``) gives for every quantile two
    values that surely enclose its rank.  Rows below the lower one are only
    counted (map-side); the few between are counted per value and sorted.  A
    group of up to 3 × ``ACCURACY`` rows is sorted whole, as rounding of ranks
    may matter there.  ``bound_groups`` is the caller's proven bound on the number
    of groups; within it their statistics are broadcast.
    """
    group = list(group)
    rows = df.select(*group, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    eps = 2.0 / ACCURACY
    probes = [min(max(q + d, 0.0), 1.0) for q in qs for d in (-eps, eps)]
    stats = rows.groupBy(*group).agg(F.percentile_approx("_v", probes, ACCURACY).alias("_b"), F.count(F.lit(1)).alias("_n"),
                                      F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    few = F.col("_n") <= 3 * ACCURACY
    if not group:
        stats = stats.filter(F.col("_n") > 0)
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.when(few, F.col("_min")).otherwise(F.col("_b")[2 * i]).alias("lo"),
                                         F.when(few, F.col("_max")).otherwise(F.col("_b")[2 * i + 1]).alias("hi"))
                                for i in range(len(qs))]))
    near = (_join_group(rows, stats, group, bound_groups).select(*group, "_v", "_n", sides.alias("_s")).filter(F.col("_v") <= F.col("_s.hi"))
            .groupBy(*group, F.col("_s.i").alias("_i"), F.when(F.col("_v") >= F.col("_s.lo"), F.col("_v")).alias("_x"))
            .agg(F.count(F.lit(1)).alias("_k"), F.first("_n").alias("_n")))
    w = Window.partitionBy(*group, "_i").orderBy(F.col("_x").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = near.withColumn("_cum", F.sum("_k").over(w))
    aggs = []
    for i, (q, name) in enumerate(zip(qs, names)):
        h = (F.col("_n") - 1) * q
        own = F.col("_i") == i
        aggs += [F.min(F.when(own & (F.col("_cum") > F.floor(h)), F.col("_x"))).alias(f"{name}_lo"),
                 F.min(F.when(own & (F.col("_cum") > F.ceil(h)), F.col("_x"))).alias(f"{name}_hi"),
                 F.max(h - F.floor(h)).alias(f"{name}_f")]
    a = ranked.groupBy(*group).agg(*aggs)
    return a.select(*group, *[(F.col(f"{n}_lo") + F.col(f"{n}_f") * (F.col(f"{n}_hi") - F.col(f"{n}_lo"))).alias(n)
                              for n in names])


def quantiles(df: DataFrame, value: str, qs: Sequence[float], group: Sequence[str] = (),
              method: str = "bracket", names: Sequence[str] | None = None, bound_groups: int | None = None) -> DataFrame:
    """Linear-interpolation quantiles per group (the numpy / pandas default).

    ``bracket`` (default) is exact at any size, ``exact`` buffers a group's
    distinct values, ``approx`` is the sketch alone.  ``bound_groups``: proven
    bound on the number of groups, see :func:`bracketed_quantiles`.
    """
    group = list(group)
    names = list(names or [f"q{int(round(q * 100))}" for q in qs])
    v = F.col(value).cast("double")
    if method == "approx":
        return df.groupBy(*group).agg(F.percentile_approx(v, list(qs), 100000).alias("_q")).select(
            *group, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    if method == "exact":
        return df.groupBy(*group).agg(F.percentile(v, F.array(*[F.lit(q) for q in qs])).alias("_q")).select(
            *group, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    return bracketed_quantiles(df, value, qs, group, names, bound_groups)


def box_stats(df: DataFrame, value: str, group: Sequence[str], method: str = "bracket",
              bound_groups: int | None = None) -> DataFrame:
    """Quartiles, 1.5·IQR whiskers (furthest points inside the fences) and outlier count.

    ``bound_groups``: proven bound on the number of groups, see :func:`bracketed_quantiles`."""
    group = list(group)
    rows = df.select(*group, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    q = quantiles(rows, "_v", (0.25, 0.5, 0.75), group, method, names=["q1", "median", "q3"], bound_groups=bound_groups)
    j = _join_group(rows, q, group, bound_groups)
    x = F.col("_v")
    iqr = F.col("q3") - F.col("q1")
    lo_f, hi_f = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    return j.groupBy(*group, "q1", "median", "q3").agg(
        F.count(x).alias("n"),
        F.min(F.when(x >= lo_f, x)).alias("whisker_lo"),
        F.max(F.when(x <= hi_f, x)).alias("whisker_hi"),
        F.count_if((x < lo_f) | (x > hi_f)).alias("n_outliers"))


#: Classes of :func:`anomaly_class`.
ANOMALY_CLASSES = 3


def anomaly_class(df: DataFrame, out: str = "anomaly_type") -> DataFrame:
    """Normal Day / Aviva Event / St. Patrick's Week; the later rule wins."""
    cls = F.lit("Normal Day")
    if "aviva_event_flag" in df.columns:
        cls = F.when(F.col("aviva_event_flag") == 1, "Aviva Event").otherwise(cls)
    if "st_patricks_week_flag" in df.columns:
        cls = F.when(F.col("st_patricks_week_flag") == 1, "St. Patrick's Week").otherwise(cls)
    return df.withColumn(out, cls)


def residual_profile(oos: DataFrame, panel: DataFrame, keys: Sequence[str] = (), ts: str = "timestamp_hour",
                     method: str = "bracket") -> DataFrame:
    """Box statistics of residuals by weekday name × EDA shift (inner join with the panel)."""
    keys = list(keys)
    names = F.element_at(F.array(*[F.lit(d) for d in DAY_NAMES]), weekday(ts) + 1)
    p = panel.select(*keys, ts, names.alias("day_of_week"), S.segment(F.hour(ts), "eda").alias("shift"))
    j = oos.select(*keys, ts, "residual").join(p, [*keys, ts], "inner")
    # without keys: a group for each weekday (or null) and shift
    bound = None if keys else (len(DAY_NAMES) + 1) * 24
    return box_stats(j, "residual", [*keys, "day_of_week", "shift"], method, bound)


def acf(df: DataFrame, value: str, keys: Sequence[str] = (), ts: str = "timestamp_hour", nlags: int = 168) -> DataFrame:
    """Sample autocorrelation on the row sequence of each key (biased estimator).

    One sorted pass builds, per row, the array of lagged centred values; a
    ``posexplode`` feeds a (keys, lag) sum whose partial aggregation runs in
    the same stage, so the rows × lags product is never materialised or
    shuffled — only (keys × lags) partial sums are.  No self-join.
    """
    keys = list(keys)
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    w = (Window.partitionBy(*keys) if keys else Window).orderBy(ts)
    c = df.filter(F.col(value).isNotNull()).select(
        *keys, ts, (F.col(value).cast("double") - F.avg(F.col(value).cast("double")).over(part)).alias("_c"))
    lagged = c.select(*keys, "_c", F.array(*[F.lag("_c", k).over(w) for k in range(nlags + 1)]).alias("_l"))
    num = (lagged.select(*keys, "_c", F.posexplode("_l").alias("lag", "_x"))
           .groupBy(*keys, "lag").agg(F.coalesce(F.sum(F.col("_x") * F.col("_c")), F.lit(0.0)).alias("_n")))
    den = F.max(F.when(F.col("lag") == 0, F.col("_n"))).over(Window.partitionBy(*keys) if keys
                                                               else Window.partitionBy(F.lit(0)))
    out = num.withColumn("_d", den).filter(F.col("_d") > 0)
    return out.select(*keys, F.col("lag").cast("int").alias("lag"), (F.col("_n") / F.col("_d")).alias("acf"))


def _durbin_levinson(r: np.ndarray, nlags: int) -> np.ndarray:
    """Partial autocorrelations from autocorrelations r[0..nlags] (Yule–Walker)."""
    pacf = np.zeros(nlags + 1)
    pacf[0] = 1.0
    phi = np.zeros(nlags + 1)
    sigma = r[0]
    for k in range(1, nlags + 1):
        num = r[k] - np.dot(phi[1:k], r[1:k][::-1])
        a = num / sigma if sigma != 0 else np.nan
        new = phi.copy()
        new[k] = a
        new[1:k] = phi[1:k] - a * phi[1:k][::-1]
        phi = new
        sigma = sigma * (1 - a * a)
        pacf[k] = a
    return pacf


def pacf(df: DataFrame, value: str, keys: Sequence[str] = (), ts: str = "timestamp_hour", nlags: int = 48) -> DataFrame:
    """PACF by Durbin–Levinson on the biased ACF.  The ACF is computed in Spark;
    only the ``nlags + 1`` autocorrelations of one key reach a pandas task."""
    keys = list(keys)
    a = acf(df, value, keys, ts, nlags)
    if not keys:
        a = a.withColumn("_series", F.lit(0))
    gk = keys or ["_series"]
    schema = ", ".join([f"`{k}` {t}" for k, t in a.select(*gk).dtypes] + ["lag int", "pacf double"])

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lag")
        r = pdf["acf"].to_numpy(dtype=float)
        out = pdf[gk].iloc[:1].merge(pd.DataFrame({"lag": np.arange(len(r)), "pacf": _durbin_levinson(r, len(r) - 1)}),
                                     how="cross")
        return out[[*gk, "lag", "pacf"]]

    res = a.groupBy(*gk).applyInPandas(fn, schema)
    return res.drop("_series") if not keys else res


def cross_corr(df: DataFrame, a: str, b: str, keys: Sequence[str] = (), ts: str = "timestamp_hour",
               max_lag: int = 24) -> DataFrame:
    """corr(a_t, b_{t-l}) for l in −max_lag … max_lag on the row sequence (pairwise complete).

    Shifted values of ``b`` are built as one array per row and exploded into
    a (keys, lag) correlation aggregate (partial aggregation, no self-join)."""
    keys = list(keys)
    w = (Window.partitionBy(*keys) if keys else Window).orderBy(ts)
    lags = list(range(-max_lag, max_lag + 1))

    def shifted(l: int) -> Column:
        return F.lag(b, l).over(w) if l > 0 else (F.lead(b, -l).over(w) if l < 0 else F.col(b))

    s = df.select(*keys, F.col(a).cast("double").alias("_a"),
                  F.array(*[shifted(l).cast("double") for l in lags]).alias("_bs"))
    ex = s.select(*keys, "_a", F.posexplode("_bs").alias("_i", "_b"))
    agg = ex.groupBy(*keys, "_i").agg(safe_corr("_a", "_b").alias("xcorr"))
    return agg.select(*keys, (F.col("_i") - max_lag).cast("int").alias("lag"), "xcorr")


def describe(df: DataFrame, cols: Sequence[str], method: str = "bracket") -> DataFrame:
    """count, mean, std, min, 25 %, 50 %, 75 %, max per column (long format)."""
    out = None
    for c in cols:
        base = df.agg(F.count(c).alias("count"), F.avg(F.col(c).cast("double")).alias("mean"),
                      F.stddev_samp(F.col(c).cast("double")).alias("std"),
                      F.min(F.col(c).cast("double")).alias("min"), F.max(F.col(c).cast("double")).alias("max"))
        q = quantiles(df, c, (0.25, 0.5, 0.75), (), method, names=("p25", "p50", "p75"))
        one = base.withColumn("_k", F.lit(0)).join(F.broadcast(q.withColumn("_k", F.lit(0))), "_k").drop("_k")
        one = one.select(F.lit(c).alias("column"), "count", "mean", "std", "min", "p25", "p50", "p75", "max")
        out = one if out is None else out.unionByName(one)
    return out


def hour_profile(df: DataFrame, value: str, keys: Sequence[str] = (), ts: str = "timestamp_hour") -> DataFrame:
    return df.groupBy(*keys, F.hour(ts).alias("hour")).agg(
        F.avg(F.col(value).cast("double")).alias("mean"), F.stddev_samp(F.col(value).cast("double")).alias("std"))


def weekday_profile(df: DataFrame, value: str, keys: Sequence[str] = (), ts: str = "timestamp_hour") -> DataFrame:
    return df.groupBy(*keys, weekday(ts).alias("weekday")).agg(F.avg(F.col(value).cast("double")).alias("mean"))


def shift_scatter(df: DataFrame, x: str, y: str, keys: Sequence[str] = (), ts: str = "timestamp_hour") -> DataFrame:
    """Points (x, y, shift) with off-peak hours removed (EDA shift variant)."""
    s = S.segment(F.hour(ts), "eda")
    return df.select(*keys, ts, F.col(x).alias(x), F.col(y).alias(y), s.alias("shift")) \
        .filter(F.col("shift") != "Off-Peak")
