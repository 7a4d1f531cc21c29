"""Leakage-safe lag, rolling and same-slot features (survey 2.F).

All windows of one value share one window spec — ``PARTITION BY keys ORDER BY
ts`` — so Catalyst plans a single Exchange + Sort + Window for every lag,
rolling frame and clock-aligned (RANGE) lookup of that value.  The input must
have unique (keys, ts); a panel from ``hourly_rollup`` does.

Per-key group size is bounded by the calendar (≤ 24 rows per day and key),
never by raw row volume: raw rows are aggregated before any window runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rolling windows of the reference (name → (rows, aggregate)).
ROLLING = {
    "roll_mean_3": (3, "mean"),
    "roll_mean_6": (6, "mean"),
    "roll_mean_12": (12, "mean"),
    "roll_mean_24": (24, "mean"),
    "roll_std_24": (24, "std"),
    "roll_max_24": (24, "max"),
    "roll_mean_168": (168, "mean"),
}
CLOCK_LAGS = {24: "lag_24h", 48: "lag_48h", 168: "lag_168h", 336: "lag_336h"}


def _q(c: str) -> str:
    return f"`{c}`"


def _over(keys: Sequence[str], ts: str) -> str:
    part = f"PARTITION BY {', '.join(_q(k) for k in keys)} " if keys else ""
    return f"{part}ORDER BY {_q(ts)}"


def ordered_window(keys: Sequence[str], ts: str) -> Window:
    w = Window.partitionBy(*keys) if keys else Window
    return w.orderBy(ts)


def clock_lag_expr(value: str, hours: int, keys: Sequence[str] = (), ts: str = "timestamp_hour") -> Column:
    """Value at exactly ``ts - hours`` of the same key, NULL when that hour is absent.

    A RANGE frame of width zero, ``hours`` back: gap-correct like a calendar
    lookup, but evaluated in the same sorted pass as the row lags.
    """
    return F.expr(
        f"max({_q(value)}) OVER ({_over(keys, ts)} RANGE BETWEEN INTERVAL {hours} HOURS PRECEDING "
        f"AND INTERVAL {hours} HOURS PRECEDING)")


def row_lags(df: DataFrame, value: str, lags: Sequence[int] = (1, 2, 3), keys: Sequence[str] = (),
             ts: str = "timestamp_hour") -> DataFrame:
    w = ordered_window(keys, ts)
    return df.withColumns({f"{value}_lag_{n}": F.lag(value, n).over(w) for n in lags})


def clock_lags(df: DataFrame, value: str, hours: Sequence[int] = (24, 48, 168, 336),
               keys: Sequence[str] = (), ts: str = "timestamp_hour") -> DataFrame:
    return df.withColumns({f"{value}_{CLOCK_LAGS.get(h, f'lag_{h}h')}": clock_lag_expr(value, h, keys, ts)
                           for h in hours})


def same_slot_mean(df: DataFrame, value: str, weeks: int = 4, keys: Sequence[str] = (),
                   ts: str = "timestamp_hour", name: str | None = None) -> DataFrame:
    """Mean of the same hour 1…``weeks`` weeks back over the weeks that exist.

    Always recomputed (the reference skips it when the column exists, which
    leaves stale values on appended rows).
    """
    # Each weekly lookup is materialised once (reusing clock-lag columns that
    # already exist), so the Window node evaluates every RANGE frame once.
    tmp, lag_cols = {}, []
    for k in range(1, weeks + 1):
        existing = f"{value}_{CLOCK_LAGS.get(168 * k, '')}"
        if 168 * k in CLOCK_LAGS and existing in df.columns:
            lag_cols.append(existing)
        else:
            tmp[f"_ss_{k}"] = clock_lag_expr(value, 168 * k, keys, ts)
            lag_cols.append(f"_ss_{k}")
    df = df.withColumns(tmp)
    lags = [F.col(c).cast("double") for c in lag_cols]
    n = sum((x.isNotNull().cast("int") for x in lags), F.lit(0))
    s = sum((F.coalesce(x, F.lit(0.0)) for x in lags), F.lit(0.0))
    return df.withColumn(name or f"{value}_same_slot_{weeks}w_avg", F.when(n > 0, s / n)).drop(*tmp)


INTEGRAL = {"tinyint", "smallint", "int", "bigint"}


def rolling_stats(df: DataFrame, value: str, spec: dict[str, tuple[int, str]] | None = None,
                  keys: Sequence[str] = (), ts: str = "timestamp_hour", method: str = "frames") -> DataFrame:
    """Trailing row windows that end one row before the current one.

    ``min_periods = max(1, w // 4)`` non-null values, else NULL.

    ``method="frames"`` (default) uses sliding ROWS frames: O(w) per row.
    ``"prefix"`` takes mean / sum / std from running sums (count, Σx, Σx² in
    exact decimal arithmetic for integer columns) differenced with row lags —
    O(1) per row whatever the width, for very wide windows; max / min always
    use frames.  On the bench panel both cost the same at w ≤ 168.
    """
    spec = spec or ROLLING
    base = ordered_window(keys, ts)
    integral = dict(df.dtypes).get(value) in INTEGRAL
    use_prefix = method == "prefix"
    x = F.col(value)
    cols = {}
    tmp = []
    if use_prefix and any(how in ("mean", "sum", "std") for _, how in spec.values()):
        run = base.rowsBetween(Window.unboundedPreceding, 0)
        xd = x.cast("decimal(38,0)") if integral else x.cast("double")
        df = df.withColumns({"_pn": F.count(x).over(run), "_ps": F.coalesce(F.sum(xd).over(run), F.lit(0)),
                             "_pq": F.coalesce(F.sum(xd * xd).over(run), F.lit(0))})
        tmp = ["_pn", "_ps", "_pq"]

        def trail(c: str, w: int) -> Column:
            return F.coalesce(F.lag(c, 1).over(base), F.lit(0)) - F.coalesce(F.lag(c, w + 1).over(base), F.lit(0))

    for name, (w, how) in spec.items():
        minp = max(1, w // 4)
        if use_prefix and how in ("mean", "sum", "std"):
            n, s1, s2 = trail("_pn", w), trail("_ps", w), trail("_pq", w)
            if how == "mean":
                v = s1.cast("double") / n
            elif how == "sum":
                v = s1.cast(dict(df.dtypes)[value]) if integral else s1
            else:
                var = (n * s2 - s1 * s1).cast("double") / (n * (n - 1)).cast("double")
                v = F.when(n > 1, F.sqrt(F.greatest(var, F.lit(0.0))))
            cols[f"{value}_{name}"] = F.when(n >= minp, v)
        else:
            win = base.rowsBetween(-w, -1)
            agg = {"mean": F.avg(x), "std": F.stddev_samp(x), "max": F.max(x), "min": F.min(x),
                   "sum": F.sum(x)}[how]
            cols[f"{value}_{name}"] = F.when(F.count(x).over(win) >= minp, agg.over(win))
    return df.withColumns(cols).drop(*tmp)


def trailing_sums(df: DataFrame, values: Sequence[str], spec: dict[str, tuple[int, str]] | None = None,
                  keys: Sequence[str] = (), ts: str = "timestamp_hour") -> DataFrame:
    """:func:`rolling_stats` (mean, std, max) of several integer columns at a cost per row that hardly grows with the widths.

    One pass keeps running sums up to the row before and the count, mean,
    variance and maximum of a short block of rows; a second one looks them up,
    as one struct for all columns, where each window and its blocks start.
    Sums run over the two 32-bit halves of a value, so they are exact and never
    overflow; block variances are combined around the window's mean.
    """
    spec = spec or ROLLING
    base = ordered_window(keys, ts)
    before = base.rowsBetween(Window.unboundedPreceding, -1)
    # std and max over w rows come from w / b adjoining blocks of b rows
    blocks = {w: min((b for b in range(w, 0, -1) if w % b == 0), key=lambda b: b + w // b)
              for w, how in spec.values() if how != "mean"}
    run = {}
    for i, v in enumerate(values):
        x = F.col(_q(v))
        long = x.cast("bigint")
        run |= {f"n{i}": F.count(x).over(before), f"hi{i}": F.sum(F.shiftright(long, 32)).over(before),
                f"lo{i}": F.sum(long.bitwiseAND(F.lit(0xFFFFFFFF))).over(before)}
        for b in sorted(set(blocks.values())):
            near = base.rowsBetween(-b, -1)
            run |= {f"bn{i}_{b}": F.count(x).over(near), f"avg{i}_{b}": F.avg(x).over(near),
                    f"var{i}_{b}": F.var_pop(x).over(near), f"max{i}_{b}": F.max(x).over(near)}
    starts = {w for w, _ in spec.values()} | {k for w, b in blocks.items() for k in range(b, w, b)}
    staged = df.withColumns({f"_run_{c}": e for c, e in run.items()})
    staged = staged.withColumn("_t0", F.struct(*[F.col(f"_run_{c}").alias(c) for c in run]))
    staged = staged.withColumns({f"_t{k}": F.lag("_t0", k).over(base) for k in sorted(starts)})

    def trail(c: str, w: int) -> Column:
        return F.coalesce(F.col("_t0")[c], F.lit(0)) - F.coalesce(F.col(f"_t{w}")[c], F.lit(0))

    cols = {}
    for i, v in enumerate(values):
        for name, (w, how) in spec.items():
            n = trail(f"n{i}", w)
            mean = (trail(f"hi{i}", w).cast("double") * float(2 ** 32) + trail(f"lo{i}", w)) / n
            parts = [(F.col(f"_t{k}"), f"{i}_{blocks[w]}") for k in range(0, w, blocks[w])] if w in blocks else []
            if how == "mean":
                out = mean
            elif how == "std":
                m2 = sum((F.coalesce(t[f"bn{c}"] * (t[f"var{c}"] + (t[f"avg{c}"] - mean) * (t[f"avg{c}"] - mean)), F.lit(0.0))
                          for t, c in parts), F.lit(0.0))
                out = F.when(n > 1, F.sqrt(m2 / (n - 1)))
            else:
                out = F.greatest(*[t[f"max{c}"] for t, c in parts]) if len(parts) > 1 else parts[0][0][f"max{parts[0][1]}"]
            cols[f"{v}_{name}"] = F.when(n >= max(1, w // 4), out)
    return staged.withColumns(cols).select(*[_q(c) for c in df.columns if c not in cols], *[_q(c) for c in cols])


def add_lag_features(df: DataFrame, target: str | Sequence[str], keys: Sequence[str] = (),
                     ts: str = "timestamp_hour") -> DataFrame:
    targets = [target] if isinstance(target, str) else list(target)
    for t in targets:
        df = row_lags(df, t, (1, 2, 3), keys, ts)
        df = clock_lags(df, t, (24, 48, 168, 336), keys, ts)
    for t in targets:
        df = same_slot_mean(df, t, 4, keys, ts)
    return df


def add_rolling_features(df: DataFrame, target: str | Sequence[str], keys: Sequence[str] = (),
                         ts: str = "timestamp_hour") -> DataFrame:
    """The ``ROLLING`` columns: integer targets together by :func:`trailing_sums`, others by sliding frames."""
    targets = [target] if isinstance(target, str) else list(target)
    types = dict(df.dtypes)
    whole = [t for t in targets if types.get(t) in INTEGRAL]
    if whole:
        df = trailing_sums(df, whole, ROLLING, keys, ts)
    for t in targets:
        if t not in whole:
            df = rolling_stats(df, t, ROLLING, keys, ts)
    return df


def add_interactions(df: DataFrame) -> DataFrame:
    cols = set(df.columns)
    music = F.col("is_live_music_window") if "is_live_music_window" in cols else F.lit(0)
    out = {"weekend_x_music": F.col("is_weekend") * music,
           "rain_x_weekend": (F.col("rain_mm") * F.col("is_weekend")) if "rain_mm" in cols else F.lit(0)}
    event_cols = [c for c in ("bank_holiday_flag", "major_sports_event_flag", "city_event_flag",
                              "st_patricks_week_flag", "special_event_flag") if c in cols]
    out["event_intensity"] = sum((F.col(c) for c in event_cols), F.lit(0)) if event_cols else F.lit(0)
    if "airport_arrivals_zscore" in cols and "cruise_ship_flag" in cols:
        out["tourism_pressure"] = F.col("airport_arrivals_zscore") + F.col("cruise_ship_flag").cast("double")
    return df.withColumns(out)


def warmup_columns(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if "_lag_" in c or "_roll_" in c]


def warmup_drop(df: DataFrame) -> DataFrame:
    """Drop rows whose lag/rolling features are not yet defined."""
    return df.dropna(subset=warmup_columns(df.columns))
