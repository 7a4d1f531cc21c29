"""Enrichment signals and joins (survey 2.D).

Daily signal tables are keyed by ``date`` and hold at most one row per day, so
their size is bounded by the date range; that bound (not a guess) decides
whether a join broadcasts them.  Hourly signals join on ``timestamp_hour``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftcast.functions.timecols import col
from shiftcast.operators import series as SR
from shiftcast.session import cut_lineage, join_dimension  # noqa: F401 - re-exported for plans

# Port keywords that mark a cruise vessel by name.
CRUISE_KEYWORDS = (
    "CRUISE", "CELEBRITY", "ROYAL CARIBBEAN", "MSC ", "NORWEGIAN",
    "CARNIVAL", "PRINCESS", "CUNARD", "SILVERSEA", "VIKING",
    "MARELLA", "TUI ", "HURTIGRUTEN", "SEABOURN", "AZAMARA",
    "EVRIMA", "SCENIC", "PONANT", "WINDSTAR",
)
PASSENGERS_PER_SHIP = 2500
EARTH_RADIUS_KM = 6371.0
VENUE_LAT, VENUE_LON = 53.3434, -6.2601
# Widest date span a daily signal table may cover (1900-01-01 … 2100-12-31);
# it is the proven row bound used for broadcasting date dimensions.
MAX_DAYS = 73_415


def severity_flag(code, threshold: int = 61) -> Column:
    return (col(code) >= threshold).cast("int")


def ffill_bfill(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), order: str = "timestamp_hour") -> DataFrame:
    """Forward fill then backward fill within each key, in ``order``; a series without keys is filled chunk by chunk."""
    if not keys:
        return SR.fill(df, cols, order)
    base = Window.partitionBy(*keys).orderBy(order)
    back = base.rowsBetween(Window.unboundedPreceding, 0)
    fwd = base.rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(back),
                                         F.first(c, ignorenulls=True).over(fwd)) for c in cols})


def lag_bfill(df: DataFrame, c: str, out: str, keys: Sequence[str] = (), order: str = "date") -> DataFrame:
    """Previous row's value; leading gaps take the next available lagged value."""
    if not keys:
        lagged = SR.windowed(df, lambda w: {"_lag": F.lag(c, 1).over(w)}, order, 1)
        return SR.fill(lagged, ["_lag"], order, forward=False).withColumn(out, F.col("_lag")).drop("_lag")
    base = Window.partitionBy(*keys).orderBy(order)
    df = df.withColumn("_lag", F.lag(c, 1).over(base))
    fwd = base.rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn(out, F.first("_lag", ignorenulls=True).over(fwd)).drop("_lag")


def quarter_bounds(label) -> tuple[Column, Column]:
    """'Q3 25' / 'Q3 2025' → (first day, last day) of the quarter, NULL if unparsable."""
    m = F.regexp_extract(F.trim(col(label)), r"^Q(\d)\s*(\d{2,4})", 1)
    y = F.regexp_extract(F.trim(col(label)), r"^Q(\d)\s*(\d{2,4})", 2)
    q = F.when(m.isin("1", "2", "3", "4"), m.cast("int"))
    yr = F.when(y != "", y.cast("int"))
    yr = F.when(yr < 100, yr + 2000).otherwise(yr)
    start = F.make_date(yr, (q - 1) * 3 + 1, F.lit(1))
    end = F.date_sub(F.add_months(start, 3), 1)
    return start, end


def quarter_to_daily(df: DataFrame, label: str, total_thousands: str, out: str = "airport_arrivals") -> DataFrame:
    """Quarterly totals (in thousands) spread evenly over the quarter's days (floor division)."""
    start, end = quarter_bounds(label)
    total = F.regexp_replace(col(total_thousands).cast("string"), ",", "").try_cast("double")
    staged = df.select(start.alias("_s"), end.alias("_e"), (total * 1000).cast("long").alias("_pax"))
    staged = staged.filter(F.col("_s").isNotNull() & F.col("_pax").isNotNull())
    days = F.datediff("_e", "_s") + 1
    return staged.select(F.explode(F.sequence("_s", "_e")).alias("date"),
                         F.floor(F.col("_pax") / days).cast("long").alias(out))


def keyword_match(name, vessel_type, keywords: Sequence[str] = CRUISE_KEYWORDS, type_word: str = "cruise") -> Column:
    up = F.upper(col(name))
    hit = F.lower(col(vessel_type)).contains(type_word)
    for k in keywords:
        hit = hit | up.contains(k)
    return hit


def keyword_daily_counts(df: DataFrame, date: str, match: Column, per_item: int = PASSENGERS_PER_SHIP) -> DataFrame:
    """Daily number of matching rows → flag, count and passenger estimate."""
    return (df.filter(match & F.col(date).isNotNull()).groupBy(F.to_date(date).alias("date"))
            .agg(F.count(F.lit(1)).alias("ships_in_port_count"))
            .select("date", F.lit(1).alias("cruise_ship_flag"), "ships_in_port_count",
                    (F.col("ships_in_port_count") * per_item).alias("cruise_passenger_estimate")))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    r = F.radians
    dlat = r(col(lat2) - col(lat1))
    dlon = r(col(lon2) - col(lon1))
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(r(col(lat1))) * F.cos(r(col(lat2))) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(EARTH_RADIUS_KM) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def geo_radius(df: DataFrame, lat: str, lon: str, center=(VENUE_LAT, VENUE_LON), radius_km: float = 5.0,
               out: str = "dist_km") -> DataFrame:
    """Rows within ``radius_km`` of ``center``; a lat/lon box filter runs first
    (a plain range predicate the Parquet reader can push down)."""
    clat, clon = center
    dlat = math.degrees(radius_km / EARTH_RADIUS_KM) * 1.001
    dlon = dlat / max(math.cos(math.radians(abs(clat) + dlat)), 1e-6)
    box = F.col(lat).between(clat - dlat, clat + dlat) & F.col(lon).between(clon - dlon, clon + dlon)
    d = haversine_km(F.lit(clat), F.lit(clon), F.col(lat), F.col(lon))
    return df.filter(box).withColumn(out, d).filter(F.col(out) <= radius_km)


def interval_daily_counts(df: DataFrame, start: str, end: str, flags: dict[str, Column] | None = None,
                          cap: str | None = None, method: str = "delta", count_name: str = "failte_event_count",
                          ) -> DataFrame:
    """Intervals [start, end] (NULL end = start, end cut at ``cap`` if given, end < start = no day)
    → per day: number of covering intervals and of flagged ones.

    ``explode`` emits one row per covered day (cost ∝ total interval length).
    ``delta`` gives +1 at start and −1 after end from one pass over the rows,
    sums them per day, runs a cumulative sum over the days where something
    changes (bounded by the calendar) and repeats each level up to the next one.
    """
    flags = flags or {}
    s = F.to_date(col(start))
    e = F.coalesce(F.to_date(col(end)), s)
    if cap is not None:
        e = F.least(e, F.lit(cap).cast("date"))
    staged = df.select(s.alias("_s"), e.alias("_e"),
                       *[F.coalesce(v.cast("int"), F.lit(0)).alias(k) for k, v in flags.items()])
    staged = staged.filter(F.col("_s").isNotNull() & (F.col("_e") >= F.col("_s")))
    names = [count_name, *flags]
    if method == "explode":
        ex = staged.select(F.explode(F.sequence("_s", "_e")).alias("date"), *flags)
        return ex.groupBy("date").agg(F.count(F.lit(1)).alias(count_name),
                                      *[F.sum(k).cast("long").alias(k) for k in flags])
    deltas = staged.select(F.explode(F.array(
        F.struct(F.col("_s").alias("date"), F.lit(1).alias(count_name), *flags),
        F.struct(F.date_add("_e", 1).alias("date"), F.lit(-1).alias(count_name), *[(-F.col(k)).alias(k) for k in flags])
    )).alias("_d")).select("_d.*").groupBy("date").agg(*[F.sum(n).cast("long").alias(n) for n in names])
    order = Window.orderBy("date")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    run = deltas.select("date", F.lead("date").over(order).alias("_next"), *[F.sum(n).over(upto).cast("long").alias(n) for n in names])
    return (run.filter((F.col(count_name) > 0) & F.col("_next").isNotNull())
            .select(F.explode(F.sequence("date", F.date_sub("_next", 1))).alias("date"), *names))


def names_per_day(df: DataFrame, date: str, name: str, order: str, out_names: str = "event_names",
                  out_flag: str = "event_flag") -> DataFrame:
    """Names of a day joined with " | " in ``order``, plus a presence flag."""
    g = df.groupBy(F.to_date(date).alias("date")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"),
                                                                       F.col(name).alias("n")))),
                                 lambda s: s["n"]), " | ").alias(out_names))
    return g.withColumn(out_flag, F.lit(1))


def one_row_per(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """``df`` with one row for each value of ``on`` (the smallest by the other
    columns), so that a join on them never multiplies rows."""
    rest = [c for c in df.columns if c not in on]
    if not rest:
        return df.distinct()
    return df.groupBy(*on).agg(F.min(F.struct(*rest)).alias("_r")).select(*on, "_r.*")


def stored_signal(signal: DataFrame, keys: Sequence[str] = (), time: str = "date") -> DataFrame:
    """The signal with one row per join key, written once: merges read it with ``unique=True`` and neither
    rebuild it nor bring it to one row again."""
    return cut_lineage(one_row_per(signal, signal_keys(signal, keys, time)))


def signal_keys(signal: DataFrame, keys: Sequence[str], time: str) -> list[str]:
    """Join columns of a signal: its time column and those of ``keys`` it has (none: it holds for all keys)."""
    return [*[k for k in keys if k in signal.columns], time]


def enrich_spine(spine: DataFrame, tables: Sequence[DataFrame], n_days: int | None = None,
                 zero_int: Sequence[str] = (), zero_keep: Sequence[str] = ("event_impact_score",),
                 fill_forward: Sequence[str] = (), keys: Sequence[str] = (), unique: bool = False) -> DataFrame:
    """Date spine + left joins of daily tables, then the null policy:
    ``*_flag`` and ``zero_int`` columns → 0 as int, ``zero_keep`` → 0 uncast,
    ``fill_forward`` columns forward/backward filled then 0.

    With ``keys`` (say, a venue) a table that has them joins on (keys, date);
    one that lacks them holds for every key.  Tables are brought to one row per
    join key, unless the caller says they have that (``unique``).  ``n_days`` bounds the rows of each table: within it they are
    broadcast, without it the planner and AQE choose.
    """
    out = spine
    for t in tables:
        on = signal_keys(t, keys, "date")
        out = join_dimension(out, t if unique else one_row_per(t, on), on, "left", bound_rows=n_days)
    if fill_forward:
        out = ffill_bfill(out, [c for c in fill_forward if c in out.columns], order="date", keys=keys)
    fills = {}
    for c in out.columns:
        if c == "date" or c in keys:
            continue
        if c.endswith("_flag") or c in zero_int or c in fill_forward:
            fills[c] = F.coalesce(F.col(c), F.lit(0)).cast("int" if c not in fill_forward else "long")
        elif c in zero_keep:
            fills[c] = F.coalesce(F.col(c), F.lit(0))
    out = out.withColumns(fills)
    sport = [c for c in ("aviva_event_flag", "croke_park_event_flag") if c in out.columns]
    if sport:
        out = out.withColumn("major_sports_event_flag", (sum((F.col(c) for c in sport), F.lit(0)) > 0).cast("int"))
    return out


def merge_daily_replace(df: DataFrame, daily: DataFrame, ts: str = "timestamp_hour",
                        n_days: int | None = None, keys: Sequence[str] = (), unique: bool = False) -> DataFrame:
    """Left-join a daily table on the row's date, and on those of ``keys`` that
    it has; its columns *replace* equal-named columns of ``df`` (no suffixes).

    The table is brought to one row per join key, unless the caller says it has that (``unique``).  ``n_days`` bounds its rows:
    within it the table is broadcast, without it the planner and AQE choose.
    """
    right = daily.withColumnRenamed("date", "_date")
    on = signal_keys(right, keys, "_date")
    overlap = [c for c in right.columns if c not in on and c in df.columns]
    left = df.drop(*overlap).withColumn("_date", F.to_date(ts))
    return join_dimension(left, right if unique else one_row_per(right, on), on, "left", bound_rows=n_days).drop("_date").select(
        *[c for c in left.columns if c != "_date"], *[c for c in right.columns if c not in on])


def merge_hourly(df: DataFrame, footfall: DataFrame | None = None, weather: DataFrame | None = None,
                 ts: str = "timestamp_hour", bound_rows: int | None = None, keys: Sequence[str] = (), unique: bool = False) -> DataFrame:
    """Hourly joins: footfall columns (replacing equal names) are zero-filled;
    weather replaces overlapping columns and keeps NULLs.

    A signal that has some of ``keys`` joins on them and the hour, another one
    on the hour alone; each is brought to one row per join key, unless the caller
    says they have that (``unique``).  ``bound_rows``
    is the caller's proven bound on the signal tables (one row per hour or day
    of a known range); within it they are broadcast, beyond it the planner and
    AQE choose.
    """
    out = df
    for signal, fill in ((footfall, True), (weather, False)):
        if signal is None:
            continue
        on = signal_keys(signal, keys, ts)
        new = [c for c in signal.columns if c not in on]
        left = out.drop(*[c for c in new if c in out.columns])
        out = join_dimension(left, signal if unique else one_row_per(signal, on), on, "left", bound_rows=bound_rows).select(*left.columns, *new)
        if fill:
            out = out.withColumns({c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in new})
    return out


def coerce_zero_fill(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Numeric coercion with 0 for NULL / unparsable, for the columns present.

    Numeric columns keep their type; text columns are parsed as double.
    """
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    types = dict(df.dtypes)
    out = {}
    for c in cols:
        if c not in types:
            continue
        if types[c] in numeric or types[c].startswith("decimal"):
            out[c] = F.coalesce(F.col(c), F.lit(0).cast(types[c]))
        elif types[c] == "boolean":
            out[c] = F.coalesce(F.col(c).cast("int"), F.lit(0))
        else:
            out[c] = F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    return df.withColumns(out)


def zscore(df: DataFrame, c: str, out: str, keys: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """Whole-sample z-score per key, only where the sample std is > 0.

    Keyed: mean and std are whole-partition window aggregates, so they reuse
    the hash partitioning on the keys that the per-key lag windows need (no
    extra shuffle, no join).  Unkeyed: a one-row statistics aggregate is
    broadcast back (no unpartitioned window over the data).
    """
    if keys:
        w = Window.partitionBy(*keys)
        mu, sd = F.avg(c).over(w), F.stddev_samp(c).over(w)
        j = df.withColumns({"_mu": mu, "_sd": sd})
    else:
        stats = df.groupBy(F.lit(0).alias("_all")).agg(F.avg(c).alias("_mu"), F.stddev_samp(c).alias("_sd"))
        j = df.withColumn("_all", F.lit(0)).join(F.broadcast(stats), "_all").drop("_all")
    z = F.when(F.col("_sd") > 0, (F.col(c) - F.col("_mu")) / F.col("_sd"))
    if digits is not None:
        z = F.bround(z, digits)
    return j.withColumn(out, z).drop("_mu", "_sd")


def zscore_asof(df: DataFrame, c: str, out: str, keys: Sequence[str] = (), order: str = "date") -> DataFrame:
    """Leakage-safe z-score: mean and std of strictly earlier rows of the key."""
    w = (Window.partitionBy(*keys) if keys else Window).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    mu, sd = F.avg(c).over(w), F.stddev_samp(c).over(w)
    return df.withColumn(out, F.when(sd > 0, (F.col(c) - mu) / sd))
