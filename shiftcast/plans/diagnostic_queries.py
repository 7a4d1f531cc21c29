"""Registered queries for survey 2.I (diagnostics)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftcast.operators import diagnostics as D
from shiftcast.operators import features as FT
from shiftcast.operators import forecast as FC
from shiftcast.operators.enrich import MAX_DAYS, merge_daily_replace
from shiftcast.plans.enrich_queries import enrichment_table
from shiftcast.plans.feature_queries import _feature_table_sql, p3_feature_table
from shiftcast.plans.segment_queries import _case
from shiftcast.plans import sqlstandins as SQ
from shiftcast.plans.sqlpanels import P1, P1K, with_panels
from shiftcast.registry import register
from shiftcast.sources import standins as ST
from shiftcast.sources.tables import panel_p1, panel_p3

TS = "timestamp_hour"
K = ["event_type"]
CORR_COLS = ["orders_count", "suffolk_footfall_lag_24h", "suffolk_footfall_roll_24h", "rain_mm", "temp_c",
             "event_intensity", "failte_event_count", "airport_arrivals_zscore"]


def sql_corr(a: str, b: str) -> str:
    """DuckDB correlation with NaN (zero variance) as NULL, like ``diagnostics.safe_corr``."""
    return f"(CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END)"


def _r6(c):
    return (F.round(c, 6) + F.lit(0.0)).alias(c)


def _corr_sql() -> str:
    pairs = [(i, j, a, b) for i, a in enumerate(CORR_COLS) for j, b in enumerate(CORR_COLS)]
    aggs = ", ".join(f"round({sql_corr(f'CAST({a} AS DOUBLE)', f'CAST({b} AS DOUBLE)')}, 6) + 0.0 AS c_{i}_{j}"
                     for i, j, a, b in pairs)
    case = " ".join(f"WHEN col_a = '{a}' AND col_b = '{b}' THEN c_{i}_{j}" for i, j, a, b in pairs)
    values = ", ".join(f"('{a}', '{b}')" for _, _, a, b in pairs)
    return f"""
WITH ft AS ({_feature_table_sql()})
SELECT col_a, col_b, CASE {case} END AS corr
FROM (VALUES {values}) pr(col_a, col_b) JOIN (SELECT {aggs} FROM ft) x ON true"""


@register("corr_matrix", sql=_corr_sql())
def q_corr_matrix(spark, sf):
    m = D.corr_matrix(p3_feature_table(spark, sf), CORR_COLS)
    return m.select("col_a", "col_b", _r6("corr"))


def _box_sql(src: str, value: str, group: list[str]) -> str:
    g = ", ".join(group)
    on = " AND ".join(f"s.{c} = q.{c}" for c in group)
    return f"""
WITH s AS ({src}),
q AS (SELECT {g}, quantile_cont(CAST({value} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({value} AS DOUBLE), 0.5) AS median,
             quantile_cont(CAST({value} AS DOUBLE), 0.75) AS q3 FROM s GROUP BY ALL)
SELECT {', '.join('q.' + c for c in group)}, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  count({value}) AS n,
  round(min(CASE WHEN {value} >= q1 - 1.5 * (q3 - q1) THEN CAST({value} AS DOUBLE) END), 6) AS whisker_lo,
  round(max(CASE WHEN {value} <= q3 + 1.5 * (q3 - q1) THEN CAST({value} AS DOUBLE) END), 6) AS whisker_hi,
  count(*) FILTER (WHERE {value} < q1 - 1.5 * (q3 - q1) OR {value} > q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM s JOIN q ON {on}
GROUP BY {', '.join('q.' + c for c in group)}, q1, median, q3"""


def _box_out(df, group):
    return df.select(*group, *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")], "n",
                     F.round("whisker_lo", 6).alias("whisker_lo"), F.round("whisker_hi", 6).alias("whisker_hi"),
                     "n_outliers")


@register("box_stats", sql=_box_sql(f"""
SELECT orders_count, CASE WHEN st_patricks_week_flag = 1 THEN 'St. Patrick''s Week'
                          WHEN aviva_event_flag = 1 THEN 'Aviva Event' ELSE 'Normal Day' END AS anomaly_type
FROM ({_feature_table_sql()}) ft""", "orders_count", ["anomaly_type"]))
def q_box_stats(spark, sf):
    # the panel and the two flags that make the classes; the rest of the feature table isn't needed
    flags = enrichment_table(spark, sf).select("date", "st_patricks_week_flag", "aviva_event_flag")
    ft = D.anomaly_class(merge_daily_replace(panel_p3(spark, sf), flags, n_days=MAX_DAYS))
    return _box_out(D.box_stats(ft, "orders_count", ["anomaly_type"], bound_groups=D.ANOMALY_CLASSES), ["anomaly_type"])


FOLDS = dict(n_splits=4, test_weeks=1, min_train_weeks=1)

_P1_BASELINE_SQL = """
pl AS (SELECT p.*, q.orders_count AS lag168 FROM p LEFT JOIN p q ON q.timestamp_hour = p.timestamp_hour - INTERVAL 168 HOUR),
cut AS (SELECT CAST(i AS INTEGER) AS fold,
           make_timestamp(epoch_us(first) + CAST(floor(i * CAST(epoch_us(last) - epoch_us(first) AS DOUBLE) / 3)
                                                 AS BIGINT)) AS cutoff
        FROM (SELECT min(timestamp_hour) + INTERVAL 7 DAY AS first, max(timestamp_hour) - INTERVAL 7 DAY AS last
              FROM p) b, range(0, 4) r(i) WHERE first <= last),
train AS (SELECT c.fold, p.timestamp_hour, p.orders_count, hour(p.timestamp_hour) AS h,
                 isodow(p.timestamp_hour) - 1 AS wd FROM p JOIN cut c ON p.timestamp_hour <= c.cutoff),
slots AS (SELECT fold, h, wd, avg(orders_count) AS sm FROM
            (SELECT *, row_number() OVER (PARTITION BY fold, h, wd ORDER BY timestamp_hour DESC) AS rn FROM train)
          WHERE rn <= 8 GROUP BY ALL),
test AS (SELECT pl.*, c.fold FROM pl JOIN cut c ON pl.timestamp_hour > c.cutoff
         AND pl.timestamp_hour <= c.cutoff + INTERVAL 7 DAY),
bp AS (SELECT t.fold, t.timestamp_hour, t.orders_count AS y,
              greatest(coalesce(CAST(t.lag168 AS DOUBLE), s.sm, 0.0), 0.0) AS pred
       FROM test t LEFT JOIN slots s ON s.fold = t.fold AND s.h = hour(t.timestamp_hour)
         AND s.wd = isodow(t.timestamp_hour) - 1)"""

_DAYNAME = "['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'][isodow(timestamp_hour)]"


@register("residual_profile", sql=_box_sql(with_panels(f"""
SELECT bp.pred - bp.y AS residual, {_DAYNAME.replace('timestamp_hour', 'p.timestamp_hour')} AS day_of_week,
       {_case('eda', 'hour(p.timestamp_hour)')} AS shift
FROM bp JOIN p ON p.timestamp_hour = bp.timestamp_hour""", ctes=_P1_BASELINE_SQL, p=P1), "residual",
                                              ["day_of_week", "shift"]))
def q_residual_profile(spark, sf):
    p = FT.clock_lags(panel_p1(spark, sf), "orders_count", (168,))
    preds = FC.baseline_backtest(p, "orders_count", lag_col="orders_count_lag_168h", **FOLDS)
    oos = FC.oos_residuals(preds, "orders_count")
    prof = D.residual_profile(oos, panel_p1(spark, sf))
    return _box_out(prof, ["day_of_week", "shift"])


@register("acf", sql=with_panels("""
SELECT a.event_type, CAST(a.k AS INTEGER) AS lag, round(coalesce(sum(a.c * b.c), 0) / max(d.den), 6) + 0.0 AS acf
FROM (SELECT event_type, c, rn, unnest(range(0, 169)) AS k FROM x) a
JOIN d ON d.event_type = a.event_type
LEFT JOIN x b ON b.event_type = a.event_type AND b.rn = a.rn - a.k
GROUP BY a.event_type, a.k""", ctes="""
x AS (SELECT event_type, CAST(orders_count AS DOUBLE) - avg(orders_count) OVER (PARTITION BY event_type) AS c,
             row_number() OVER (PARTITION BY event_type ORDER BY timestamp_hour) AS rn FROM p),
d AS (SELECT event_type, sum(c * c) AS den FROM x GROUP BY 1)""", p=P1K))
def q_acf(spark, sf):
    a = D.acf(panel_p1(spark, sf, keyed=True), "orders_count", K, nlags=168)
    return a.select(*K, "lag", _r6("acf"))


@register("pacf", sql=with_panels("""
SELECT event_type, k AS lag, round(pacf, 6) + 0.0 AS pacf FROM dl""", ctes="""
x AS (SELECT event_type, CAST(orders_count AS DOUBLE) - avg(orders_count) OVER (PARTITION BY event_type) AS c,
             row_number() OVER (PARTITION BY event_type ORDER BY timestamp_hour) AS rn FROM p),
d AS (SELECT event_type, sum(c * c) AS den FROM x GROUP BY 1),
ac AS (SELECT a.event_type, a.k, coalesce(sum(a.c * b.c), 0) / max(d.den) AS r
       FROM (SELECT event_type, c, rn, unnest(range(0, 49)) AS k FROM x) a
       JOIN d ON d.event_type = a.event_type
       LEFT JOIN x b ON b.event_type = a.event_type AND b.rn = a.rn - a.k
       GROUP BY a.event_type, a.k),
al AS (SELECT event_type, list(r ORDER BY k) AS r FROM ac GROUP BY 1),
dl(event_type, k, phi, sigma, pacf) AS (
  SELECT event_type, 0, CAST([] AS DOUBLE[]), r[1], CAST(1.0 AS DOUBLE) FROM al
  UNION ALL
  SELECT dl.event_type, dl.k + 1,
         list_transform(range(1, dl.k + 1), lambda j: dl.phi[j] - x.av * dl.phi[dl.k + 1 - j]) || [x.av],
         dl.sigma * (1 - x.av * x.av), x.av
  FROM dl JOIN al ON al.event_type = dl.event_type,
  LATERAL (SELECT (al.r[dl.k + 2] - coalesce(list_sum(list_transform(range(1, dl.k + 1),
                                                 lambda j: dl.phi[j] * al.r[dl.k + 2 - j])), 0)) / dl.sigma AS av) x
  WHERE dl.k < 48)""", p=P1K).replace("WITH ", "WITH RECURSIVE ", 1))
def q_pacf(spark, sf):
    pc = D.pacf(panel_p1(spark, sf, keyed=True), "orders_count", K, nlags=48)
    return pc.select(*K, "lag", _r6("pacf"))


def _p1_with_footfall(spark, sf):
    h = ST.events_hourly(spark, sf).select(TS, "footfall_views")
    return panel_p1(spark, sf).join(h, TS, "left")


_P1_FOOT = f"""SELECT p.*, h.footfall_views FROM p LEFT JOIN ({SQ.EVENTS_HOURLY}) h USING (timestamp_hour)"""


@register("cross_corr", sql=with_panels("""
SELECT CAST(l.lag AS INTEGER) AS lag, round(CASE WHEN isnan(corr(CAST(a.orders_count AS DOUBLE), CAST(b.footfall_views AS DOUBLE))) THEN NULL
                         ELSE corr(CAST(a.orders_count AS DOUBLE), CAST(b.footfall_views AS DOUBLE)) END, 6) + 0.0 AS xcorr
FROM (SELECT unnest(range(-24, 25)) AS lag) l
CROSS JOIN x a
LEFT JOIN x b ON b.rn = a.rn - l.lag
GROUP BY l.lag""", ctes="x AS (SELECT *, row_number() OVER (ORDER BY timestamp_hour) AS rn FROM pf)", p=P1, pf=_P1_FOOT))
def q_cross_corr(spark, sf):
    x = D.cross_corr(_p1_with_footfall(spark, sf), "orders_count", "footfall_views", max_lag=24)
    return x.select("lag", _r6("xcorr"))


@register("describe_targets", sql=with_panels(" UNION ALL ".join(f"""
SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
       CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS p25,
       round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS p50, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS p75,
       CAST(max({c}) AS DOUBLE) AS max FROM p""" for c in ("orders_count", "food_tickets_count")), p=P1))
def q_describe_targets(spark, sf):
    d = D.describe(panel_p1(spark, sf), ["orders_count", "food_tickets_count"])
    return d.select("column", "count", *[F.round(c, 6).alias(c) for c in ("mean", "std")], "min",
                    *[F.round(c, 6).alias(c) for c in ("p25", "p50", "p75")], "max")


@register("hour_profile", sql=with_panels("""
SELECT event_type, CAST(hour(timestamp_hour) AS INTEGER) AS hour, round(avg(orders_count), 6) AS mean,
       round(stddev_samp(orders_count), 6) AS std FROM p GROUP BY 1, 2""", p=P1K))
def q_hour_profile(spark, sf):
    h = D.hour_profile(panel_p1(spark, sf, keyed=True), "orders_count", K)
    return h.select(*K, "hour", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@register("weekday_profile", sql=with_panels("""
SELECT event_type, CAST(isodow(timestamp_hour) - 1 AS INTEGER) AS weekday, round(avg(orders_count), 6) AS mean
FROM p GROUP BY 1, 2""", p=P1K))
def q_weekday_profile(spark, sf):
    w = D.weekday_profile(panel_p1(spark, sf, keyed=True), "orders_count", K)
    return w.select(*K, "weekday", F.round("mean", 6).alias("mean"))


@register("shift_scatter", sql=with_panels(f"""
SELECT timestamp_hour, footfall_views, orders_count, shift FROM
  (SELECT *, {_case('eda', 'hour(timestamp_hour)')} AS shift FROM pf) WHERE shift <> 'Off-Peak'""", p=P1, pf=_P1_FOOT))
def q_shift_scatter(spark, sf):
    return D.shift_scatter(_p1_with_footfall(spark, sf), "footfall_views", "orders_count")
