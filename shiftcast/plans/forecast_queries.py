"""Registered queries for survey 2.H (baseline, walk-forward evaluation, metrics)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftcast.operators import features as FT
from shiftcast.operators import forecast as FC
from shiftcast.plans.segment_queries import _case
from shiftcast.plans.sqlpanels import P1, P1K, P2, with_panels
from shiftcast.registry import register
from shiftcast.sources.tables import panel_p1, panel_p2

K = ["event_type"]
TS = "timestamp_hour"
# Small-panel fold settings: the events table spans 30 days.
FOLDS = dict(n_splits=4, test_weeks=1, min_train_weeks=1)


def _cut_sql(keyed: bool) -> str:
    k = "event_type, " if keyed else ""
    g = "GROUP BY event_type" if keyed else ""
    return f"""
cut AS (SELECT {k}CAST(i AS INTEGER) AS fold,
           make_timestamp(epoch_us(first) + CAST(floor(i * CAST(epoch_us(last) - epoch_us(first) AS DOUBLE) / 3)
                                                 AS BIGINT)) AS cutoff
        FROM (SELECT {k}min(timestamp_hour) + INTERVAL 7 DAY AS first, max(timestamp_hour) - INTERVAL 7 DAY AS last
              FROM p {g}) b, range(0, 4) r(i)
        WHERE first <= last)"""


@register("walk_forward_folds", sql=with_panels("""
SELECT c.fold, p.timestamp_hour, 'train' AS role FROM p JOIN cut c ON p.timestamp_hour <= c.cutoff
UNION ALL
SELECT c.fold, p.timestamp_hour, 'test' FROM p JOIN cut c
  ON p.timestamp_hour > c.cutoff AND p.timestamp_hour <= c.cutoff + INTERVAL 7 DAY""", ctes=_cut_sql(False), p=P1))
def q_walk_forward_folds(spark, sf):
    return FC.walk_forward_folds(panel_p1(spark, sf), **FOLDS)


@register("val_split", sql=with_panels("""
SELECT event_type, fold, timestamp_hour,
  row_number() OVER (PARTITION BY event_type, fold ORDER BY timestamp_hour DESC)
    <= greatest(CAST(floor(count(*) OVER (PARTITION BY event_type, fold) * 0.2) AS BIGINT), 200) AS is_val
FROM (SELECT p.event_type, c.fold, p.timestamp_hour FROM p JOIN cut c
      ON c.event_type = p.event_type AND p.timestamp_hour <= c.cutoff)""", ctes=_cut_sql(True), p=P1K))
def q_val_split(spark, sf):
    p = panel_p1(spark, sf, keyed=True)
    cut = FC.fold_cutoffs(p, K, **FOLDS)
    train = FC.fold_rows(p, cut, "train", K).select(*K, "fold", TS)
    return FC.val_split_cut(train, group=[*K, "fold"])


_BASE_SQL = f"""
pl AS (SELECT p.*, q.orders_count AS lag168 FROM p LEFT JOIN p q
       ON q.event_type = p.event_type AND q.timestamp_hour = p.timestamp_hour - INTERVAL 168 HOUR),
{_cut_sql(True).strip()},
train AS (SELECT p.event_type, c.fold, p.timestamp_hour, p.orders_count,
                 hour(p.timestamp_hour) AS h, isodow(p.timestamp_hour) - 1 AS wd
          FROM p JOIN cut c ON c.event_type = p.event_type AND p.timestamp_hour <= c.cutoff),
slots AS (SELECT event_type, fold, h, wd, avg(orders_count) AS sm FROM
            (SELECT *, row_number() OVER (PARTITION BY event_type, fold, h, wd ORDER BY timestamp_hour DESC) AS rn
             FROM train) WHERE rn <= 8 GROUP BY ALL),
test AS (SELECT pl.*, c.fold FROM pl JOIN cut c ON c.event_type = pl.event_type
         AND pl.timestamp_hour > c.cutoff AND pl.timestamp_hour <= c.cutoff + INTERVAL 7 DAY),
bp AS (SELECT t.event_type, t.fold, t.timestamp_hour, t.orders_count AS y,
              greatest(coalesce(CAST(t.lag168 AS DOUBLE), s.sm, 0.0), 0.0) AS pred
       FROM test t LEFT JOIN slots s ON s.event_type = t.event_type AND s.fold = t.fold
         AND s.h = hour(t.timestamp_hour) AND s.wd = isodow(t.timestamp_hour) - 1)"""


def _baseline(spark, sf):
    p = FT.clock_lags(panel_p1(spark, sf, keyed=True), "orders_count", (168,), K)
    return FC.baseline_backtest(p, "orders_count", K, lag_col="orders_count_lag_168h", **FOLDS)


@register("baseline_forecast", sql=with_panels("""
SELECT event_type, fold, timestamp_hour, y, round(pred, 6) AS pred FROM bp""", ctes=_BASE_SQL, p=P1K))
def q_baseline_forecast(spark, sf):
    b = _baseline(spark, sf)
    return b.select(*K, "fold", TS, F.col("orders_count").alias("y"), F.round("pred", 6).alias("pred"))


_METRICS_SQL = """
m AS (SELECT event_type, fold, count(*) AS n_test, avg(abs(greatest(pred, 0) - y)) AS mae,
             sqrt(avg((greatest(pred, 0) - y) ^ 2)) AS rmse,
             avg(CASE WHEN y > 1 THEN abs((greatest(pred, 0) - y) / y) END) * 100 AS mape
      FROM bp GROUP BY 1, 2)"""


def _metrics(spark, sf):
    return FC.forecast_metrics(_baseline(spark, sf), "orders_count", group=[*K, "fold"])


@register("forecast_metrics", sql=with_panels("""
SELECT event_type, fold, n_test, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(mape, 6) AS mape FROM m""",
                                              ctes=_BASE_SQL + ",\n" + _METRICS_SQL.strip(), p=P1K))
def q_forecast_metrics(spark, sf):
    m = _metrics(spark, sf)
    return m.select(*K, "fold", "n_test", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "mape")])


@register("cv_summary", sql=with_panels("""
SELECT event_type, count(*) AS n_folds,
  round(avg(mae), 6) AS mae_mean, round(stddev_samp(mae), 6) AS mae_std,
  round(avg(rmse), 6) AS rmse_mean, round(stddev_samp(rmse), 6) AS rmse_std,
  round(avg(mape), 6) AS mape_mean, round(stddev_samp(mape), 6) AS mape_std
FROM m GROUP BY event_type""", ctes=_BASE_SQL + ",\n" + _METRICS_SQL.strip(), p=P1K))
def q_cv_summary(spark, sf):
    s = FC.cv_summary(_metrics(spark, sf), group=K)
    return s.select(*K, "n_folds", *[F.round(c, 6).alias(c) for c in s.columns if c.endswith(("_mean", "_std"))])


@register("oos_residuals", sql=with_panels("""
SELECT event_type, timestamp_hour, y, round(pred, 6) AS pred, fold, round(pred - y, 6) AS residual FROM bp""",
                                           ctes=_BASE_SQL, p=P1K))
def q_oos_residuals(spark, sf):
    r = FC.oos_residuals(_baseline(spark, sf), "orders_count", keys=K)
    return r.select(*K, TS, "y", F.round("pred", 6).alias("pred"), "fold", F.round("residual", 6).alias("residual"))


@register("asym_loss", sql=with_panels("""
SELECT event_type, fold,
  round(avg(CASE WHEN y - pred > 0 THEN 2 * (y - pred) ^ 2 ELSE (y - pred) ^ 2 END), 6) AS asym_loss,
  round(avg(CAST(y - pred > 0 AS DOUBLE)), 6) AS under_share
FROM bp GROUP BY 1, 2""", ctes=_BASE_SQL, p=P1K))
def q_asym_loss(spark, sf):
    a = FC.asymmetric_loss(_baseline(spark, sf), "orders_count", group=[*K, "fold"])
    return a.select(*K, "fold", F.round("asym_loss", 6).alias("asym_loss"), F.round("under_share", 6).alias("under_share"))


def _lab(v: str) -> str:
    return (f"CASE WHEN {v} <= coalesce(a, 10) THEN 'quiet' WHEN {v} <= coalesce(b, 30) THEN 'normal' "
            f"WHEN {v} <= coalesce(c, 50) THEN 'busy' ELSE 'slammed' END")


@register("shift_label_accuracy", sql=with_panels(f"""
SELECT event_type, fold, round(avg(CAST({_lab('yt')} = {_lab('pt')} AS DOUBLE)), 6) AS shift_accuracy,
       count(*) AS n_shifts
FROM act JOIN prd USING (event_type, fold, d, shift) LEFT JOIN thr USING (event_type, fold, shift)
GROUP BY 1, 2""", ctes=_BASE_SQL + f""",
trs AS (SELECT event_type, fold, CAST(timestamp_hour AS DATE) AS d,
               {_case('label', 'hour(timestamp_hour)')} AS shift, orders_count FROM train),
thr AS (SELECT event_type, fold, shift, quantile_cont(CAST(v AS DOUBLE), 0.25) AS a,
               quantile_cont(CAST(v AS DOUBLE), 0.65) AS b, quantile_cont(CAST(v AS DOUBLE), 0.88) AS c
        FROM (SELECT event_type, fold, d, shift, sum(orders_count) AS v FROM trs WHERE shift <> 'none'
              GROUP BY ALL) GROUP BY ALL),
bs AS (SELECT *, CAST(timestamp_hour AS DATE) AS d, {_case('label', 'hour(timestamp_hour)')} AS shift FROM bp),
act AS (SELECT event_type, fold, d, shift, sum(y) AS yt FROM bs WHERE shift <> 'none' GROUP BY ALL),
prd AS (SELECT event_type, fold, d, shift, sum(pred) AS pt FROM bs WHERE shift <> 'none' GROUP BY ALL)""",
                                                  p=P1K))
def q_shift_label_accuracy(spark, sf):
    p = FT.clock_lags(panel_p1(spark, sf, keyed=True), "orders_count", (168,), K)
    cut = FC.fold_cutoffs(p, K, **FOLDS)
    preds = _baseline(spark, sf)
    acc = FC.fold_shift_accuracy(p, preds, "orders_count", "pred", K, cutoffs=cut)
    return acc.select(*K, "fold", F.round("shift_accuracy", 6).alias("shift_accuracy"), "n_shifts")


_HOURS = ", ".join(f"({h})" for h in list(range(9, 24)) + [0, 1])


@register("next_day_baseline", sql=with_panels(f"""
SELECT s.event_type, s.timestamp_hour,
  round(greatest(coalesce(CAST(q.orders_count AS DOUBLE), sl.sm, 0.0), 0.0), 6) AS baseline_pred,
  {_case('label', 'hour(s.timestamp_hour)')} AS shift
FROM stub s
LEFT JOIN p q ON q.event_type = s.event_type AND q.timestamp_hour = s.timestamp_hour - INTERVAL 168 HOUR
LEFT JOIN slots sl ON sl.event_type = s.event_type AND sl.h = hour(s.timestamp_hour)
  AND sl.wd = isodow(s.timestamp_hour) - 1""", ctes=f"""
stub AS (SELECT event_type, CAST(CAST(lt AS DATE) + 1 AS TIMESTAMP) + to_hours(h) AS timestamp_hour
         FROM (SELECT event_type, max(timestamp_hour) AS lt FROM p GROUP BY 1) l, (VALUES {_HOURS}) v(h)),
slots AS (SELECT event_type, h, wd, avg(orders_count) AS sm FROM
            (SELECT *, hour(timestamp_hour) AS h, isodow(timestamp_hour) - 1 AS wd,
                    row_number() OVER (PARTITION BY event_type, hour(timestamp_hour), isodow(timestamp_hour)
                                       ORDER BY timestamp_hour DESC) AS rn FROM p)
          WHERE rn <= 8 GROUP BY ALL)""", p=P1K))
def q_next_day_baseline(spark, sf):
    nd = FC.next_day_baseline(panel_p1(spark, sf, keyed=True), "orders_count", K)
    return nd.select(*K, TS, F.round("baseline_pred", 6).alias("baseline_pred"), "shift")


# The default folds (8 splits, 4 test weeks, 12 training weeks) on the six years of daily orders by market segment.
SEGMENT = ["c_mktsegment"]


def _years_sql(sql: str) -> str:
    for old, new in (("event_type", "c_mktsegment"), ("min(timestamp_hour) + INTERVAL 7 DAY", "min(timestamp_hour) + INTERVAL 84 DAY"),
                     ("max(timestamp_hour) - INTERVAL 7 DAY", "max(timestamp_hour) - INTERVAL 28 DAY"),
                     ("cutoff + INTERVAL 7 DAY", "cutoff + INTERVAL 28 DAY"), ("/ 3)", "/ 7)"), ("range(0, 4)", "range(0, 8)")):
        sql = sql.replace(old, new)
    return sql


def _years_backtest(spark, sf):
    p = FT.clock_lags(panel_p2(spark, sf), "orders_count", (168,), SEGMENT)
    return FC.baseline_backtest(p, "orders_count", SEGMENT, lag_col="orders_count_lag_168h")


@register("walk_forward_folds_years", sql=with_panels("""
SELECT c.c_mktsegment, c.fold, p.timestamp_hour, 'train' AS role FROM p JOIN cut c ON c.c_mktsegment = p.c_mktsegment AND p.timestamp_hour <= c.cutoff
UNION ALL
SELECT c.c_mktsegment, c.fold, p.timestamp_hour, 'test' FROM p JOIN cut c
  ON c.c_mktsegment = p.c_mktsegment AND p.timestamp_hour > c.cutoff AND p.timestamp_hour <= c.cutoff + INTERVAL 28 DAY""",
                                                      ctes=_years_sql(_cut_sql(True)), p=P2))
def q_walk_forward_folds_years(spark, sf):
    return FC.walk_forward_folds(panel_p2(spark, sf), SEGMENT)


@register("baseline_forecast_years", sql=with_panels("""
SELECT c_mktsegment, fold, timestamp_hour, y, round(pred, 6) AS pred FROM bp""", ctes=_years_sql(_BASE_SQL), p=P2))
def q_baseline_forecast_years(spark, sf):
    b = _years_backtest(spark, sf)
    return b.select(*SEGMENT, "fold", TS, F.col("orders_count").alias("y"), F.round("pred", 6).alias("pred"))


@register("cv_summary_years", sql=with_panels("""
SELECT c_mktsegment, count(*) AS n_folds,
  round(avg(mae), 6) AS mae_mean, round(stddev_samp(mae), 6) AS mae_std,
  round(avg(rmse), 6) AS rmse_mean, round(stddev_samp(rmse), 6) AS rmse_std,
  round(avg(mape), 6) AS mape_mean, round(stddev_samp(mape), 6) AS mape_std
FROM m GROUP BY c_mktsegment""", ctes=_years_sql(_BASE_SQL + ",\n" + _METRICS_SQL.strip()), p=P2))
def q_cv_summary_years(spark, sf):
    s = FC.cv_summary(FC.forecast_metrics(_years_backtest(spark, sf), "orders_count", group=[*SEGMENT, "fold"]), group=SEGMENT)
    return s.select(*SEGMENT, "n_folds", *[F.round(c, 6).alias(c) for c in s.columns if c.endswith(("_mean", "_std"))])
