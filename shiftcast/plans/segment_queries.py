"""Registered queries for survey 2.G (segments, labels, KPIs)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftcast.operators import features as FT
from shiftcast.operators import rules as RULES
from shiftcast.operators import segments as S
from shiftcast.plans.sqlpanels import P1, P1K, with_panels
from shiftcast.registry import register
from shiftcast.sources.tables import panel_p1

K = ["event_type"]
TS = "timestamp_hour"


def _case(variant: str, h: str = "hour") -> str:
    segs, other = S.SEGMENT_VARIANTS[variant]
    parts = []
    for name, ranges in segs:
        cond = " OR ".join(f"{h} BETWEEN {lo} AND {hi}" for lo, hi in ranges)
        parts.append(f"WHEN {cond} THEN '{name}'")
    tail = f" ELSE '{other}'" if other is not None else ""
    return f"CASE {' '.join(parts)}{tail} END"


@register("segment_hours", sql=with_panels(f"""
SELECT timestamp_hour, hour,
  {_case('label')} AS seg_label, {_case('model')} AS seg_model,
  {_case('hour_shift')} AS seg_hour_shift, {_case('eda')} AS seg_eda, {_case('kpi')} AS seg_kpi
FROM (SELECT timestamp_hour, CAST(hour(timestamp_hour) AS INTEGER) AS hour FROM p)""", p=P1))
def q_segment_hours(spark, sf):
    p = panel_p1(spark, sf).select(TS, F.hour(TS).alias("hour"))
    return p.select(TS, "hour", *[S.segment("hour", v).alias(f"seg_{v}")
                                  for v in ("label", "model", "hour_shift", "eda", "kpi")])


_TOTALS_SQL = f"""
SELECT event_type, CAST(timestamp_hour AS DATE) AS date, shift, CAST(sum(orders_count) AS BIGINT) AS orders_count
FROM (SELECT *, {_case('label', 'hour(timestamp_hour)')} AS shift FROM p) s
WHERE shift <> 'none' GROUP BY 1, 2, 3"""


@register("shift_totals", sql=with_panels(_TOTALS_SQL, p=P1K))
def q_shift_totals(spark, sf):
    return S.shift_totals(panel_p1(spark, sf, keyed=True), "orders_count", K)


_THR_SQL = """
SELECT event_type, shift,
  round(quantile_cont(CAST(orders_count AS DOUBLE), 0.25), 6) AS q_quiet,
  round(quantile_cont(CAST(orders_count AS DOUBLE), 0.65), 6) AS q_normal,
  round(quantile_cont(CAST(orders_count AS DOUBLE), 0.88), 6) AS q_busy
FROM t GROUP BY 1, 2"""


@register("shift_thresholds", sql=with_panels(_THR_SQL, p=P1K, t=_TOTALS_SQL))
def q_shift_thresholds(spark, sf):
    thr = S.shift_thresholds(q_shift_totals(spark, sf), "orders_count", K)
    return thr.select(*K, "shift", *[F.round(c, 6).alias(c) for c in ("q_quiet", "q_normal", "q_busy")])


@register("shift_labels", sql=with_panels("""
SELECT t.event_type, t.date, t.shift, t.orders_count,
  CASE WHEN orders_count <= q_quiet THEN 'quiet' WHEN orders_count <= q_normal THEN 'normal'
       WHEN orders_count <= q_busy THEN 'busy' ELSE 'slammed' END AS label
FROM t JOIN (SELECT event_type, shift, quantile_cont(CAST(orders_count AS DOUBLE), 0.25) AS q_quiet,
                    quantile_cont(CAST(orders_count AS DOUBLE), 0.65) AS q_normal,
                    quantile_cont(CAST(orders_count AS DOUBLE), 0.88) AS q_busy FROM t GROUP BY 1, 2) q
  USING (event_type, shift)""", p=P1K, t=_TOTALS_SQL))
def q_shift_labels(spark, sf):
    tot = q_shift_totals(spark, sf)
    thr = S.shift_thresholds(tot, "orders_count", K)
    return S.shift_labels(tot, thr, "orders_count", K).select(*K, "date", "shift", "orders_count", "label")


# KPI input: a naive forecast (same hour last week, 0 when unknown) against actual history.
_KPI_FC_SQL = """
SELECT p.timestamp_hour, CAST(coalesce(q.orders_count, 0) AS DOUBLE) AS orders_fc,
       CAST(coalesce(q.food_tickets_count, 0) AS DOUBLE) AS tickets_fc, p.orders_count
FROM p LEFT JOIN p q ON q.timestamp_hour = p.timestamp_hour - INTERVAL 168 HOUR"""

_KPI_SQL = f"""
f AS (SELECT *, CAST(timestamp_hour AS DATE) AS date, CAST(hour(timestamp_hour) AS INTEGER) AS hour,
             {_case('kpi', 'hour(timestamp_hour)')} AS shift FROM fc),
fd AS (SELECT date, shift, CAST(floor(sum(orders_fc)) AS BIGINT) AS orders,
              CAST(floor(sum(tickets_fc)) AS BIGINT) AS tickets,
              arg_max(hour, (orders_fc, -epoch(timestamp_hour))) AS peak_hour, sum(orders_fc) AS raw
       FROM f WHERE shift IS NOT NULL GROUP BY 1, 2),
hd AS (SELECT date, shift, CAST(sum(orders_count) AS DOUBLE) AS tot FROM
         (SELECT *, {_case('kpi_history', 'hour(timestamp_hour)')} AS shift,
                 CAST(timestamp_hour AS DATE) AS date FROM p) WHERE shift IS NOT NULL GROUP BY 1, 2),
d AS (SELECT coalesce(fd.date, hd.date) AS date, coalesce(fd.shift, hd.shift) AS shift,
             fd.orders, fd.tickets, fd.peak_hour, fd.raw, hd.tot
      FROM fd FULL JOIN hd ON fd.date = hd.date AND fd.shift = hd.shift),
w AS (SELECT *,
        quantile_cont(tot, 0.25) OVER win AS a, quantile_cont(tot, 0.65) OVER win AS b,
        quantile_cont(tot, 0.88) OVER win AS c, count(tot) OVER win AS n
      FROM d WINDOW win AS (PARTITION BY shift ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT date, shift, orders, tickets, peak_hour,
        CASE WHEN raw <= (CASE WHEN n > 3 THEN a ELSE 20 END) THEN 'quiet'
             WHEN raw <= (CASE WHEN n > 3 THEN b ELSE 40 END) THEN 'normal'
             WHEN raw <= (CASE WHEN n > 3 THEN c ELSE 70 END) THEN 'busy' ELSE 'slammed' END AS label
      FROM w WHERE orders IS NOT NULL)"""


def _kpis(spark, sf):
    p = panel_p1(spark, sf)
    f = FT.clock_lags(p, "orders_count", (168,))
    f = FT.clock_lags(f, "food_tickets_count", (168,))
    f = f.withColumns({"orders_fc": F.coalesce(F.col("orders_count_lag_168h"), F.lit(0)).cast("double"),
                       "tickets_fc": F.coalesce(F.col("food_tickets_count_lag_168h"), F.lit(0)).cast("double")})
    return S.shift_kpis(f, p, "orders_fc", "tickets_fc", "orders_count")


@register("shift_kpis", sql=with_panels("""
SELECT k.*, CASE label WHEN 'quiet' THEN 'Normal prep' WHEN 'normal' THEN 'Standard prep'
                       WHEN 'busy' THEN 'Increase prep' ELSE 'Maximum prep' END AS prep FROM k""",
                                          ctes=_KPI_SQL, p=P1, fc=_KPI_FC_SQL))
def q_shift_kpis(spark, sf):
    return _kpis(spark, sf)


@register("day_pressure", sql=with_panels("""
SELECT date, CASE WHEN n_slammed > 0 THEN 'slammed' WHEN n_busy >= 2 THEN 'busy' WHEN n_busy = 1 THEN 'moderate'
                  ELSE 'normal' END AS pressure, n_slammed, n_busy
FROM (SELECT date, count(*) FILTER (WHERE label = 'slammed') AS n_slammed,
             count(*) FILTER (WHERE label = 'busy') AS n_busy FROM k GROUP BY date)""",
                                            ctes=_KPI_SQL, p=P1, fc=_KPI_FC_SQL))
def q_day_pressure(spark, sf):
    return S.day_pressure(_kpis(spark, sf))


def _map_sql(d: dict) -> str:
    return "MAP {" + ", ".join(f"{k}: {float(v)}" for k, v in d.items()) + "}"


_BASE_SQL = _map_sql(RULES.BASE_ORDERS)
_WD_SQL = _map_sql(RULES.WEEKDAY_MULT)


@register("ratio_label", sql=with_panels(f"""
SELECT timestamp_hour, orders_count,
  CASE WHEN r < 0.5 THEN 'quiet' WHEN r < 0.9 THEN 'normal' WHEN r < 1.4 THEN 'busy' ELSE 'slammed' END AS busy_label
FROM (SELECT *, orders_count / greatest(coalesce(({_BASE_SQL})[hour(timestamp_hour)], 10.0)
                                        * ({_WD_SQL})[isodow(timestamp_hour) - 1], 1.0) AS r FROM p)""", p=P1))
def q_ratio_label(spark, sf):
    return S.ratio_label(panel_p1(spark, sf)).select(TS, "orders_count", "busy_label")


@register("slot_percentile_label", sql=with_panels("""
SELECT p.timestamp_hour, p.orders_count,
  CASE WHEN orders_count <= a THEN 'quiet' WHEN orders_count <= b THEN 'normal'
       WHEN orders_count <= c THEN 'busy' ELSE 'slammed' END AS busy_label
FROM (SELECT *, hour(timestamp_hour) AS h, isodow(timestamp_hour) AS wd FROM p) p
JOIN (SELECT hour(timestamp_hour) AS h, isodow(timestamp_hour) AS wd,
             quantile_cont(CAST(orders_count AS DOUBLE), 0.25) AS a,
             quantile_cont(CAST(orders_count AS DOUBLE), 0.65) AS b,
             quantile_cont(CAST(orders_count AS DOUBLE), 0.88) AS c FROM p GROUP BY 1, 2) q USING (h, wd)""", p=P1))
def q_slot_percentile_label(spark, sf):
    return S.slot_percentile_label(panel_p1(spark, sf)).select(TS, "orders_count", "busy_label")
