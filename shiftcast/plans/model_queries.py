"""Registered model queries (survey H2–H4, H10–H12, H15)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shiftcast.operators import availability as AV
from shiftcast.operators import boosting as B
from shiftcast.operators import calendars as C
from shiftcast.operators import features as FT
from shiftcast.operators import forecast as FC
from shiftcast.operators import models as M
from shiftcast.operators import serving as SV
from shiftcast.plans.backtest import fold_predictions, fold_summary, model_fold_predictions, run_summary, training_rows
from shiftcast.plans.feature_table import build_feature_table
from shiftcast.plans.sqlpanels import P2, with_panels
from shiftcast.registry import register
from shiftcast.session import cut_lineage
from shiftcast.sources import standins as ST
from shiftcast.sources.tables import panel_p1, panel_p2

TS = "timestamp_hour"
TARGET = "orders_count"
SEGMENT = ["c_mktsegment"]


def p1_model_table(spark, sf, drop_na: bool = True):
    """The hourly panel's feature table with weather and footfall stand-ins,
    checkpointed: model loops reuse it many times, so its lineage is cut once."""
    h = ST.events_hourly(spark, sf)
    wx = h.select(TS, "temp_c", (F.col("footfall_clicks") / 2.0).alias("rain_mm"))
    ff = FT.clock_lags(h.select(TS, (F.col("footfall_views") * 300).alias("suffolk_nassau_footfall"), "footfall_views"),
                       "footfall_views", (24,)).withColumnRenamed("footfall_views_lag_24h", "suffolk_footfall_lag_24h")
    return cut_lineage(build_feature_table(panel_p1(spark, sf), footfall=ff.drop("footfall_views"), weather=wx, drop_na=drop_na))


def p2_model_table(spark, sf):
    """The daily panel of each market segment (six years) with its features, checkpointed."""
    return cut_lineage(build_feature_table(panel_p2(spark, sf), keys=SEGMENT, drop_na=False))


def _features(df):
    return AV.feature_cols(df.columns, AV.SAFE_FOR_NEXT_DAY)


def _tail(df):
    return FC.val_split_by_time(df, share=0.10, minimum=20)


@register("gbt_forecast")
def q_gbt_forecast(spark, sf):
    ft = p2_model_table(spark, sf)
    preds = model_fold_predictions(ft, TARGET, _features(ft), SEGMENT)
    return preds.select("fold", *SEGMENT, TS, F.col(TARGET).alias("y"), "pred")


@register("asym_boost")
def q_asym_boost(spark, sf):
    ft = p2_model_table(spark, sf)
    preds = model_fold_predictions(ft, TARGET, _features(ft), SEGMENT, asymmetric=True)
    return FC.asymmetric_loss(preds, TARGET, group=["fold"]).join(
        FC.forecast_metrics(preds, TARGET, group=["fold"]), "fold")


# Borders of the bins of three calendar features, as whole numbers.
_ROOT_EDGES = {"weekday": range(0, 6), "month": range(1, 12), "week_of_year": range(1, 53)}


def _root_sql() -> str:
    bins = "\n  UNION ALL ".join(f"SELECT fold, {i} AS f, '{c}' AS feature, least(greatest({c}, {min(e)}), {max(e) + 1}) AS x, g, h FROM r"
                               for i, (c, e) in enumerate(_ROOT_EDGES.items()))

    def term(g, h):
        return f"power(greatest(abs({g}) - 0.1::DOUBLE, 0), 2) / ({h} + 1.0::DOUBLE)"

    return with_panels(f"""
SELECT fold, feature, threshold, round(gain, 3) AS gain, g, h, gl, hl FROM (
  SELECT *, row_number() OVER (PARTITION BY fold ORDER BY gain DESC, f, threshold) AS rn FROM (
    SELECT fold, f, feature, CAST(x AS DOUBLE) AS threshold, g, h, gl, hl,
           {term('gl', 'hl')} + {term('(g - gl)', '(h - hl)')} - {term('g', 'h')} AS gain
    FROM s WHERE hl >= 5 AND h - hl >= 5)
  WHERE gain > 1e-6) WHERE rn = 1""", ctes=f"""
cut AS (SELECT c_mktsegment, CAST(i AS INTEGER) AS fold,
          make_timestamp(epoch_us(first) + CAST(floor(i * CAST(epoch_us(last) - epoch_us(first) AS DOUBLE) / 7) AS BIGINT)) AS cutoff
        FROM (SELECT c_mktsegment, min(timestamp_hour) + INTERVAL 84 DAY AS first, max(timestamp_hour) - INTERVAL 28 DAY AS last
              FROM p GROUP BY 1) b, range(0, 8) t(i) WHERE first <= last),
tr AS (SELECT c.fold, p.timestamp_hour, CAST(p.orders_count AS DOUBLE) AS y FROM p JOIN cut c ON c.c_mktsegment = p.c_mktsegment AND p.timestamp_hour <= c.cutoff),
per AS (SELECT fold, timestamp_hour, count(*) AS n FROM tr GROUP BY 1, 2),
v AS (SELECT fold, timestamp_hour,
        coalesce(sum(n) OVER (PARTITION BY fold ORDER BY timestamp_hour DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
          < greatest(floor(sum(n) OVER (PARTITION BY fold) * 0.2), 200) AS val FROM per),
c2 AS (SELECT fold, min(timestamp_hour) FILTER (WHERE val) AS cut FROM v GROUP BY 1),
r AS (SELECT 'all/' || tr.fold AS fold, isodow(timestamp_hour) - 1 AS weekday, month(timestamp_hour) AS month, weekofyear(timestamp_hour) AS week_of_year,
        CASE WHEN 0.5 - y < 0 THEN 4 * (0.5 - y) ELSE 2 * (0.5 - y) END AS g, CASE WHEN 0.5 - y < 0 THEN 4.0::DOUBLE ELSE 2.0::DOUBLE END AS h
      FROM tr JOIN c2 ON c2.fold = tr.fold WHERE tr.timestamp_hour < c2.cut),
b AS ({bins}),
a AS (SELECT fold, f, feature, x, sum(g) AS g, sum(h) AS h FROM b GROUP BY ALL),
s AS (SELECT fold, f, feature, x, sum(g) OVER w AS g, sum(h) OVER w AS h, sum(g) OVER o AS gl, sum(h) OVER o AS hl
      FROM a WINDOW w AS (PARTITION BY fold, f), o AS (PARTITION BY fold, f ORDER BY x ROWS UNBOUNDED PRECEDING))""", p=P2)


@register("boost_root_split", sql=_root_sql())
def q_boost_root_split(spark, sf):
    """First split of each fold's asymmetric booster by the grouped sums, all folds in one pass; a fold where no split gains has no row."""
    rows = training_rows(C.add_time_parts(panel_p2(spark, sf), TS), TARGET, {"all": list(_ROOT_EDGES)}, SEGMENT).where("role = 0")
    out = B.root_splits(rows, list(_ROOT_EDGES), TARGET, [[float(x) for x in e] for e in _ROOT_EDGES.values()])
    return out.where("feature is not null").select(F.col("model").alias("fold"), "feature", "threshold", F.round("gain", 3).alias("gain"), "g", "h", "gl", "hl")


@register("segment_routed_forecast")
def q_segment_routed_forecast(spark, sf):
    """Last week of the hourly panel, by models of its earlier weeks."""
    ft = p1_model_table(spark, sf, drop_na=False)
    feats = _features(ft)
    cut = FC.fold_cutoffs(ft, n_splits=1, test_weeks=1, min_train_weeks=1)
    train = FC.fold_rows(ft, cut, "train")
    test = FC.fold_rows(ft, cut, "test")
    forest = M.fit_segment_models(cut_lineage(_tail(train)), feats, TARGET, val_col="is_val")
    return M.predict_routed(test, forest).select(TS, F.col(TARGET).alias("y"), "pred", "model_used")


@register("feature_importance")
def q_feature_importance(spark, sf):
    ft = p1_model_table(spark, sf)
    fi = M.feature_importance(M.fit_gbt(_tail(ft), _features(ft), TARGET, val_col="is_val"))
    labels = F.create_map(*[x for k, v in SV.HUMAN_LABELS.items() for x in (F.lit(k), F.lit(v))])
    return fi.withColumn("label", F.coalesce(labels[F.col("feature")],
                                             F.initcap(F.regexp_replace("feature", "_", " "))))


@register("param_search")
def q_param_search(spark, sf):
    ft = p1_model_table(spark, sf, drop_na=False)
    return M.param_search(ft, _features(ft), TARGET)


@register("segment_mae")
def q_segment_mae(spark, sf):
    ft = p1_model_table(spark, sf, drop_na=False)
    forest = M.fit_segment_models(cut_lineage(_tail(ft)), _features(ft), TARGET, val_col="is_val")
    return M.segment_mae(ft, forest, TARGET)


@register("ablation")
def q_ablation(spark, sf):
    ft = p2_model_table(spark, sf)
    lagged = FT.clock_lags(ft.drop(f"{TARGET}_lag_168h"), TARGET, (168,), SEGMENT)
    base = FC.baseline_backtest(lagged, TARGET, keys=SEGMENT, lag_col=f"{TARGET}_lag_168h")
    sets = {name: AV.feature_cols(ft.columns, cols) for name, cols in AV.ABLATION_GROUPS.items()}
    preds = cut_lineage(fold_predictions(ft, TARGET, sets, SEGMENT))
    sizes = F.create_map(*[x for name, cols in sets.items() for x in (F.lit(name), F.lit(len(cols)))])

    def mean(df):
        return df.agg(F.avg("mae").alias("MAE"), F.avg("shift_accuracy").alias("Shift Accuracy"))

    first = mean(fold_summary(ft, base, TARGET, SEGMENT)).select(F.lit("A0: Baseline (Last Week)").alias("Run"), F.lit(0).alias("Features"), "MAE", "Shift Accuracy")
    runs = mean(run_summary(ft, preds, TARGET, list(sets), SEGMENT).groupBy("run"))
    return first.unionByName(runs.select(F.col("run").alias("Run"), sizes[F.col("run")].alias("Features"), "MAE", "Shift Accuracy"))


@register("cv_compare")
def q_cv_compare(spark, sf):
    """H8 with both models: fold metrics summarised per model (mean ± std)
    and the tree model's MAE improvement over the baseline in percent."""
    ft = p2_model_table(spark, sf)
    lagged = FT.clock_lags(ft.drop(f"{TARGET}_lag_168h"), TARGET, (168,), SEGMENT)
    base = FC.baseline_backtest(lagged, TARGET, keys=SEGMENT, lag_col=f"{TARGET}_lag_168h")
    tree = model_fold_predictions(ft, TARGET, _features(ft), SEGMENT)
    b = fold_summary(ft, base, TARGET, SEGMENT).withColumn("model", F.lit("baseline"))
    x = fold_summary(ft, tree, TARGET, SEGMENT).withColumn("model", F.lit("gbt"))
    summ = FC.cv_summary(b.unionByName(x), group=["model"])  # one row per model
    base_mae = F.max(F.when(F.col("model") == "baseline", F.col("mae_mean"))).over(Window.partitionBy(F.lit(0)))
    return summ.withColumn("_b", base_mae) \
        .withColumn("mae_improvement_pct", FC.improvement_pct("_b", "mae_mean")).drop("_b")
