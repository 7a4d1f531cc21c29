"""Flagship job: raw events → hourly panel → clock lags → seasonal-naive
walk-forward forecast → shift totals → busy labels (actual vs predicted)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftcast.operators import features as FT
from shiftcast.operators import forecast as FC
from shiftcast.operators import segments as S
from shiftcast.sources.tables import panel_p1

FOLDS = dict(n_splits=4, test_weeks=1, min_train_weeks=1)


def flagship(spark: SparkSession, sf_dir: str, value: str = "orders_count") -> DataFrame:
    panel = FT.clock_lags(panel_p1(spark, sf_dir), value, (168,))
    cut = FC.fold_cutoffs(panel, **FOLDS)
    slots = FC.baseline_fit(panel, value, cut)
    test = FC.fold_rows(panel, cut, "test")
    preds = FC.baseline_predict(test, slots, f"{value}_lag_168h")
    train = FC.fold_rows(panel, cut, "train")
    thr = S.shift_thresholds(S.shift_totals(train, value, ["fold"]), value, ["fold"])
    act = S.shift_totals(preds, value, ["fold"])
    prd = S.shift_totals(preds, "pred", ["fold"], out="pred_total")
    j = S.with_default_thresholds(act.join(prd, ["fold", "date", "shift"]).join(thr, ["fold", "shift"], "left"))
    return j.select(
        "fold", "date", "shift", F.col(value).alias("actual_total"),
        F.round("pred_total", 4).alias("pred_total"),
        S.label_from_thresholds(value, "q_quiet", "q_normal", "q_busy").alias("actual_label"),
        S.label_from_thresholds("pred_total", "q_quiet", "q_normal", "q_busy").alias("pred_label"))
