"""Walk-forward evaluation of the baseline and a tree model (survey 3.2).

Per fold: training rows (≤ cutoff, labelled) with the last max(20 %, 200) rows flagged for
validation, a model fit, test predictions, MAE/RMSE/MAPE and shift-label accuracy.  Baseline
and metrics for all folds run as one Spark plan; the folds' models (and those of several
feature sets) are grown side by side in one job.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftcast.operators import boosting as B
from shiftcast.operators import forecast as FC
from shiftcast.operators import models as M
from shiftcast.operators import segments as S

log = logging.getLogger(__name__)

TRAIN, VALIDATION, TEST = 0, 1, 2


def training_rows(panel: DataFrame, target: str, runs: Mapping[str, Sequence[str]], keys: Sequence[str] = (), ts: str = "timestamp_hour",
                  **fold_kw) -> DataFrame:
    """(model, run, fold, role, keys, ts, target, features): the training, validation and test rows of every run and fold.

    Training rows with a null feature of their run are left out, as the reference does."""
    keys = list(keys)
    lab = panel.filter(F.col(target).isNotNull())
    cut = FC.fold_cutoffs(lab, keys, ts, **fold_kw)
    features = sorted({c for f in runs.values() for c in f})
    narrow = lab.select(*dict.fromkeys([*keys, ts, target, *features]))

    def whole(names: Sequence[str]):
        ok = F.lit(True)
        for c in names:
            ok = ok & F.col(c).isNotNull()
        return ok

    train = FC.fold_rows(narrow, cut, "train", keys, ts)
    train = train.withColumn("run", F.explode(F.array_compact(F.array(*[F.when(whole(f), F.lit(name)) for name, f in runs.items()]))))
    train = FC.val_split_cut(train, group=["run", "fold"], ts=ts).withColumn("role", F.col("is_val").cast("int"))
    test = FC.fold_rows(narrow, cut, "test", keys, ts).withColumn("run", F.explode(F.array(*[F.lit(name) for name in runs])))
    names = [*dict.fromkeys(["run", "fold", "role", *keys, ts, target, *features])]
    rows = train.select(*names).unionByName(test.withColumn("role", F.lit(TEST)).select(*names))
    return rows.withColumn("model", F.concat_ws("/", "run", "fold"))


def fold_predictions(panel: DataFrame, target: str, runs: Mapping[str, Sequence[str]], keys: Sequence[str] = (), ts: str = "timestamp_hour",
                     params: B.Params = B.Params(), **fold_kw) -> DataFrame:
    """(run, fold, keys, ts, target, pred) of every run's test rows; a run has features of its own.

    With keys all keys share a fold's model; the folds' cutoffs are per key.  A fold that has no
    training row besides its validation tail is not fitted: its test rows have a null
    prediction, and the log names it.
    """
    keys = list(keys)
    rows = training_rows(panel, target, runs, keys, ts, **fold_kw)
    counts = rows.groupBy("model", "run").agg(F.count_if(F.col("role") == TRAIN).alias("n")).collect()
    empty = sorted(r["model"] for r in counts if not r["n"])
    if empty:
        log.warning("folds without training rows besides the validation tail: %s", empty)
    sets = {r["model"]: list(runs[r["run"]]) for r in counts}
    features = sorted({c for f in runs.values() for c in f})
    return B.fit_predict(rows, features, target, [*dict.fromkeys(["run", "fold", *keys, ts, target])], "model", params,
                         F.col("role"), M.row_id(keys, ts), sets).drop("model")


def model_fold_predictions(panel: DataFrame, target: str, features: Sequence[str], keys: Sequence[str] = (),
                           ts: str = "timestamp_hour", params: Mapping | None = None, asymmetric: bool = False, **fold_kw) -> DataFrame:
    """Test rows of every fold with the model prediction ``pred``; ``params`` replaces arguments of the booster."""
    own = replace(B.ASYMMETRIC if asymmetric else B.Params(), **(params or {}))
    return fold_predictions(panel, target, {"all": list(features)}, keys, ts, own, **fold_kw).drop("run")


def fold_summary(panel: DataFrame, preds: DataFrame, target: str, keys: Sequence[str] = (),
                 ts: str = "timestamp_hour", **fold_kw) -> DataFrame:
    """Per fold: n_test, MAE, RMSE, MAPE and shift accuracy."""
    keys = list(keys)
    cut = FC.fold_cutoffs(panel.filter(F.col(target).isNotNull()), keys, ts, **fold_kw)
    m = FC.forecast_metrics(preds, target, group=[*keys, "fold"])
    acc = FC.fold_shift_accuracy(panel, preds, target, "pred", keys, ts, cutoffs=cut)
    return m.join(acc.select(*keys, "fold", "shift_accuracy"), [*keys, "fold"], "left")


def run_summary(panel: DataFrame, preds: DataFrame, target: str, runs: Sequence[str], keys: Sequence[str] = (),
                ts: str = "timestamp_hour", **fold_kw) -> DataFrame:
    """:func:`fold_summary` of several ``runs`` at once: per run and fold n_test, MAE, RMSE, MAPE and shift accuracy."""
    keys = list(keys)
    cut = FC.fold_cutoffs(panel.filter(F.col(target).isNotNull()), keys, ts, **fold_kw)
    m = FC.forecast_metrics(preds, target, group=["run", *keys, "fold"])
    group = [*keys, "fold"]
    thr = S.shift_thresholds(S.shift_totals(FC.fold_rows(panel, cut, "train", keys, ts), target, group, ts), target, group)
    act = S.shift_totals(preds, target, ["run", *group], ts)
    prd = S.shift_totals(preds, "pred", ["run", *group], ts)
    of_run = thr.withColumn("run", F.explode(F.array(*[F.lit(r) for r in runs])))  # thresholds are the same for every run
    acc = S.shift_label_accuracy(act, prd, of_run, target, "pred", ["run", *group])
    return m.join(acc.select("run", *group, "shift_accuracy"), ["run", *group], "left")
