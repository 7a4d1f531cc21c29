"""Seasonal-naive baseline, walk-forward evaluation and metrics (survey 2.H, SQL part).

Folds are a small table ``(keys…, fold, cutoff, test_end)``.  Rows meet it in a
range join whose output is aggregated straight away (partial aggregation in
the same stage), so the ``rows × folds`` replication is never materialised.
The model-fitting operators live in ``shiftcast.operators.models``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftcast.functions.timecols import weekday
from shiftcast.operators import segments as S

WEEK_US = 7 * 24 * 3600 * 1_000_000


def fold_cutoffs(panel: DataFrame, keys: Sequence[str] = (), ts: str = "timestamp_hour", n_splits: int = 8,
                 test_weeks: float = 4, min_train_weeks: float = 12, mode: str = "even") -> DataFrame:
    """Per key: ``n_splits`` cutoffs from t_min + min_train to t_max − test.

    ``even`` spaces them evenly (what the reference code does; tests may
    overlap or leave gaps); ``step`` advances by ``test_weeks`` (what its
    docstring says).  Each fold tests (cutoff, cutoff + test].
    """
    keys = list(keys)
    b = panel.groupBy(*keys).agg(F.min(ts).alias("_t0"), F.max(ts).alias("_t1"))
    first = F.timestamp_add("MICROSECOND", F.lit(int(min_train_weeks * WEEK_US)), F.col("_t0"))
    last = F.timestamp_add("MICROSECOND", F.lit(-int(test_weeks * WEEK_US)), F.col("_t1"))
    b = b.select(*keys, first.alias("_first"), last.alias("_last"))
    b = b.filter(F.col("_first") <= F.col("_last")).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    if mode == "step":
        off = F.col("fold").cast("long") * int(test_weeks * WEEK_US)
        b = b.filter(F.timestamp_add("MICROSECOND", off, F.col("_first")) <= F.col("_last"))
    else:
        span = F.timestamp_diff("MICROSECOND", F.col("_first"), F.col("_last"))
        off = (F.floor(F.col("fold") * span.cast("double") / max(n_splits - 1, 1)).cast("long")
               if n_splits > 1 else F.lit(0).cast("long"))
    cutoff = F.timestamp_add("MICROSECOND", off, F.col("_first"))
    return b.select(*keys, "fold", cutoff.alias("cutoff"),
                    F.timestamp_add("MICROSECOND", F.lit(int(test_weeks * WEEK_US)), cutoff).alias("test_end"))


def fold_rows(panel: DataFrame, cutoffs: DataFrame, role: str, keys: Sequence[str] = (),
              ts: str = "timestamp_hour", n_splits: int = 8) -> DataFrame:
    """Panel rows of each fold: ``train`` = ts ≤ cutoff, ``test`` = cutoff < ts ≤ test_end.

    Unkeyed: the cutoff table has ``n_splits`` rows (a proven bound) and is
    broadcast.  Keyed: an equi-join on the keys plus the range condition.
    """
    keys = list(keys)
    t = F.col(ts)
    cond = (t <= F.col("cutoff")) if role == "train" else ((t > F.col("cutoff")) & (t <= F.col("test_end")))
    if keys:
        c = cutoffs.select(*[F.col(k).alias(f"_c_{k}") for k in keys], "fold", "cutoff", "test_end")
        on = [panel[k] == c[f"_c_{k}"] for k in keys]
        j = panel.join(c, on + [cond])
        return j.drop(*[f"_c_{k}" for k in keys])
    return panel.join(F.broadcast(cutoffs), cond)


def walk_forward_folds(panel: DataFrame, keys: Sequence[str] = (), ts: str = "timestamp_hour", **kw) -> DataFrame:
    """(keys, fold, role, ts) for every train and test row of every fold."""
    cut = fold_cutoffs(panel, keys, ts, **kw)
    sel = [*keys, "fold", ts]
    tr = fold_rows(panel, cut, "train", keys, ts).select(*sel, F.lit("train").alias("role"))
    te = fold_rows(panel, cut, "test", keys, ts).select(*sel, F.lit("test").alias("role"))
    return tr.unionByName(te)


def slot_history(panel: DataFrame, value: str, keys: Sequence[str] = (), ts: str = "timestamp_hour",
                 n_last: int = 8, eligible: Column | None = None) -> DataFrame:
    """Running mean of the last ``n_last`` values of each (hour, weekday) slot."""
    keys = list(keys)
    p = panel if eligible is None else panel.filter(eligible)
    p = p.filter(F.col(value).isNotNull()).select(*keys, ts, value, F.hour(ts).alias("hour"),
                                                  weekday(ts).alias("weekday"))
    w = Window.partitionBy(*keys, "hour", "weekday").orderBy(ts).rowsBetween(-(n_last - 1), 0)
    return p.select(*keys, ts, "hour", "weekday", F.avg(F.col(value).cast("double")).over(w).alias("slot_mean"))


def baseline_fit(panel: DataFrame, value: str, cutoffs: DataFrame, keys: Sequence[str] = (),
                 ts: str = "timestamp_hour", n_last: int = 8, eligible: Column | None = None) -> DataFrame:
    """Per (keys, fold, hour, weekday): mean of the slot's last ``n_last`` training values."""
    keys = list(keys)
    hist = slot_history(panel, value, keys, ts, n_last, eligible)
    j = fold_rows(hist, cutoffs, "train", keys, ts)
    return j.groupBy(*keys, "fold", "hour", "weekday").agg(
        F.max_by("slot_mean", F.col(ts)).alias("slot_mean"))


def baseline_predict(test_rows: DataFrame, slots: DataFrame, lag_col: str | None,
                     keys: Sequence[str] = (), ts: str = "timestamp_hour", group: Sequence[str] = ("fold",),
                     out: str = "pred") -> DataFrame:
    """lag 168 h when present, else the slot mean, else 0; clipped at 0."""
    keys = list(keys)
    t = test_rows.withColumns({"hour": F.hour(ts), "weekday": weekday(ts)})
    j = t.join(slots, [*keys, *group, "hour", "weekday"], "left")
    lag = F.col(lag_col).cast("double") if lag_col and lag_col in test_rows.columns else F.lit(None)
    return j.withColumn(out, F.greatest(F.coalesce(lag, F.col("slot_mean"), F.lit(0.0)), F.lit(0.0))) \
        .drop("slot_mean")


def baseline_backtest(panel: DataFrame, value: str, keys: Sequence[str] = (), ts: str = "timestamp_hour",
                      lag_col: str | None = None, eligible: Column | None = None, **fold_kw) -> DataFrame:
    """Test rows of every fold with the baseline prediction ``pred``."""
    keys = list(keys)
    cut = fold_cutoffs(panel, keys, ts, **fold_kw)
    slots = baseline_fit(panel, value, cut, keys, ts, eligible=eligible)
    test = fold_rows(panel.filter(F.col(value).isNotNull()), cut, "test", keys, ts)
    return baseline_predict(test, slots, lag_col, keys, ts)


def forecast_metrics(preds: DataFrame, y: str, pred: str = "pred", group: Sequence[str] = ("fold",),
                     eps: float = 1.0) -> DataFrame:
    """MAE, RMSE and MAPE (only where y > eps) with predictions clipped at 0; rows without a prediction only count."""
    p = F.when(F.col(pred).isNotNull(), F.greatest(F.col(pred).cast("double"), F.lit(0.0)))
    yy = F.col(y).cast("double")
    err = p - yy
    return preds.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_test"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        (F.avg(F.when(yy > eps, F.abs(err / yy))) * 100).alias("mape"))


def fold_shift_accuracy(panel: DataFrame, preds: DataFrame, value: str, pred: str = "pred",
                        keys: Sequence[str] = (), ts: str = "timestamp_hour",
                        cutoffs: DataFrame | None = None, eligible: Column | None = None) -> DataFrame:
    """Per fold: shift-label accuracy of predicted vs actual test shift totals,
    thresholds from the fold's training shift totals."""
    keys = list(keys)
    train = fold_rows(panel if eligible is None else panel.filter(eligible), cutoffs, "train", keys, ts)
    tr_tot = S.shift_totals(train, value, [*keys, "fold"], ts)
    thr = S.shift_thresholds(tr_tot, value, [*keys, "fold"])
    act = S.shift_totals(preds, value, [*keys, "fold"], ts)
    prd = S.shift_totals(preds, pred, [*keys, "fold"], ts)
    return S.shift_label_accuracy(act, prd, thr, value, pred, [*keys, "fold"])


def cv_summary(fold_metrics: DataFrame, metrics: Sequence[str] = ("mae", "rmse", "mape", "shift_accuracy"),
               group: Sequence[str] = ()) -> DataFrame:
    aggs = []
    for m in metrics:
        if m in fold_metrics.columns:
            aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std")]
    return fold_metrics.groupBy(*group).agg(F.count(F.lit(1)).alias("n_folds"), *aggs)


def improvement_pct(base_mae, model_mae) -> Column:
    return (F.col(base_mae) - F.col(model_mae)) / F.col(base_mae) * 100


def val_split(rows: DataFrame, group: Sequence[str] = ("fold",), ts: str = "timestamp_hour",
              share: float = 0.2, minimum: int = 200, out: str = "is_val") -> DataFrame:
    """Flag the last max(int(n × share), minimum) rows of each group (time order).

    A group no larger than its tail is flagged whole; :func:`unfit_folds` names
    those.  Rows of one time are ordered arbitrarily, as the size is what counts.
    """
    w_all = Window.partitionBy(*group)
    w_ord = Window.partitionBy(*group).orderBy(F.col(ts).desc())
    size = F.greatest(F.floor(F.count(F.lit(1)).over(w_all) * share).cast("long"), F.lit(minimum))
    return rows.withColumn(out, F.row_number().over(w_ord) <= size)


def val_split_cut(rows: DataFrame, group: Sequence[str] = ("fold",), ts: str = "timestamp_hour",
                  share: float = 0.2, minimum: int = 200, out: str = "is_val") -> DataFrame:
    """The same tail as whole time steps, without sorting a group's rows.

    Rows are counted per (group, time) with map-side combining; the running
    count over those times (bounded by the calendar) gives the first time of the
    tail, which then holds at least the wanted number of rows.
    """
    group = list(group)
    per = rows.groupBy(*group, ts).agg(F.count(F.lit(1)).alias("_n"))
    total = Window.partitionBy(*group)
    after = total.orderBy(F.col(ts).desc()).rowsBetween(Window.unboundedPreceding, -1)
    size = F.greatest(F.floor(F.sum("_n").over(total) * share).cast("long"), F.lit(minimum))
    flags = per.select(*group, ts, (F.coalesce(F.sum("_n").over(after), F.lit(0)) < size).alias("_in"))
    cut = flags.groupBy(*group).agg(F.min(F.when(F.col("_in"), F.col(ts))).alias("_cut"))
    return rows.join(cut, group).withColumn(out, F.col(ts) >= F.col("_cut")).drop("_cut")


def unfit_folds(rows: DataFrame, group: Sequence[str] = ("fold",), flag: str = "is_val") -> DataFrame:
    """Groups whose rows are all in the validation tail, with their number of rows."""
    return (rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col(flag)).alias("_fit"))
            .filter(F.col("_fit") == 0).select(*group, "n_rows", F.lit("no training rows besides the validation tail").alias("reason")))


def oos_residuals(preds: DataFrame, y: str, pred: str = "pred", keys: Sequence[str] = (),
                  ts: str = "timestamp_hour") -> DataFrame:
    return preds.select(*keys, ts, F.col(y).alias("y"), F.col(pred).alias("pred"), "fold",
                        (F.col(pred) - F.col(y)).alias("residual"))


def next_day_stub(history: DataFrame, keys: Sequence[str] = (), ts: str = "timestamp_hour",
                  carry: Sequence[str] = (), targets: Sequence[str] = ("orders_count", "food_tickets_count"),
                  hours: Sequence[int] = tuple(range(9, 24)) + (0, 1)) -> DataFrame:
    """17 stub rows for the day after each key's last timestamp, carrying the
    last known value of ``carry`` columns and NULL targets."""
    keys = list(keys)
    last = history.groupBy(*keys).agg(
        F.max(ts).alias("_last"),
        *[F.max_by(c, F.col(ts)).alias(c) for c in carry])
    day = F.date_add(F.to_date("_last"), 1).cast("timestamp_ntz")
    stub = last.withColumn("_h", F.explode(F.array(*[F.lit(h) for h in hours])))
    stub = stub.withColumn(ts, F.timestamp_add("HOUR", F.col("_h"), day))
    out = stub.select(*keys, ts, *[F.lit(None).cast(dict(history.dtypes).get(t, "double")).alias(t)
                                   for t in targets if t in history.columns], *carry)
    return out


def next_day_baseline(history: DataFrame, value: str, keys: Sequence[str] = (), ts: str = "timestamp_hour",
                      n_last: int = 8) -> DataFrame:
    """Append the next day's stub, rebuild the 168 h lag, predict with the
    baseline fitted on all history, attach the label shift."""
    from shiftcast.operators.features import clock_lags

    keys = list(keys)
    hist = history.select(*keys, ts, value)
    stub = next_day_stub(hist, keys, ts, targets=[value])
    both = hist.unionByName(stub)
    feats = clock_lags(both, value, (168,), keys, ts)
    lag = f"{value}_lag_168h"
    # slot means over the full history: the last n values of each slot
    sh = slot_history(hist, value, keys, ts, n_last)
    slots = sh.groupBy(*keys, "hour", "weekday").agg(F.max_by("slot_mean", F.col(ts)).alias("slot_mean"))
    target_rows = feats.join(stub.select(*keys, ts), [*keys, ts], "left_semi")
    pred = baseline_predict(target_rows, slots, lag, keys, ts, group=(), out="baseline_pred")
    return pred.select(*keys, ts, "baseline_pred", S.segment(F.hour(ts), "label").alias("shift"))


def asymmetric_loss(preds: DataFrame, y: str, pred: str = "pred", group: Sequence[str] = ("fold",),
                    under_weight: float = 2.0) -> DataFrame:
    """Mean asymmetric squared loss (under-prediction × ``under_weight``) and
    the share of under-predicted rows."""
    r = F.col(y).cast("double") - F.col(pred).cast("double")
    loss = F.when(r > 0, under_weight * r * r).otherwise(r * r)
    return preds.groupBy(*group).agg(F.avg(loss).alias("asym_loss"),
                                     F.avg((r > 0).cast("double")).alias("under_share"))


def val_split_by_time(rows: DataFrame, ts: str = "timestamp_hour", share: float = 0.10, minimum: int = 200,
                      out: str = "is_val") -> DataFrame:
    """Flag roughly the last max(n × share, minimum) rows by time without a
    global sort: the cut is an approximate time quantile (one small action)."""
    epoch = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts))
    n = rows.count()
    if n == 0:
        return rows.withColumn(out, F.lit(False))
    frac = max(share, minimum / n)
    if frac >= 1:
        raise ValueError(f"{n} rows leave nothing to fit besides a validation tail of {minimum}")
    cut = rows.agg(F.percentile_approx(epoch, 1 - frac, 100000)).first()[0]
    return rows.withColumn(out, epoch > F.lit(cut))
