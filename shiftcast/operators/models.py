"""Boosted-tree forecasting (survey 2.H, model part).

All fits go through :mod:`shiftcast.operators.boosting`: folds, segments and trials are
models of one table and grow in the same job.  ``tune_segments`` searches the arguments of
every segment's booster by :mod:`shiftcast.operators.tpe`, a batch of trials of all segments
and folds at a time, and refits the winners on all rows; a forest of one global model and
the segments' routes rows to their model.
"""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftcast.operators import boosting as B
from shiftcast.operators import segments as S
from shiftcast.operators import tpe
from shiftcast.session import cut_lineage

GLOBAL = "global"
# Search space of the per-segment tuner.
SEARCH_SPACE = {"max_depth": tpe.Range(3, 8, whole=True), "learning_rate": tpe.Range(0.01, 0.3, log=True),
                "n_estimators": tpe.Range(100, 800, whole=True), "min_child_weight": tpe.Range(1, 10, whole=True),
                "subsample": tpe.Range(0.5, 1.0), "colsample_bytree": tpe.Range(0.5, 1.0),
                "reg_alpha": tpe.Range(0.0, 3.0), "reg_lambda": tpe.Range(0.0, 3.0)}
# Least rows of a search, of a fold's training part and of its test part.
LEAST_ROWS, LEAST_TRAIN, LEAST_TEST = 80, 30, 10


def row_id(keys: Sequence[str] = (), ts: str = "timestamp_hour") -> Column:
    """Id of a panel row; decides which trees sample it."""
    return F.xxhash64(*keys, F.col(ts).cast("string"))


def _role(val_col: str | None) -> Column:
    return F.coalesce(F.col(val_col).cast("int"), F.lit(0)) if val_col else F.lit(0)


def fit_gbt(train: DataFrame, features: Sequence[str], label: str, params: Mapping | None = None, val_col: str | None = None,
            keys: Sequence[str] = (), ts: str = "timestamp_hour") -> B.Forest:
    """One booster of the squared error on all rows; ``params`` replaces arguments of :class:`boosting.Params`."""
    rows = train.withColumn("_of", F.lit(GLOBAL))
    return B.fit_models(rows, features, label, "_of", replace(B.Params(), **(params or {})), _role(val_col), row_id(keys, ts))


def fit_asym_boost(train: DataFrame, features: Sequence[str], label: str, val_col: str | None = None, keys: Sequence[str] = (),
                   ts: str = "timestamp_hour", **params) -> B.Forest:
    """One booster of the asymmetric squared error: under-predictions weigh twice."""
    rows = train.withColumn("_of", F.lit(GLOBAL))
    return B.fit_models(rows, features, label, "_of", replace(B.ASYMMETRIC, **params), _role(val_col), row_id(keys, ts))


def predict(forest: B.Forest, df: DataFrame, out: str = "pred", model: str = GLOBAL) -> DataFrame:
    """``df`` with the prediction of one model, clipped at 0."""
    return forest.predict(df, F.lit(model), out)


def segment_counts(df: DataFrame, label: str, ts: str = "timestamp_hour", variant: str = "model") -> dict[str, int]:
    seg = S.segment(F.hour(ts), variant)
    rows = df.filter(F.col(label).isNotNull()).groupBy(seg.alias("_s")).agg(F.count(F.lit(1)).alias("n")).collect()
    return {r["_s"]: r["n"] for r in rows if r["_s"] is not None}


def fit_segment_models(df: DataFrame, features: Sequence[str], label: str, ts: str = "timestamp_hour", variant: str = "model",
                       min_rows: int = LEAST_ROWS, params: Mapping[str, Mapping] | None = None, val_col: str | None = None,
                       keys: Sequence[str] = ()) -> B.Forest:
    """The global booster and one asymmetric booster for each segment with at least ``min_rows`` labelled rows, in one job.

    ``params`` replaces arguments by model name (a segment's or ``global``).
    """
    names = sorted(s for s, n in segment_counts(df, label, ts, variant).items() if n >= min_rows)
    seg = S.segment(F.hour(ts), variant)
    of = F.array_compact(F.array(F.lit(GLOBAL), F.when(seg.isin(names), seg)))
    own = {GLOBAL: replace(B.Params(), **(params or {}).get(GLOBAL, {}))}
    own |= {s: replace(B.ASYMMETRIC, **(params or {}).get(s, {})) for s in names}
    return B.fit_models(df.withColumn("_of", F.explode(of)), features, label, "_of", own, _role(val_col), row_id(keys, ts))


def route(forest: B.Forest, ts: str = "timestamp_hour", variant: str = "model") -> Column:
    """Name of the model that scores a row: its segment's, or the global one."""
    seg = S.segment(F.hour(ts), variant)
    return F.when(seg.isin([m for m in forest.models() if m != GLOBAL]), seg).otherwise(F.lit(GLOBAL))


def predict_routed(df: DataFrame, forest: B.Forest, ts: str = "timestamp_hour", variant: str = "model", out: str = "pred") -> DataFrame:
    """Each row scored by its segment's model, rows of other hours by the global model; all in one pass."""
    return forest.predict(df.withColumn("model_used", route(forest, ts, variant)), F.col("model_used"), out)


def segment_mae(df: DataFrame, forest: B.Forest, label: str, ts: str = "timestamp_hour", variant: str = "model") -> DataFrame:
    """In-sample MAE per segment: global model (before) vs segment model (after)."""
    lab = df.filter(F.col(label).isNotNull())
    both = predict_routed(predict(forest, lab, "_before"), forest, ts, variant, "_after")
    return (both.filter(F.col("model_used") != GLOBAL).groupBy(F.col("model_used").alias("segment"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("_before") - F.col(label))).alias("mae_before"),
                 F.avg(F.abs(F.col("_after") - F.col(label))).alias("mae_after")))


def feature_importance(forest: B.Forest, model: str = GLOBAL) -> DataFrame:
    """(feature, importance, importance_pct): mean gain of a feature's splits, largest first."""
    return forest.importance(model)


# ---------------------------------------------------------------- search

def time_quarters(df: DataFrame, group: Sequence[str], ts: str = "timestamp_hour", out: str = "quarter") -> DataFrame:
    """Each row's quarter (0 to 3) of its group's rows in time order; rows of one time share one.

    Rows are counted by time with map-side combining, and only these counts (bounded by the
    calendar) are summed in order."""
    group = list(group)
    per = df.groupBy(*group, ts).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_n").over(whole.orderBy(ts).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(whole)
    passed = sum(((before >= F.floor(total * k / 4)).cast("int") for k in (1, 2, 3)), F.lit(0))
    return df.join(per.select(*group, ts, passed.alias(out)), [*group, ts])


def expanding_folds(df: DataFrame, group: Sequence[str], ts: str = "timestamp_hour") -> DataFrame:
    """Rows of three folds: the first (fold + 1) quarters train (role 0), the next one tests (role 2)."""
    q = F.col("_quarter")
    parts = [F.struct(F.lit(f).alias("fold"), F.when(q <= f, 0).when(q == f + 1, 2).alias("role")) for f in range(3)]
    rows = time_quarters(df, group, ts, "_quarter").withColumn("_part", F.explode(F.array(*parts)))
    return rows.withColumn("fold", F.col("_part.fold")).withColumn("role", F.col("_part.role")).filter(F.col("role").isNotNull()).drop("_part", "_quarter")


def boost_params(p: Mapping, seed: int = 42) -> B.Params:
    """A trial of the search as a booster's arguments."""
    return replace(B.ASYMMETRIC, seed=seed, max_depth=int(p["max_depth"]), learning_rate=float(p["learning_rate"]),
                   n_estimators=int(p["n_estimators"]), min_child_weight=float(p["min_child_weight"]), subsample=float(p["subsample"]),
                   colsample_bytree=float(p["colsample_bytree"]), reg_alpha=float(p["reg_alpha"]), reg_lambda=float(p["reg_lambda"]))


def search(df: DataFrame, features: Sequence[str], label: str, segment: Column, n_trials: int = 50, ts: str = "timestamp_hour",
           seed: int = 42, batch: int = 8, keys: Sequence[str] = ()) -> dict[str, list[tuple[dict, float, int]]]:
    """Trials (arguments, mean MAE over the folds, number of folds) of every segment, in the order they were made.

    Every batch fits the trials of all segments on all their folds in one job; proposals of a batch
    know the batches before.  Segments of fewer than ``LEAST_ROWS`` rows score infinity, folds
    with too few rows are left out.
    """
    spark = df.sparkSession
    data = df.filter(F.col(label).isNotNull()).withColumn("segment", segment).filter(F.col("segment").isNotNull())
    folds = cut_lineage(expanding_folds(data, ["segment"], ts))
    sizes = folds.groupBy("segment", "fold").agg(F.count_if(F.col("role") == 0).alias("train"), F.count_if(F.col("role") == 2).alias("test")).collect()
    whole = {r["segment"]: r["n"] for r in data.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()}
    usable = {s: sorted(r["fold"] for r in sizes if r["segment"] == s and r["train"] >= LEAST_TRAIN and r["test"] >= LEAST_TEST) if n >= LEAST_ROWS else []
              for s, n in whole.items()}
    edges = B.quantile_edges(data, features)
    rngs = {s: random.Random(f"{seed}/{s}") for s in sorted(whole)}
    trials: dict[str, list] = {s: [] for s in rngs}
    while any(len(t) < n_trials for t in trials.values()):
        made: dict[tuple[str, int], dict] = {}
        for s, rng in rngs.items():
            done = [(p, mae) for p, mae, _ in trials[s]]
            size = min(batch if len(done) >= tpe.STARTUP else tpe.STARTUP, n_trials - len(done))
            made |= {(s, len(done) + i): tpe.propose(done, SEARCH_SPACE, rng) for i in range(size)}
        runs = [(s, f, k) for s, k in made for f in usable[s]]
        scored: dict[tuple[str, int], list[float]] = {}
        if runs:
            todo = F.broadcast(spark.createDataFrame(runs, "segment string, fold int, trial int"))
            rows = folds.join(todo, ["segment", "fold"]).withColumn("model", F.concat_ws("/", "segment", "trial", "fold"))
            params = {f"{s}/{k}/{f}": boost_params(made[s, k], seed) for s, f, k in runs}
            preds = B.fit_predict(rows, features, label, ["segment", "trial", "fold", label], "model", params, F.col("role"), row_id(keys, ts), edges=edges)
            maes = preds.groupBy("segment", "trial", "fold").agg(F.avg(F.abs(F.col("pred") - F.col(label))).alias("mae")).collect()
            for r in sorted(maes, key=lambda r: r["fold"]):
                scored.setdefault((r["segment"], r["trial"]), []).append(r["mae"])
        for (s, k), p in made.items():
            got = scored.get((s, k), [])
            trials[s].append((p, sum(got) / len(got) if got else float("inf"), len(got)))
    return trials


def param_search(df: DataFrame, features: Sequence[str], label: str, n_trials: int = 50, ts: str = "timestamp_hour", seed: int = 42,
                 batch: int = 8, keys: Sequence[str] = ()) -> DataFrame:
    """Trials of one search over all rows: (trial, the arguments, mae, n_folds)."""
    found = search(df, features, label, F.lit("all"), n_trials, ts, seed, batch, keys).get("all", [])
    rows = [(i, *[float(p[k]) for k in SEARCH_SPACE], float(mae), n) for i, (p, mae, n) in enumerate(found)]
    return df.sparkSession.createDataFrame(rows, "trial int, " + ", ".join(f"{k} double" for k in SEARCH_SPACE) + ", mae double, n_folds int")


def tune_segments(df: DataFrame, features: Sequence[str], label: str, n_trials: int = 50, ts: str = "timestamp_hour", variant: str = "model",
                  seed: int = 42, batch: int = 8, keys: Sequence[str] = (), val_col: str | None = None) -> tuple[B.Forest, dict[str, dict]]:
    """Search every segment's arguments, then fit the winners and the global model on all rows.

    Returns the forest and the winning arguments by segment.  Winners are fitted without a validation
    tail, for the number of rounds that won; ``val_col`` only stops the global model.
    """
    found = search(df, features, label, S.segment(F.hour(ts), variant), n_trials, ts, seed, batch, keys)
    best = {}
    for s, trials in found.items():
        p, mae, _ = min(trials, key=lambda t: t[1])
        if mae < float("inf"):
            best[s] = p
    seg = S.segment(F.hour(ts), variant)
    of = F.array_compact(F.array(F.lit(GLOBAL), F.when(seg.isin(sorted(best)), seg)))
    rows = df.filter(F.col(label).isNotNull()).withColumn("_of", F.explode(of))
    role = F.when(F.col("_of") == GLOBAL, _role(val_col)).otherwise(0)
    own = {GLOBAL: B.Params()} | {s: boost_params(p, seed) for s, p in best.items()}
    return B.fit_models(rows, features, label, "_of", own, role, row_id(keys, ts)), best
