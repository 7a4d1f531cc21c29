import datetime as dt
import inspect
import math

import numpy as np
from pyspark.sql import functions as F

from shiftcast.operators import models as M
from shiftcast.plans.jobs import load_models, read_or_empty, train_final_models

T0 = dt.datetime(2024, 1, 1)


def _seasonal(spark, n=24 * 42, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        t = T0 + dt.timedelta(hours=i)
        y = 20 + 15 * np.sin(2 * np.pi * t.hour / 24) + 5 * (t.weekday() >= 4) + rng.normal(0, 2)
        rows.append((t, float(max(y, 0)), t.hour, t.weekday()))
    return spark.createDataFrame(rows, "timestamp_hour timestamp_ntz, y double, hour int, weekday int")


FEATS = ["hour", "weekday"]


def test_gbt_beats_mean_and_asymmetric_loss_lowers_underprediction(spark):
    df = _seasonal(spark)
    cut = T0 + dt.timedelta(days=35)
    train, test = df.filter(F.col("timestamp_hour") < cut), df.filter(F.col("timestamp_hour") >= cut)
    pred = M.predict(M.fit_gbt(train, FEATS, "y", {"n_estimators": 60, "max_depth": 4, "learning_rate": 0.2}), test)
    mae = pred.agg(F.avg(F.abs(F.col("pred") - F.col("y")))).first()[0]
    mean_mae = test.agg(F.avg(F.abs(F.col("y") - F.lit(train.agg(F.avg("y")).first()[0])))).first()[0]
    assert mae < 0.3 * mean_mae
    args = dict(n_estimators=40, learning_rate=0.3, max_depth=4)
    under = lambda m: M.predict(m, test).agg(F.avg((F.col("pred") < F.col("y")).cast("double"))).first()[0]
    assert under(M.fit_asym_boost(train, FEATS, "y", **args)) < under(M.fit_asym_boost(train, FEATS, "y", under_weight=1.0, **args))


def test_segments_are_routed_in_one_forest(spark, tmp_dir):
    df = _seasonal(spark, n=24 * 21)  # 84 rows for a 4-hour segment (>= 80)
    few = {"n_estimators": 8, "max_depth": 3, "learning_rate": 0.3}
    forest = M.fit_segment_models(df, FEATS, "y", params={m: few for m in ("global", "lunch", "evening", "late_bar", "off_peak")})
    assert forest.models() == ["evening", "global", "late_bar", "lunch", "off_peak"]
    routed = M.predict_routed(df, forest)
    assert routed.count() == df.count()
    used = {(r.hour, r.model_used) for r in routed.select("hour", "model_used").distinct().collect()}
    assert (12, "lunch") in used and (5, "global") in used
    # a segment's rows are scored by the model fitted on them alone
    own = M.fit_asym_boost(df.filter("hour between 12 and 15"), FEATS, "y", **few)
    one = {r.timestamp_hour: r.pred for r in M.predict(own, df.filter("hour between 12 and 15")).collect()}
    two = {r.timestamp_hour: r.pred for r in routed.filter("model_used = 'lunch'").collect()}
    assert one.keys() == two.keys() and max(abs(one[k] - two[k]) for k in one) < 2.0
    mae = {r.segment: r for r in M.segment_mae(df, forest, "y").collect()}
    assert mae["lunch"].n == 84 and set(mae) == {"evening", "late_bar", "lunch", "off_peak"}
    want = M.predict(forest, df.filter("hour between 12 and 15")).agg(F.avg(F.abs(F.col("pred") - F.col("y")))).first()[0]
    assert abs(mae["lunch"].mae_before - want) < 1e-9
    fi = M.feature_importance(forest)
    assert abs(fi.agg(F.sum("importance_pct")).first()[0] - 100.0) < 1e-9


def test_expanding_folds_are_quarters_of_the_rows(spark):
    df = _seasonal(spark, n=103).withColumn("segment", F.lit("all"))
    rows = M.expanding_folds(df, ["segment"]).collect()
    order = sorted({r.timestamp_hour for r in rows})
    for f in range(3):
        end, stop = 103 * (f + 1) // 4, 103 * (f + 2) // 4
        assert sorted(r.timestamp_hour for r in rows if r.fold == f and r.role == 0) == order[:end]
        assert sorted(r.timestamp_hour for r in rows if r.fold == f and r.role == 2) == [T0 + dt.timedelta(hours=h) for h in range(end, stop)]


def test_search_guards_and_seed(spark, monkeypatch):
    small = _seasonal(spark, n=50)
    assert [r.mae for r in M.param_search(small, ["hour"], "y", n_trials=2).collect()] == [math.inf] * 2
    monkeypatch.setitem(M.SEARCH_SPACE, "n_estimators", M.tpe.Range(3, 8, whole=True))
    df = _seasonal(spark, n=24 * 12)
    one = M.param_search(df, FEATS, "y", n_trials=12, batch=2).collect()
    two = M.param_search(df.repartition(3), FEATS, "y", n_trials=12, batch=2).collect()
    assert [r[:-2] for r in one] == [r[:-2] for r in two] and np.allclose([r.mae for r in one], [r.mae for r in two])
    assert [r.trial for r in one] == list(range(12)) and all(r.n_folds == 3 and r.mae < 30 for r in one)


def test_registered_search_has_the_defaults(monkeypatch):
    from types import SimpleNamespace

    from shiftcast.plans import model_queries as Q

    seen = {}
    search = inspect.signature(M.param_search)
    monkeypatch.setattr(Q, "p1_model_table", lambda *a, **k: SimpleNamespace(columns=[]))
    monkeypatch.setattr(M, "param_search", lambda *a, **k: seen.update(search.bind(*a, **k).arguments))
    Q.q_param_search(None, None)
    default = {k: p.default for k, p in search.parameters.items() if p.default is not p.empty}
    assert {k: seen.get(k, v) for k, v in default.items()} == default
    assert (default["n_trials"], default["seed"]) == (50, 42)


def test_registered_boosters_and_folds_have_the_defaults():
    from shiftcast.operators import boosting as B
    from shiftcast.plans import model_queries as Q

    for f in (Q.q_asym_boost, Q.q_segment_routed_forecast, Q.q_segment_mae, Q.q_ablation):
        assert not any(x in inspect.getsource(f) for x in ("params=", "rounds", "early_stopping", "learning_rate", "n_estimators"))
    assert "n_splits" not in inspect.getsource(Q.q_ablation) and "**" not in inspect.getsource(Q.q_ablation)
    assert (B.ASYMMETRIC.n_estimators, B.ASYMMETRIC.learning_rate, B.ASYMMETRIC.early_stopping) == (800, 0.05, 50)


def test_tuned_models_persist_reload_and_route(spark, tmp_dir, monkeypatch):
    monkeypatch.setitem(M.SEARCH_SPACE, "n_estimators", M.tpe.Range(3, 6, whole=True))
    df = _seasonal(spark, n=24 * 32)
    paths = train_final_models(df, "y", FEATS, tmp_dir, trials=3)
    forest = load_models(spark, tmp_dir, "y")
    assert forest.models() == ["evening", "global", "late_bar", "lunch", "off_peak"]
    best = spark.read.parquet(paths["best_params_y"])
    assert best.count() == 4 * len(M.SEARCH_SPACE)
    rates = {r.segment: r.value for r in best.where("name = 'learning_rate'").collect()}
    assert all(forest.rates[s] == v for s, v in rates.items())
    rounds = {r.segment: int(r.value) for r in best.where("name = 'n_estimators'").collect()}
    grown = {r.model: r.n for r in forest.nodes.groupBy("model").agg(F.max("tree").alias("n")).collect()}
    assert all(grown[s] + 1 == n for s, n in rounds.items())
    assert M.predict_routed(df, forest).where("pred is not null").count() == df.count()
    assert spark.read.parquet(paths["baseline_y"]).count() == 24 * 7


def test_fail_soft_source(spark):
    df = read_or_empty(spark, lambda: spark.read.parquet("/nonexistent/path/x.parquet"), "date date, n int")
    assert df.count() == 0 and df.columns == ["date", "n"]
