"""Regularised histogram boosting of many models in one job (survey H2, H3).

Rows carry the id of the model they train (a fold, a segment, a trial, or all of these),
so any number of models grow in the same passes.  Features are cut into quantile bins
once.  Every round grows a tree level by level from sums of gradients and hessians per
(model, node, feature, bin): a split is taken where it lowers the loss most,

    T(GL)^2 / (HL + l2) + T(GR)^2 / (HR + l2) - T(G)^2 / (H + l2),   T(x) = sign(x) max(|x| - l1, 0),

with at least ``min_child_weight`` hessian on both sides, and a leaf gets the Newton step
-T(G) / (H + l2).  Rows are sampled for a tree by a hash of their id, features by the
tree's seed; a model stops after ``early_stopping`` rounds that don't lower the absolute
error of its validation rows and keeps the rounds up to the best one.

Gradients are rounded to multiples of a power of two that is small enough for their sums
to be exact whatever the order of the rows.  So a model does not depend on how rows are
dealt out, and it comes out the same from both ways to grow it:

* a model of at most ``LOCAL_ROWS`` rows (counted first) is grown by one task, all models
  side by side as groups of one ``applyInArrow``;
* larger models are grown by grouped sums over all executors, all of them in the same
  job for each level: ``explode`` of the bins, a hash aggregate with map-side combining,
  running sums over the bins of a feature, and the best split of a node by a maximum.
  Only splits (one row for each node) reach the driver.  Rows' predictions are checkpointed
  every ``CHECKPOINT`` rounds.

A fitted set of models is a table of nodes (:class:`Forest`), kept as Parquet; it scores
rows of all models in one pass.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shiftcast.session import cut_lineage, ship_package

#: Rows of a model that one task may grow, and rounds between checkpoints of larger ones.
LOCAL_ROWS = 200_000
CHECKPOINT = 10
#: Most bins of a feature.
BINS = 64
#: Least gain of a split.
LEAST_GAIN = 1e-6
#: Nodes that are broadcast together for scoring.
SCORE_NODES = 4_000_000

NODES = "model string, tree int, node int, feature string, threshold double, weight double, gain double"


@dataclass(frozen=True)
class Params:
    # The reference's booster settings.
    n_estimators: int = 800
    learning_rate: float = 0.05
    max_depth: int = 6
    min_child_weight: float = 5.0
    subsample: float = 0.8
    colsample_bytree: float = 0.8
    reg_alpha: float = 0.1
    reg_lambda: float = 1.0
    seed: int = 42
    early_stopping: int = 50
    #: How much an under-prediction weighs; None is the plain squared error.
    under_weight: float | None = None
    #: First prediction; None is the mean of the training labels.
    base: float | None = None

    def columns(self, tree: int, usable: Sequence[int]) -> list[int]:
        """The features that a tree may split by."""
        rng = random.Random(f"{self.seed}/{tree}")
        return sorted(rng.sample(list(usable), max(1, int(len(usable) * self.colsample_bytree)))) if usable else []


#: Under-predictions weigh twice; boosting begins at one half.
ASYMMETRIC = Params(under_weight=2.0, base=0.5)


# ---------------------------------------------------------------- bins

def quantile_edges(rows: DataFrame, features: Sequence[str], bins: int = BINS) -> list[list[float]]:
    """Upper borders of the bins of each feature but the last, from one aggregate over all features."""
    at = [i / bins for i in range(1, bins)]
    got = rows.agg(*[F.percentile_approx(_value(c), at, 10_000).alias(f"q{i}") for i, c in enumerate(features)]).first()
    return [sorted(set(got[f"q{i}"] or [])) for i in range(len(features))]


def _value(feature: str) -> Column:
    return F.coalesce(F.col(feature).cast("double"), F.lit(0.0))


def _code_rows(edges: list[np.ndarray], features: list[str], kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.empty((batch.num_rows, len(features)), np.int16)
            for i, (c, e) in enumerate(zip(features, edges)):
                x = batch.column(batch.schema.names.index(c)).to_numpy(zero_copy_only=False)
                codes[:, i] = np.searchsorted(e, x)  # x <= edge goes left
            offs = np.arange(batch.num_rows + 1, dtype=np.int32) * len(features)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.names.index(c)) for c in kept),
                 pa.ListArray.from_arrays(pa.array(offs), pa.array(codes.ravel()))], [*kept, "_codes"])
    return run


def binned(rows: DataFrame, features: Sequence[str], edges: list[list[float]]) -> DataFrame:
    """``rows`` without the features, with their bins as ``_codes``; null features count as 0."""
    ship_package(rows.sparkSession)
    kept = [c for c in rows.columns if c not in features or c.startswith("_")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in kept)
    plain = rows.select(*kept, *[_value(c).alias(c) for c in features])
    return plain.mapInArrow(_code_rows([np.array(e) for e in edges], list(features), kept), f"{kinds}, _codes array<smallint>")


# ---------------------------------------------------------------- what both ways share

def _soft(g, alpha):
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def _term(g, h, p: Params):
    t = _soft(g, p.reg_alpha)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(h + p.reg_lambda > 0, t * t / (h + p.reg_lambda), 0.0)


def leaf_weight(g: float, h: float, p: Params) -> float:
    return float(-_soft(g, p.reg_alpha) / (h + p.reg_lambda)) if h + p.reg_lambda > 0 else 0.0


def gradient_scale(rows: int, most: float) -> float:
    """Power of two by which gradients are multiplied before they are rounded."""
    return 2.0 ** math.floor(math.log2(2.0 ** 50 / (max(rows, 1) * 64 * max(most, 1.0))))


def hash_rows(rows: np.ndarray, *seeds: int) -> np.ndarray:
    """``xxhash64`` of the seeds and the row, as Spark has it for long values."""
    u = np.uint64
    p1, p2, p3, p4, p5 = (u(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turn(x, n):
        return (x << u(n)) | (x >> u(64 - n))

    h = np.full(len(rows), 42, u)
    with np.errstate(over="ignore"):
        for v in (*(np.full(len(rows), s, np.int64) for s in seeds), np.asarray(rows, np.int64)):
            h = h + p5 + u(8)
            h ^= turn(v.view(u) * p2, 31) * p1
            h = turn(h, 27) * p1 + p4
            h ^= h >> u(33)
            h *= p2
            h ^= h >> u(29)
            h *= p3
            h ^= h >> u(32)
    return h.view(np.int64)


def _sample_limit(share: float) -> int | None:
    """Rows with a smaller hash are in the sample; None: all."""
    return None if share >= 1 else int(-(1 << 63) + share * float(1 << 64))


# ---------------------------------------------------------------- one task

def grow(codes: np.ndarray, bins: Sequence[int], rows: np.ndarray, y: np.ndarray, role: np.ndarray, p: Params,
         usable: Sequence[int]) -> tuple[float, list[dict], np.ndarray]:
    """(base, trees, predictions of all rows) of one model.

    ``role``: 0 train, 1 validation, 2 neither.  A tree is {node: (feature, bin, gain) or weight}, the
    root 1 and the children of a node 2n and 2n + 1.
    """
    fit, val = role == 0, role == 1
    n = int(fit.sum())
    if not n:
        return (p.base if p.base is not None else 0.0), [], np.full(len(y), p.base or 0.0)
    scale = gradient_scale(n, float(np.abs(y[role < 2]).max()))
    base = p.base if p.base is not None else float(np.rint(y[fit] * scale).sum() / scale / n)
    f = np.full(len(y), base)
    first = np.concatenate(([0], np.cumsum(bins))).astype(np.int64)
    trees: list[dict] = []
    best, best_loss, kept = 0, _loss(y[val], f[val], scale), f
    limit = _sample_limit(p.subsample)
    for k in range(p.n_estimators):
        g, h = _gradients(f, y, p)
        g = np.rint(g * scale)
        used = fit if limit is None else fit & (hash_rows(rows, p.seed, k) < limit)
        tree, step = _tree(codes, bins, first, p.columns(k, usable), g, h, used, scale, p)
        trees.append(tree)
        f = f + p.learning_rate * step
        if not val.any():
            best, kept = k + 1, f
            continue
        loss = _loss(y[val], f[val], scale)
        if loss < best_loss:
            best, best_loss, kept = k + 1, loss, f
        elif k + 1 - best >= p.early_stopping:
            break
    return base, trees[:best], kept


def _loss(y: np.ndarray, f: np.ndarray, scale: float) -> float:
    return float(np.rint(np.abs(y - f) * scale).sum())


def _gradients(f: np.ndarray, y: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    r = f - y
    if p.under_weight is None:
        return r, np.ones(len(r))
    h = np.where(r < 0, 2.0 * p.under_weight, 2.0)
    return h * r, h


def _tree(codes, bins, first, columns, g, h, used, scale, p: Params) -> tuple[dict, np.ndarray]:
    """A tree and what it gives every row."""
    tree: dict = {}
    node = np.ones(len(g), np.int64)
    at = np.flatnonzero(used)
    starts = np.concatenate(([0], np.cumsum([bins[c] for c in columns]))).astype(np.int64)
    cells = int(starts[-1])
    own = codes[:, columns].astype(np.int64) + starts[:-1]
    last = np.zeros(cells, bool)
    last[starts[1:] - 1] = True
    of = np.repeat(np.arange(len(columns)), [bins[c] for c in columns])
    open_ = {1: (float(g[at].sum()) / scale, float(h[at].sum()))}
    for depth in range(p.max_depth + 1):
        names = np.array(sorted(open_), np.int64)
        if not len(names):
            break
        if depth < p.max_depth and cells:
            slot = np.searchsorted(names, node[at])
            place = (slot[:, None] * cells + own[at]).ravel()
            size = len(names) * cells
            gs = np.bincount(place, np.repeat(g[at], len(columns)), size).reshape(-1, cells)
            hs = np.bincount(place, np.repeat(h[at], len(columns)), size).reshape(-1, cells)
            # running sums over the bins of each feature; all sums are exact
            gl, hl = (np.cumsum(x, 1) for x in (gs, hs))
            gl, hl = (x - np.concatenate((np.zeros((len(x), 1)), x), 1)[:, starts[:-1]][:, of] for x in (gl, hl))
            gl /= scale
            total = np.array([open_[int(k)] for k in names])
            gr, hr = total[:, :1] - gl, total[:, 1:] - hl
            gain = _term(gl, hl, p) + _term(gr, hr, p) - _term(total[:, :1], total[:, 1:], p)
            gain[(hl < p.min_child_weight) | (hr < p.min_child_weight) | last | (hl <= 0) | (hr <= 0)] = -np.inf
            top = gain.argmax(1)
        nxt: dict = {}
        live = np.zeros(len(names), bool)
        for i, k in enumerate(names.tolist()):
            if depth < p.max_depth and cells and gain[i, top[i]] > LEAST_GAIN:
                c = int(top[i])
                tree[k] = (columns[int(of[c])], c - int(starts[of[c]]), float(gain[i, c]))
                nxt[2 * k] = (float(gl[i, c]), float(hl[i, c]))
                nxt[2 * k + 1] = (float(gr[i, c]), float(hr[i, c]))
                live[i] = True
            else:
                tree[k] = leaf_weight(*open_[k], p)
        if live.any():
            where = np.minimum(np.searchsorted(names, node), len(names) - 1)
            moved = (names[where] == node) & live[where]
            split = np.array([tree[k][:2] if live[i] else (0, 0) for i, k in enumerate(names.tolist())])
            rows = np.flatnonzero(moved)
            s = split[where[rows]]
            node[rows] = 2 * node[rows] + (codes[rows, s[:, 0]] > s[:, 1])
            at = at[moved[at]]
        open_ = nxt
    leaves = np.array(sorted(k for k, v in tree.items() if not isinstance(v, tuple)), np.int64)
    weight = np.array([tree[int(k)] for k in leaves])
    return tree, weight[np.searchsorted(leaves, node)]


def _nodes(model: str, base: float, trees: list[dict], features: Sequence[str], edges) -> pa.Table:
    rows = [(model, -1, 0, None, None, base, None)]
    for k, tree in enumerate(trees):
        for node, v in sorted(tree.items()):
            if isinstance(v, tuple):
                rows.append((model, k, node, features[v[0]], float(edges[v[0]][v[1]]), None, v[2]))
            else:
                rows.append((model, k, node, None, None, v, None))
    columns = list(zip(*rows))
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.float64())
    return pa.table({name.split()[0]: pa.array(c, kind) for name, c, kind in zip(NODES.split(", "), columns, kinds)})


@dataclass
class _Plan:
    """What tasks need to know: bins, and each model's arguments and features."""

    features: list[str]
    edges: list[np.ndarray]
    params: Mapping[str, Params]
    usable: Mapping[str, list[int]]

    @property
    def bins(self) -> list[int]:
        return [len(e) + 1 for e in self.edges]

    def run(self, t: pa.Table) -> tuple[str, float, list[dict], np.ndarray]:
        model = t["_model"][0].as_py()
        codes = t["_codes"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        y = t["_y"].to_numpy().astype(np.float64)
        base, trees, f = grow(codes, self.bins, t["_row"].to_numpy(), y, t["_role"].to_numpy(), self.params[model], self.usable[model])
        return model, base, trees, f


# ---------------------------------------------------------------- all executors

def _level_splits(rows: DataFrame, plan: DataFrame, columns: DataFrame) -> DataFrame:
    """Best split of each node: (_model, _node, g, h, and feature, bin, gain, gl, hl of the best split if there is one).

    ``rows(_model, _node, _codes, _g, _h)`` are the sampled training rows in open nodes, ``plan`` has the
    models' arguments and ``columns`` the features that their trees may split by.
    """
    cells = rows.select("_model", "_node", "_g", "_h", F.posexplode("_codes").alias("_feature", "_bin"))
    cells = cells.join(F.broadcast(columns), ["_model", "_feature"])
    sums = cells.groupBy("_model", "_node", "_feature", "_bin").agg(F.sum("_g").alias("_g"), F.sum("_h").alias("_h"))
    of = Window.partitionBy("_model", "_node", "_feature")
    run = of.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.join(F.broadcast(plan), "_model").select(
        "_model", "_node", "_feature", "_bin", "_alpha", "_lambda", "_least",
        (F.sum("_g").over(run) / F.col("_scale")).alias("gl"), F.sum("_h").over(run).cast("double").alias("hl"),
        (F.sum("_g").over(of) / F.col("_scale")).alias("g"), F.sum("_h").over(of).cast("double").alias("h"))
    sums = sums.withColumn("gr", F.col("g") - F.col("gl")).withColumn("hr", F.col("h") - F.col("hl"))

    def term(g: str, h: str) -> Column:
        t = F.signum(F.col(g)) * F.greatest(F.abs(F.col(g)) - F.col("_alpha"), F.lit(0.0))
        below = F.col(h) + F.col("_lambda")
        return F.when(below > 0, t * t / below).otherwise(0.0)

    good = (F.col("hl") >= F.col("_least")) & (F.col("hr") >= F.col("_least")) & (F.col("hl") > 0) & (F.col("hr") > 0)
    gain = F.when(good, term("gl", "hl") + term("gr", "hr") - term("g", "h"))
    best = F.max(F.when(gain > LEAST_GAIN, F.struct(gain.alias("gain"), (-F.col("_feature")).alias("f"), (-F.col("_bin").cast("int")).alias("b"), "gl", "hl")))
    return (sums.groupBy("_model", "_node").agg(F.first("g").alias("g"), F.first("h").alias("h"), best.alias("s"))
            .select("_model", "_node", "g", "h", (-F.col("s.f")).alias("feature"), (-F.col("s.b")).alias("bin"), "s.gain", "s.gl", "s.hl"))


def root_splits(rows: DataFrame, features: Sequence[str], label: str, edges: list[list[float]], model: str = "model",
                params: Params = ASYMMETRIC) -> DataFrame:
    """The first split of every model by grouped sums over all rows: (model, feature, threshold, gain, g, h, gl, hl).

    What :func:`grow_distributed` does on each level, for the roots of models that begin at ``params.base``
    and see all rows and features; feature and what follows is null where no split gains."""
    features = list(features)
    ready, _ = _prepared(rows, features, label, model, None, None, edges, ())
    sizes = {r["_model"]: (r["n"], r["most"]) for r in ready.groupBy("_model").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("_y")).alias("most")).collect()}
    spark = rows.sparkSession
    plan = spark.createDataFrame([(m, gradient_scale(n, most), params.reg_alpha, params.reg_lambda, float(params.min_child_weight)) for m, (n, most) in sizes.items()],
                                 "_model string, _scale double, _alpha double, _lambda double, _least double")
    r = F.lit(params.base) - F.col("_y")
    h = F.lit(1) if params.under_weight is None else F.when(r < 0, int(2 * params.under_weight)).otherwise(2)
    now = ready.join(F.broadcast(plan.select("_model", "_scale")), "_model").select(
        "_model", F.lit(1).cast("long").alias("_node"), "_codes", F.rint(r * h * F.col("_scale")).cast("long").alias("_g"), h.cast("long").alias("_h"))
    columns = spark.createDataFrame([(m, c) for m in sizes for c in range(len(features))], "_model string, _feature int")
    best = _level_splits(now, plan, columns)
    names = F.array(*[F.lit(c) for c in features])
    borders = F.array(*[F.array(*[F.lit(float(x)) for x in e]) for e in edges])
    # get: by [] generated code takes the null of a model without a split for -1 and fails
    return best.select(F.col("_model").alias(model), F.get(names, F.col("feature")).alias("feature"),
                       F.get(F.get(borders, F.col("feature")), F.col("bin")).alias("threshold"), "gain", "g", "h", "gl", "hl")


def _moved(rows: DataFrame, splits: list[tuple]) -> DataFrame:
    """Rows in the child of their node where it was split."""
    spark = rows.sparkSession
    known = [(m, n, f, b) for m, n, f, b in splits]
    t = F.broadcast(spark.createDataFrame(known, "_model string, _node long, _by int, _to int"))
    child = 2 * F.col("_node") + F.when(F.element_at("_codes", F.col("_by") + 1) > F.col("_to"), 1).otherwise(0)
    return rows.join(t, ["_model", "_node"], "left").withColumn("_node", F.when(F.col("_by").isNull(), F.col("_node")).otherwise(child)).drop("_by", "_to")


def grow_distributed(rows: DataFrame, params: Mapping[str, Params], usable: Mapping[str, list[int]], features: Sequence[str],
                     edges: list[list[float]]) -> tuple[pa.Table, DataFrame]:
    """(nodes, rows with their prediction ``_f``) of the models in ``rows(_model, _row, _y, _role, _codes, ...)``."""
    spark = rows.sparkSession
    y, role = F.col("_y"), F.col("_role")
    sizes = rows.groupBy("_model").agg(F.count_if(role == 0).alias("n"), F.max(F.when(role < 2, F.abs(y))).alias("most"), F.count_if(role == 1).alias("val")).collect()
    info = {r["_model"]: (r["n"], gradient_scale(r["n"], r["most"] or 0.0), r["val"]) for r in sizes}
    scales = F.broadcast(spark.createDataFrame([(m, s) for m, (_, s, _) in info.items()], "_model string, _scale double"))
    state = rows.join(scales, "_model")
    means = {r["_model"]: r["s"] for r in state.where(role == 0).groupBy("_model").agg(F.sum(F.rint(y * F.col("_scale")).cast("long")).alias("s")).collect()}
    base = {m: params[m].base if params[m].base is not None else (means[m] / s / n if n else 0.0) for m, (n, s, _) in info.items()}
    plan = spark.createDataFrame([(m, s, base[m], params[m].reg_alpha, params[m].reg_lambda, float(params[m].min_child_weight), params[m].learning_rate,
                                   params[m].under_weight, params[m].seed, _sample_limit(params[m].subsample)) for m, (_, s, _) in info.items()],
                                 "_model string, _scale double, _base double, _alpha double, _lambda double, _least double, _rate double, "
                                 "_under double, _seed long, _limit long")
    state = rows.join(F.broadcast(plan.select("_model", "_scale", "_base", "_under", "_seed", "_limit", "_rate")), "_model")
    state = cut_lineage(state.withColumn("_f", F.col("_base")).withColumn("_kept", F.col("_base")))
    loss = F.sum(F.when(role == 1, F.rint(F.abs(y - F.col("_f")) * F.col("_scale")).cast("long")))

    def losses(df: DataFrame) -> dict:
        return {r["_model"]: r["loss"] for r in df.groupBy("_model").agg(loss.alias("loss")).collect()}

    best, best_loss = {m: 0 for m in info}, losses(state)
    trees: dict[str, list[dict]] = {m: [] for m in info}
    going = {m for m, (n, _, _) in info.items() if n and params[m].n_estimators}
    k, cached = 0, state
    while going:
        r = F.col("_f") - y
        h = F.when(F.col("_under").isNull(), 1).otherwise(F.when(r < 0, 2 * F.col("_under")).otherwise(2)).cast("long")
        picked = F.col("_limit").isNull() | (F.xxhash64(F.col("_seed"), F.lit(k).cast("long"), F.col("_row")) < F.col("_limit"))
        now = (state.where(F.col("_model").isin(sorted(going))).withColumn("_h", h)
               .withColumn("_g", F.rint(r * F.col("_h") * F.col("_scale")).cast("long")).withColumn("_node", F.lit(1).cast("long")))
        columns = spark.createDataFrame([(m, c) for m in going for c in params[m].columns(k, usable[m])], "_model string, _feature int")
        grown: dict[str, dict] = {m: {} for m in going}
        open_: dict[tuple, tuple] = {}
        for depth in range(max(params[m].max_depth for m in going)):
            live = now.where((role == 0) & picked)
            if depth:
                if not open_:
                    break
                names = F.broadcast(spark.createDataFrame([(m, n) for m, n in open_ if depth < params[m].max_depth] or [("", 0)], "_model string, _node long"))
                live = live.join(names, ["_model", "_node"], "left_semi")
            found = _level_splits(live.select("_model", "_node", "_codes", "_g", "_h"), plan, columns).collect()
            splits, following = [], {}
            for s in found:
                m, n = s["_model"], s["_node"]
                open_.pop((m, n), None)
                if s["gain"] is None:
                    grown[m][n] = leaf_weight(s["g"], s["h"], params[m])
                    continue
                grown[m][n] = (s["feature"], s["bin"], s["gain"])
                splits.append((m, n, s["feature"], s["bin"]))
                following[m, 2 * n] = (s["gl"], s["hl"])
                following[m, 2 * n + 1] = (s["g"] - s["gl"], s["h"] - s["hl"])
            for (m, n), (g_, h_) in open_.items():  # at their model's last level
                grown[m][n] = leaf_weight(g_, h_, params[m])
            open_ = following
            if splits:
                now = _moved(now, splits)
        for (m, n), (g_, h_) in open_.items():
            grown[m][n] = leaf_weight(g_, h_, params[m])
        leaves = [(m, n, w) for m, t in grown.items() for n, w in t.items() if not isinstance(w, tuple)]
        weights = F.broadcast(spark.createDataFrame(leaves, "_model string, _node long, _w double"))
        stepped = (now.join(weights, ["_model", "_node"], "left").withColumn("_f", F.col("_f") + F.col("_rate") * F.coalesce("_w", F.lit(0.0))))
        rest = state.where(~F.col("_model").isin(sorted(going)))
        state_now = stepped.select(*state.columns).unionByName(rest)
        state_now = cut_lineage(state_now) if (k + 1) % CHECKPOINT == 0 else state_now.persist()
        after = losses(state_now)  # materialises it before the last one goes
        cached.unpersist()
        cached = state_now
        better = []
        for m in sorted(going):
            trees[m].append(grown[m])
            if not info[m][2]:
                best[m] = k + 1
                better.append(m)
            elif after[m] < best_loss[m]:
                best[m], best_loss[m] = k + 1, after[m]
                better.append(m)
            if (info[m][2] and k + 1 - best[m] >= params[m].early_stopping) or k + 1 >= params[m].n_estimators:
                going.discard(m)
        state = state_now.withColumn("_kept", F.when(F.col("_model").isin(better), F.col("_f")).otherwise(F.col("_kept")))
        k += 1
    nodes = pa.concat_tables([_nodes(m, base[m], trees[m][:best[m]], features, edges) for m in sorted(info)]) if info else _nodes("", 0.0, [], [], []).slice(0, 0)
    return nodes, state.select(*rows.columns, F.col("_kept").alias("_f"))


# ---------------------------------------------------------------- fitting

def _prepared(rows: DataFrame, features: Sequence[str], label: str, model: str, role: Column | None, row: Column | None,
              edges: list[list[float]] | None, kept: Sequence[str]) -> tuple[DataFrame, list[list[float]]]:
    if not features:
        raise ValueError("a model needs at least one feature")
    role = role if role is not None else F.lit(0)
    ready = rows.select(F.col(model).cast("string").alias("_model"), F.col(label).cast("double").alias("_y"), role.cast("int").alias("_role"),
                        (row if row is not None else F.xxhash64(*features)).cast("long").alias("_row"),
                        *[F.col(c).alias(f"_keep_{c}") for c in kept], *features)
    # training rows need a label; the others are only scored
    ready = ready.where((F.col("_role") == 2) | F.col("_y").isNotNull()).withColumn("_y", F.coalesce("_y", F.lit(0.0)))
    edges = edges if edges is not None else quantile_edges(ready.where("_role = 0"), features)
    return cut_lineage(binned(ready, features, edges)), edges


def _ways(ready: DataFrame, params: Params | Mapping[str, Params], sets: Mapping[str, Sequence[str]] | None, features: Sequence[str]):
    """Arguments and features of each model, and which are small enough for a task."""
    sizes = {r["_model"]: r["n"] for r in ready.groupBy("_model").agg(F.count(F.lit(1)).alias("n")).collect()}
    own = {m: params if isinstance(params, Params) else params[m] for m in sizes}
    place = {c: i for i, c in enumerate(features)}
    usable = {m: sorted(place[c] for c in (sets[m] if sets else features)) for m in sizes}
    return own, usable, sorted(m for m, n in sizes.items() if n <= LOCAL_ROWS), sorted(m for m, n in sizes.items() if n > LOCAL_ROWS)


def _by_model(ready: DataFrame, models: Sequence[str]):
    """Rows grouped by model, in more partitions than models: their work, not their size, is what counts."""
    return ready.where(F.col("_model").isin(list(models))).repartition(max(1, 4 * len(models)), "_model").groupBy("_model")


def fit_models(rows: DataFrame, features: Sequence[str], label: str, model: str = "model", params: Params | Mapping[str, Params] = Params(),
               role: Column | None = None, row: Column | None = None, sets: Mapping[str, Sequence[str]] | None = None,
               edges: list[list[float]] | None = None) -> Forest:
    """One booster for each value of the column ``model``.

    ``role`` is 0 for training and 1 for validation rows (default: all train), ``row`` an id that decides
    which trees sample a row, ``sets`` the features of each model (default: all).
    """
    features = list(features)
    ready, edges = _prepared(rows, features, label, model, role, row, edges, ())
    own, usable, small, large = _ways(ready, params, sets, features)
    plan = _Plan(features, [np.array(e) for e in edges], own, usable)

    def one(t: pa.Table) -> pa.Table:
        name, base, trees, _ = plan.run(t)
        return _nodes(name, base, trees, plan.features, plan.edges)

    out = _by_model(ready, small).applyInArrow(one, NODES)
    if large:
        nodes, _ = grow_distributed(ready.where(F.col("_model").isin(large)), own, usable, features, edges)
        out = out.unionByName(rows.sparkSession.createDataFrame(nodes.to_pylist(), NODES))
    return Forest(cut_lineage(out), features, {m: p.learning_rate for m, p in own.items()})


def fit_predict(rows: DataFrame, features: Sequence[str], label: str, keep: Sequence[str], model: str = "model",
                params: Params | Mapping[str, Params] = Params(), role: Column | None = None, row: Column | None = None,
                sets: Mapping[str, Sequence[str]] | None = None, edges: list[list[float]] | None = None, out: str = "pred") -> DataFrame:
    """The rows of role 2 with the prediction of their model (clipped at 0): (model, *keep, out).

    ``keep`` may hold the model's column.  Models are fitted on the rows of role 0 and 1 as in :func:`fit_models`; no tree leaves the tasks.
    A model without training rows predicts null.
    """
    features, keep = list(features), list(keep)
    ready, edges = _prepared(rows, features, label, model, role, row, edges, keep)
    own, usable, small, large = _ways(ready, params, sets, features)
    plan = _Plan(features, [np.array(e) for e in edges], own, usable)
    kinds = dict(ready.dtypes)
    schema = ", ".join(["`_model` string", *(f"`_keep_{c}` {kinds[f'_keep_{c}']}" for c in keep), "`_f` double"])

    def one(t: pa.Table) -> pa.Table:
        _, _, _, f = plan.run(t)
        role_ = t["_role"].to_numpy()
        f = pa.array(f, mask=np.full(len(f), not (role_ == 0).any()))
        return t.select(["_model", *(f"_keep_{c}" for c in keep)]).append_column("_f", f).filter(pa.array(role_ == 2))

    got = _by_model(ready, small).applyInArrow(one, schema)
    if large:
        _, scored = grow_distributed(ready.where(F.col("_model").isin(large)), own, usable, features, edges)
        got = got.unionByName(scored.where("_role = 2").select("_model", *[f"_keep_{c}" for c in keep], "_f"))
    return got.select(*([] if model in keep else [F.col("_model").alias(model)]), *[F.col(f"_keep_{c}").alias(c) for c in keep],
                      F.when(F.col("_f").isNotNull(), F.greatest(F.col("_f"), F.lit(0.0))).alias(out))


# ---------------------------------------------------------------- fitted models

def _arrays(rows: list, place: Mapping[str, int], rate: Mapping[str, float]):
    """Per model (base, rate, features, thresholds, weights), the last three by tree and node."""
    per: dict[str, list] = {}
    for r in rows:
        per.setdefault(r["model"], []).append(r)
    out = {}
    for m, nodes in per.items():
        base = next(r["weight"] for r in nodes if r["tree"] < 0)
        trees, most = 1 + max(r["tree"] for r in nodes), 1 + max(r["node"] for r in nodes)
        feature, threshold, weight = np.full((trees, most), -1, np.int32), np.zeros((trees, most)), np.zeros((trees, most))
        for r in nodes:
            if r["tree"] >= 0 and r["feature"] is not None:
                feature[r["tree"], r["node"]], threshold[r["tree"], r["node"]] = place[r["feature"]], r["threshold"]
            elif r["tree"] >= 0:
                weight[r["tree"], r["node"]] = r["weight"]
        out[m] = base, rate[m], feature, threshold, weight
    return out


def score(x: np.ndarray, base: float, rate: float, feature: np.ndarray, threshold: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Predictions of the rows of ``x`` by all trees, tree after tree as they were fitted."""
    f = np.full(len(x), base)
    rows = np.arange(len(x))
    for ft, th, w in zip(feature, threshold, weight):
        node = np.ones(len(x), np.int64)
        while True:
            c = ft[node]
            if (c < 0).all():
                break
            node = np.where(c < 0, node, 2 * node + (x[rows, np.maximum(c, 0)] > th[node]))
        f = f + rate * w[node]
    return f


@dataclass
class Forest:
    """Fitted models as a table of nodes: (model, tree, node, feature, threshold, weight, gain).

    The row of tree -1 has the model's first prediction as ``weight``; leaves have a weight, splits a feature and
    a threshold (values up to it go left, to node 2n).  Weights are before the learning rate, which is in ``rates``."""

    nodes: DataFrame
    features: list[str]
    rates: Mapping[str, float]

    def save(self, path: str) -> None:
        self.nodes.coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        spark = self.nodes.sparkSession
        spark.createDataFrame([(i, c) for i, c in enumerate(self.features)], "place int, feature string").coalesce(1).write.mode("overwrite").parquet(f"{path}/features")
        spark.createDataFrame(sorted(self.rates.items()), "model string, rate double").coalesce(1).write.mode("overwrite").parquet(f"{path}/rates")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Forest:
        names = [r["feature"] for r in spark.read.parquet(f"{path}/features").orderBy("place").collect()]
        return Forest(spark.read.parquet(f"{path}/nodes"), names, {r["model"]: r["rate"] for r in spark.read.parquet(f"{path}/rates").collect()})

    def models(self) -> list[str]:
        return sorted(r["model"] for r in self.nodes.where("tree < 0").select("model").collect())

    def importance(self, model: str | None = None) -> DataFrame:
        """(feature, importance, importance_pct): the mean gain of a feature's splits and its share, largest first."""
        splits = self.nodes.where(F.col("feature").isNotNull())
        if model is not None:
            splits = splits.where(F.col("model") == model)
        mean = splits.groupBy("feature").agg(F.avg("gain").alias("importance"))
        total = mean.agg(F.sum("importance").alias("_all"))
        return (mean.join(F.broadcast(total)).select("feature", "importance", (F.col("importance") / F.col("_all") * 100).alias("importance_pct"))
                .orderBy(F.col("importance").desc(), "feature"))

    def predict(self, rows: DataFrame, model: Column, out: str = "pred") -> DataFrame:
        """``rows`` with the prediction of the model that the column ``model`` names (clipped at 0; null if there is none).

        Models are broadcast together up to ``SCORE_NODES`` nodes, in as many passes as that takes."""
        spark = rows.sparkSession
        ship_package(spark)
        sizes = self.nodes.groupBy("model").agg(F.count(F.lit(1)).alias("n")).orderBy("model").collect()
        groups: list[list[str]] = [[]]
        room = SCORE_NODES
        for r in sizes:
            if groups[-1] and r["n"] > room:
                groups.append([])
                room = SCORE_NODES
            groups[-1].append(r["model"])
            room -= r["n"]
        place = {c: i for i, c in enumerate(self.features)}
        named = rows.withColumn("_model", model)
        known = F.col("_model").isin([m for g in groups for m in g])
        names = rows.columns
        done = named.where(~F.coalesce(known, F.lit(False))).select(*names, F.lit(None).cast("double").alias(out))
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), f"`{out}` double"])
        for group in groups:
            if not group:
                continue
            found = self.nodes.where(F.col("model").isin(group)).collect()
            shared = spark.sparkContext.broadcast(_arrays(found, place, self.rates))
            x = [_value(c).alias(f"_x{i}") for i, c in enumerate(self.features)]
            part = named.where(F.col("_model").isin(group)).select(*names, "_model", *x)
            done = done.unionByName(part.mapInArrow(_score_rows(shared, names, len(x), out), schema))
        return done


def _score_rows(shared, names: list[str], width: int, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(names)
            x = np.stack([batch.column(n + 1 + i).to_numpy(zero_copy_only=False) for i in range(width)], 1) if width else np.zeros((batch.num_rows, 0))
            of = np.array(batch.column(n).to_pylist(), object)
            f = np.zeros(batch.num_rows)
            for m in set(of.tolist()):
                rows = np.flatnonzero(of == m)
                f[rows] = np.maximum(score(x[rows], *shared.value[m]), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(f)], [*names, out])
    return run

