"""Pipeline jobs (survey 2.L): the refresh job and model persistence.

The refresh job takes its sources as functions.  Each stage is written to a
staging folder first, which runs it to its end; only then does it replace the
stage's table in the output folder (a shared location on a cluster).  A stage
that fails at any point leaves the last good table as it is and is reported.
Later stages read the tables that earlier ones wrote.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftcast.session import cut_lineage
from shiftcast.sources.ingest import write_parquet

log = logging.getLogger(__name__)

Loader = Callable[[], DataFrame]


@dataclass
class StageResult:
    """``written``, ``kept`` (failed, an older table is there) or ``missing`` (failed, none is)."""

    path: str
    status: str
    error: str = ""


def read_or_empty(spark: SparkSession, loader: Loader, schema: T.StructType | str) -> DataFrame:
    """Run ``loader``; if the source cannot be opened return an empty frame of ``schema``.

    For optional sources of a single query; tables that are kept go through :func:`run_stage`.
    """
    try:
        df = loader()
        df.schema  # noqa: B018 - force analysis so missing paths fail here
        return df
    except Exception as e:  # noqa: BLE001 - fail-soft by design
        log.warning("source failed (%s); continuing with an empty table", e)
        return spark.createDataFrame([], schema)


def read_table_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``; None if there is none."""
    try:
        return spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def run_stage(spark: SparkSession, loader: Loader, path: str, partition_by: Sequence[str] = ()) -> StageResult:
    """Write ``loader()``'s rows to ``path``, or keep what is there if they can't be read to the end.

    Should the copy from the staging folder fail, that folder still holds the rows.
    """
    base, _, name = path.rstrip("/").rpartition("/")
    staging = f"{base}/_staging/{name}-{uuid.uuid4().hex}"
    try:
        loader().write.parquet(staging)  # a read error part way ends here
        write_parquet(spark.read.parquet(staging), path, partition_by)
        old = spark._jvm.org.apache.hadoop.fs.Path(staging)
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        return StageResult(path, "written")
    except Exception as e:  # noqa: BLE001 - fail-soft by design
        log.warning("stage %s failed: %s", name, e)
        there = read_table_or_none(spark, path) is not None
        return StageResult(path, "kept" if there else "missing", str(e).splitlines()[0][:300])


def sample_sources(spark: SparkSession, sf_dir: str) -> dict[str, Loader]:
    """The refresh job's sources from the given test tables and their stand-ins."""
    from shiftcast.plans.enrich_queries import enrichment_table
    from shiftcast.sources import standins as ST
    from shiftcast.sources.tables import panel_p3

    return {"panel": lambda: panel_p3(spark, sf_dir), "enrichment": lambda: enrichment_table(spark, sf_dir),
            "footfall": lambda: ST.footfall_hourly(spark, sf_dir), "failte": lambda: ST.failte_daily(spark, sf_dir),
            "weather": lambda: ST.weather_by_ts(spark, sf_dir)}


def refresh(spark: SparkSession, sources: dict[str, Loader], out_dir: str, keys: Sequence[str] = (),
            targets: Sequence[str] = ("orders_count", "food_tickets_count"), retrain: bool = False,
            drop_na: bool = False, trials: int = 50) -> dict[str, StageResult]:
    """panel, enrichment, footfall, failte, weather → features (→ models) as Parquet tables.

    A source that is not given, or has failed and was never written, is left out of
    the features.  ``trials`` is how many arguments are tried for each segment's model.
    """
    from shiftcast.plans.feature_table import build_feature_table

    root = out_dir.rstrip("/")
    out = {name: run_stage(spark, loader, f"{root}/{name}") for name, loader in sources.items()}

    def features() -> DataFrame:
        have = {n: read_table_or_none(spark, f"{root}/{n}") for n in ("panel", "enrichment", "footfall", "failte", "weather")}
        if have["panel"] is None:
            raise ValueError("there is no panel table")
        panel = have.pop("panel")
        return build_feature_table(panel, keys=keys, targets=targets, drop_na=drop_na, **have)

    out["features"] = run_stage(spark, features, f"{root}/features")
    if retrain and out["features"].status != "missing":
        from shiftcast.operators import availability as AV

        ft = spark.read.parquet(out["features"].path)
        feats = AV.feature_cols(ft.columns, AV.SAFE_FOR_NEXT_DAY)
        for target in targets:
            for name, path in train_final_models(ft, target, feats, f"{root}/models", keys, trials).items():
                out[name] = StageResult(path, "written")
    return out


def train_final_models(df: DataFrame, target: str, features: list[str], path: str, keys: Sequence[str] = (),
                       trials: int = 50) -> dict[str, str]:
    """Search each segment's booster, fit the winners and the global booster (last 10 % as its validation
    tail) on all labelled rows and save them with the baseline's slot table.  0 ``trials``: default arguments."""
    from shiftcast.operators import forecast as FC
    from shiftcast.operators import models as M

    lab = df.filter(F.col(target).isNotNull())
    slots = FC.slot_history(lab, target, keys)
    slots = slots.groupBy(*keys, "hour", "weekday").agg(F.max_by("slot_mean", F.col("timestamp_hour")).alias("slot_mean"))
    out = {f"baseline_{target}": f"{path}/baseline_{target}", f"boosters_{target}": f"{path}/boosters_{target}"}
    write_parquet(slots, out[f"baseline_{target}"])
    train = cut_lineage(FC.val_split_by_time(lab.dropna(subset=list(features)), share=0.10, minimum=200))
    if trials:
        forest, best = M.tune_segments(train, features, target, trials, keys=keys, val_col="is_val")
        out[f"best_params_{target}"] = f"{path}/best_params_{target}"
        rows = [(s, k, float(v)) for s, p in sorted(best.items()) for k, v in p.items()]
        write_parquet(df.sparkSession.createDataFrame(rows, "segment string, name string, value double"), out[f"best_params_{target}"])
    else:
        forest = M.fit_segment_models(train, features, target, keys=keys, val_col="is_val")
    forest.save(out[f"boosters_{target}"])
    return out


def load_models(spark: SparkSession, path: str, target: str):
    """The forest that :func:`train_final_models` saved, for :func:`models.predict_routed`."""
    from shiftcast.operators.boosting import Forest

    return Forest.load(spark, f"{path}/boosters_{target}")
