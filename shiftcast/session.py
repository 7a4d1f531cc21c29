"""Spark session helpers.

Library code never creates a session on its own; jobs and tests call
``get_spark``.  The checkpoint folder is read from the session
(``spark.checkpoint.dir``) and only set here when the cluster left it
unset, which is the local-test case.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Rows at or below this bound may be broadcast when the bound is *proven*
# (for example a calendar dimension: one row per day of a known range).
BROADCAST_ROW_LIMIT = 200_000
# Rows that one task of a job by keys aims at; its sorts and hash tables hold
# them all (about 1 kB for each row of the feature table).
TASK_ROWS = 250_000


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app: str = "shiftcast") -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    spark = (
        builder
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("SHIFTCAST_DRIVER_MEMORY", "8g"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder.

    Only a local master (tests) gets one of its own when ``spark.checkpoint.dir``
    is unset; on a cluster that is an error, since executors share no local disk.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf_dir = tempfile.mkdtemp(prefix="shiftcast-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(conf_dir)
    return conf_dir


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def key_partitions(spark: SparkSession, rows: int) -> int:
    """Partitions for ``rows`` rows dealt by their keys, so that a task's share does not grow with the input."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def join_dimension(fact: DataFrame, dim: DataFrame, on, how: str = "left",
                   bound_rows: int | None = None) -> DataFrame:
    """Join a dimension; broadcast it only when its row bound is known and small.

    ``bound_rows`` must be an upper bound that follows from how ``dim`` was
    built (days in a date range, number of folds, ...).  Without a bound the
    join is left to the planner and AQE, which switch to a broadcast only
    after measuring the shuffled side at run time.
    """
    from pyspark.sql import functions as F

    if bound_rows is not None and bound_rows <= BROADCAST_ROW_LIMIT:
        dim = F.broadcast(dim)
    return fact.join(dim, on, how)
