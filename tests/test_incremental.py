"""Incremental refresh against a full rebuild, after late, corrected and new rows."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftcast.plans import incremental as I
from shiftcast.plans.feature_table import build_feature_table
from shiftcast.sources.ingest import write_parquet

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "k string, timestamp_hour timestamp_ntz, orders_count long, food_tickets_count long"


def _rows(days, seed=0):
    rng = np.random.default_rng(seed)
    return [(k, T0 + dt.timedelta(days=d, hours=h), int(rng.integers(0, 60)), int(rng.integers(0, 9)))
            for k in "ab" for d in range(days) for h in (9, 12, 15, 18, 21, 23) if rng.random() > 0.15]


@pytest.mark.parametrize("keyed", [True, False])
def test_equal_to_full_rebuild(spark, tmp_dir, keyed):
    keys = ["k"] if keyed else []
    build = lambda df: build_feature_table(df, keys=keys, drop_na=False)
    frame = lambda rows: spark.createDataFrame(rows if keyed else [r for r in rows if r[0] == "a"], SCHEMA).repartition(3)
    before = _rows(100)
    path = f"{tmp_dir}/features"
    write_parquet(build(frame(before)).withColumn("date", F.to_date("timestamp_hour")), path, ["date"])
    stamp = {d: os.path.getmtime(f"{path}/{d}") for d in os.listdir(path) if d.startswith("date=")}
    late = ("a", T0 + dt.timedelta(days=30, hours=10), 999, 3)
    fixed = next(r for r in before if r[0] == "a" and r[1].date() == dt.date(2024, 2, 20))
    new = [("a", T0 + dt.timedelta(days=100, hours=h), 50, 2) for h in (9, 12)]
    after = [r for r in before if r is not fixed] + [late, (fixed[0], fixed[1], fixed[2] + 100, fixed[3]), *new]
    changed = spark.createDataFrame([("a", r[1].date()) for r in (late, fixed, *new)], "k string, date date")
    days = {r.date for r in I.refresh_days(frame(after), changed if keyed else changed.drop("k"), build, path, keys).collect()}
    full = build(frame(after)).withColumn("date", F.to_date("timestamp_hour"))
    names = sorted(full.columns)
    rows = lambda df: sorted(map(str, df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in sorted(df.dtypes)]).collect()))
    assert rows(spark.read.parquet(path).select(*names)) == rows(full.select(*names))
    assert min(days) == dt.date(2024, 1, 31) and max(days) == dt.date(2024, 4, 10)
    untouched = {d for d in stamp if dt.date.fromisoformat(d[5:]) not in days}
    assert len(untouched) > 20 and all(os.path.getmtime(f"{path}/{d}") == stamp[d] for d in untouched)
