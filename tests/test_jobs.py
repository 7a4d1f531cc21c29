import datetime as dt

from pyspark.sql import functions as F

from shiftcast.plans.jobs import refresh, run_stage, sample_sources
from shiftcast.sources.ingest import missing_partitions, write_parquet

SF = "/root/testdata/sf0.001"


def test_incremental_year_partitions(spark, tmp_dir):
    path = f"{tmp_dir}/footfall"
    rows = [(2023, dt.date(2023, 5, 1), 1), (2024, dt.date(2024, 5, 1), 2)]
    write_parquet(spark.createDataFrame(rows, "year int, date date, n int"), path, partition_by=["year"])
    # re-read only the current year: the completed year keeps its files
    write_parquet(spark.createDataFrame([(2024, dt.date(2024, 5, 2), 9)], "year int, date date, n int"), path,
                  partition_by=["year"])
    got = sorted((r.year, r.n) for r in spark.read.parquet(path).collect())
    assert got == [(2023, 1), (2024, 9)]


def test_refresh_job_writes_every_stage(spark, tmp_dir):
    out = refresh(spark, sample_sources(spark, SF), tmp_dir, keys=["l_suppkey"])
    assert {k: r.status for k, r in out.items()} == dict.fromkeys(
        ["panel", "enrichment", "footfall", "failte", "weather", "features"], "written")
    feats = spark.read.parquet(out["features"].path)
    assert feats.count() > 0 and "orders_count_roll_mean_168" in feats.columns
    enr = spark.read.parquet(out["enrichment"].path)
    assert enr.filter(F.col("bank_holiday_flag") == 1).count() > 0


def test_source_that_breaks_mid_read_keeps_the_last_good_table(spark, tmp_dir):
    path, src = f"{tmp_dir}/t", f"{tmp_dir}/src"
    rows = spark.createDataFrame([(dt.date(2024, 1, 1), 1), (dt.date(2024, 1, 2), 2)], "date date, n int")
    rows.repartition(2).write.parquet(src)
    load = lambda: spark.read.schema("date date, n int").parquet(src)
    assert run_stage(spark, load, path).status == "written"
    with open(f"{src}/part-99999.parquet", "wb") as f:  # opened like the others, unreadable when it is its turn
        f.write(b"no parquet")
    r = run_stage(spark, load, path)
    assert r.status == "kept" and r.error
    assert sorted(x.n for x in spark.read.parquet(path).collect()) == [1, 2]
    assert run_stage(spark, load, f"{tmp_dir}/other").status == "missing"
    out = refresh(spark, {"panel": lambda: spark.read.parquet("/nonexistent/x")}, f"{tmp_dir}/none")
    assert {k: v.status for k, v in out.items()} == {"panel": "missing", "features": "missing"}


def test_missing_partitions(spark, tmp_dir):
    wanted = spark.createDataFrame([(2022,), (2023,), (2024,)], "year int")
    assert missing_partitions(spark, f"{tmp_dir}/none", wanted, ["year"]).count() == 3
    write_parquet(spark.createDataFrame([(2023, 1), (2024, 2)], "year int, n int"), f"{tmp_dir}/y", partition_by=["year"])
    left = missing_partitions(spark, f"{tmp_dir}/y", wanted, ["year"], complete=F.col("year") < 2024)
    assert sorted(r.year for r in left.collect()) == [2022, 2024]
