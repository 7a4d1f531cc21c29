"""Landing-file ingestion: CSV/JSON readers, multi-file union, contracts (survey 2.A)."""

from __future__ import annotations

import re

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clean_header(name: str) -> str:
    """Strip BOM, surrounding blanks and embedded newlines from a CSV header."""
    return name.replace("﻿", "").replace("\r", " ").replace("\n", " ").strip()


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             encodings: Sequence[str] = ("UTF-8", "ISO-8859-1"), drop_too_long: bool = True,
             sep: str = ",", **options) -> DataFrame:
    """Header CSV read with encoding fallback and lenient bad-line handling.

    * UTF-8 unless some line is not valid UTF-8, then the fallback encoding
      (one extra scan that stops at the first bad line).
    * Headers lose BOM, blanks and embedded newlines.
    * PERMISSIVE parse: short rows are kept with nulls; rows with more fields
      than the header are dropped, as a reader that skips bad lines would.
    Without ``schema`` every column is read as text; cast with ``try_cast``.
    """
    chosen = encodings[-1]
    if encodings[0].replace("-", "").upper() == "UTF8" and len(encodings) > 1:
        # the text source keeps raw bytes, so invalid UTF-8 is detectable per line
        lines = spark.read.text(path)
        if lines.filter(~F.is_valid_utf8("value")).limit(1).count() == 0:
            chosen = encodings[0]
    else:
        chosen = encodings[0]
    base = spark.read.option("header", True).option("encoding", chosen).option("sep", sep)
    for k, v in options.items():
        base = base.option(k, v)
    header = base.csv(path).columns
    if schema is None:
        schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    with_bad = T.StructType(list(schema.fields) + [T.StructField("_corrupt_record", T.StringType())])
    df = (base.schema(with_bad).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_corrupt_record").csv(path))
    if drop_too_long:
        split_re = re.escape(sep) + '(?=(?:[^"]*"[^"]*")*[^"]*$)'
        n = len(schema.fields)
        df = df.filter(F.col("_corrupt_record").isNull()
                       | (F.size(F.split(F.col("_corrupt_record"), split_re)) <= n))
    return df.drop("_corrupt_record").toDF(*[clean_header(c) for c in schema.fieldNames()])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Parquet sink; with ``partition_by`` only the partitions present are replaced."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    w.parquet(path)


def missing_partitions(spark: SparkSession, path: str, wanted: DataFrame, partition_by: Sequence[str],
                       complete: Column | None = None) -> DataFrame:
    """Rows of ``wanted`` (one per partition) that the table at ``path`` lacks.

    ``complete`` may narrow what counts as present (say, years before the
    current one); a table that does not exist yet has no partition.
    """
    keys = list(partition_by)
    try:
        have = spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001 - only a missing path means an empty table
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return wanted
    have = have.filter(complete) if complete is not None else have
    return wanted.join(have.select(*keys).distinct(), keys, "left_anti")


def union_first_wins(frames: Sequence[DataFrame], key: Sequence[str] | str, rank_col: str | None = None,
                     order_by: Sequence[str] = ()) -> DataFrame:
    """Union by name (missing columns → null); per key the earliest frame wins.

    Within a frame the row that is first by ``order_by`` wins (a line number,
    an ingestion time); rows that tie there too are ordered by their values,
    so the result never depends on partitioning.  A declarative ``min_by``
    aggregate instead of ``dropDuplicates`` (which keeps an arbitrary row):
    partial aggregation runs before the shuffle, so a hot key costs one row
    per map task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    tagged = [f.withColumn("_src_rank", F.lit(i)) for i, f in enumerate(frames)]
    u = tagged[0]
    for f in tagged[1:]:
        u = u.unionByName(f, allowMissingColumns=True)
    value_cols = [c for c in u.columns if c not in keys and c != "_src_rank"]
    # values without an order of their own (maps, variants) are compared as text
    plain = [F.to_json(F.struct(c)) if "map<" in t or t == "variant" else F.col(c)
             for c, t in u.dtypes if c in value_cols and c not in order_by]
    first = F.struct(F.col("_src_rank"), *[F.col(c) for c in order_by], *plain)
    best = u.groupBy(*keys).agg(F.min_by(F.struct(*value_cols, "_src_rank"), first).alias("_w"))
    out = best.select(*keys, *[F.col("_w")[c].alias(c) for c in value_cols],
                      F.col("_w")["_src_rank"].alias(rank_col or "_src_rank"))
    return out if rank_col else out.drop("_src_rank")


def json_props(df: DataFrame, json_col: str, fields: dict[str, str]) -> DataFrame:
    """Flatten top-level JSON object fields into typed columns."""
    return df.withColumns({name: F.get_json_object(F.col(json_col), f"$.{name}").try_cast(t)
                           for name, t in fields.items()})


def json_column_arrays(df: DataFrame, json_col: str, block: str, arrays: dict[str, str],
                       keep: Sequence[str] = ()) -> DataFrame:
    """``{block: {a: [...], b: [...]}}`` payloads → one row per array position."""
    fields = ", ".join(f"`{k}`: array<{v}>" for k, v in arrays.items())
    schema = f"`{block}` struct<{fields}>"
    parsed = df.select(*keep, F.from_json(F.col(json_col), schema).alias("_j"))
    zipped = parsed.select(*keep, F.arrays_zip(*[F.col(f"_j.{block}.{k}").alias(k) for k in arrays]).alias("_z"))
    return zipped.select(*keep, F.inline("_z"))


def json_event_list(df: DataFrame, json_col: str, path: Sequence[str] = ("_embedded", "events"),
                    name: str = "name", date: Sequence[str] = ("dates", "start", "localDate"),
                    keep: Sequence[str] = ()) -> DataFrame:
    """``{a: {b: [{name, x: {y: {date}}}]}}`` payloads → one row (event_date, event_name) per event.

    Events without a date are left out; a missing list gives no row.
    """
    inner = "string"
    for part in reversed(date):
        inner = f"struct<`{part}`: {inner}>"
    schema = f"array<struct<`{name}`: string, {inner[len('struct<'):-1]}>>"
    for part in reversed(path):
        schema = f"struct<`{part}`: {schema}>"
    rows = df.select(*keep, F.explode(_field(F.from_json(F.col(json_col), schema), path)).alias("_e"))
    out = rows.select(*keep, F.to_date(_field(F.col("_e"), date).try_cast("date")).alias("event_date"),
                      F.trim(F.col("_e")[name]).alias("event_name"))
    return out.filter(F.col("event_date").isNotNull())


def _field(c: Column, path: Sequence[str]) -> Column:
    for part in path:
        c = c.getField(part)
    return c


@dataclass
class Rule:
    column: str
    required: bool = False
    dtype: str | None = None
    range: tuple[float, float] | None = None
    values: Sequence[str] | None = None
    on_the_hour: bool = False
    extra: dict = field(default_factory=dict)


def contract_violations(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One pass over the table: violation counts per (column, check).

    Missing columns and type mismatches are schema checks reported with count
    -1 (no scan needed); value checks are ``count_if`` aggregates in one job.
    """
    dtypes = dict(df.dtypes)
    checks: list[tuple[str, str, Column | int]] = []
    for r in rules:
        if r.column not in dtypes:
            if r.required:
                checks.append((r.column, "missing", -1))
            continue
        c = F.col(r.column)
        if r.dtype and dtypes[r.column] != r.dtype:
            checks.append((r.column, "type", -1))
        if r.required:
            checks.append((r.column, "null", F.count_if(c.isNull())))
        if r.range is not None:
            lo, hi = r.range
            checks.append((r.column, "range", F.count_if((c < lo) | (c > hi))))
        if r.values is not None:
            checks.append((r.column, "values", F.count_if(~c.isin(*r.values))))
        if r.on_the_hour:
            checks.append((r.column, "on_the_hour",
                           F.count_if((F.minute(c) != 0) | (F.second(c) != 0))))
    agg_cols = [(i, x) for i, (_, _, x) in enumerate(checks) if not isinstance(x, int)]
    if agg_cols:
        aggs = df.agg(*[x.cast("long").alias(f"c{i}") for i, x in agg_cols])
    else:
        aggs = df.sparkSession.range(1).select()
    stack_items = []
    for i, (colname, check, x) in enumerate(checks):
        val = F.col(f"c{i}") if not isinstance(x, int) else F.lit(x).cast("long")
        stack_items.append(F.struct(F.lit(colname).alias("column_name"), F.lit(check).alias("check_name"),
                                    val.alias("n_violations")))
    return aggs.select(F.inline(F.array(*stack_items)))
