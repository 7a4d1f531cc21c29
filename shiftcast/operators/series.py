"""Ordered operations on one long series without a one-task sort (survey D2, D4, E4, E5).

A series without keys is cut into chunks of the calendar (``CHUNK_DAYS`` days, so a chunk
is bounded whatever the length of the series).  What an operation needs from before or
after a chunk is carried by a table of one row a chunk, which is bounded by the calendar:

* fills carry the last and first known value of each chunk;
* lags and rolling frames number the rows (rows of a chunk, plus those of the chunks
  before), deal them in blocks of ``BLOCK`` rows, and repeat the last ``reach`` rows of a block
  at the head of the next one.

Everything is a DataFrame function; every window is partitioned.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK_DAYS = 28
BLOCK = 4096


def _chunk(order: str) -> Column:
    return F.coalesce(F.floor(F.datediff(F.to_date(F.col(order)), F.lit("1970-01-01").cast("date")) / CHUNK_DAYS).cast("int"), F.lit(-1_000_000))


def _chunks() -> WindowSpec:
    """Over the table of chunks: one group of one row for each chunk of the calendar."""
    return Window.partitionBy("_series").orderBy("_chunk")


def fill(df: DataFrame, cols: Sequence[str], order: str, forward: bool = True, backward: bool = True) -> DataFrame:
    """Nulls take the last known value before them, then (or else) the next one after them.

    Rows should have different ``order`` values."""
    cols = list(cols)
    own = Window.partitionBy("_chunk").orderBy(order)
    back, ahead = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(0, Window.unboundedFollowing)
    rows = df.withColumn("_chunk", _chunk(order))
    ends = []
    for i, c in enumerate(cols):
        known = F.when(F.col(c).isNotNull(), F.col(order))
        ends += [F.max_by(c, known).alias(f"_l{i}"), F.min_by(c, known).alias(f"_f{i}")]
    per = rows.groupBy("_chunk").agg(*ends).withColumn("_series", F.lit(0))
    earlier, later = _chunks().rowsBetween(Window.unboundedPreceding, -1), _chunks().rowsBetween(1, Window.unboundedFollowing)
    carries = per.select("_chunk", *[x for i in range(len(cols)) for x in (F.last(f"_l{i}", ignorenulls=True).over(earlier).alias(f"_p{i}"),
                                                                         F.first(f"_f{i}", ignorenulls=True).over(later).alias(f"_n{i}"))])
    got = rows
    got = got.withColumns({f"_b{i}": F.last(c, ignorenulls=True).over(back) for i, c in enumerate(cols) if forward}
                          | {f"_a{i}": F.first(c, ignorenulls=True).over(ahead) for i, c in enumerate(cols) if backward})
    got = got.join(F.broadcast(carries), "_chunk")  # one row for each chunk of the calendar
    filled = {}
    for i, c in enumerate(cols):
        parts = ([F.col(f"_b{i}"), F.col(f"_p{i}")] if forward else [F.col(c)]) + ([F.col(f"_a{i}"), F.col(f"_n{i}")] if backward else [])
        filled[c] = F.coalesce(*parts)
    return got.withColumns(filled).select(*df.columns)


def numbered(df: DataFrame, order: str, out: str = "_at") -> DataFrame:
    """Each row's place (from 0) in the series."""
    rows = df.withColumn("_chunk", _chunk(order))
    per = rows.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_n")).withColumn("_series", F.lit(0))
    before = F.coalesce(F.sum("_n").over(_chunks().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = Window.partitionBy("_chunk").orderBy(order)
    return (rows.withColumn("_in", F.row_number().over(own) - 1).join(F.broadcast(per.select("_chunk", before.alias("_before"))), "_chunk")
            .withColumn(out, F.col("_before") + F.col("_in")).select(*df.columns, out))


def windowed(df: DataFrame, columns: Callable[[WindowSpec], dict[str, Column]], order: str, reach: int) -> DataFrame:
    """``df`` with window columns that look back at most ``reach`` rows.

    ``columns`` gets the ordered window to build them over."""
    block = max(BLOCK, 2 * reach)
    at = F.col("_at")
    own = F.floor(at / block)
    rows = numbered(df, order).withColumn("_own", own)
    dealt = rows.withColumn("_block", F.explode(F.when(at % block >= block - reach, F.array(F.col("_own"), F.col("_own") + 1)).otherwise(F.array("_own"))))
    made = columns(Window.partitionBy("_block").orderBy("_at"))
    done = dealt.withColumns(made).where(F.col("_block") == F.col("_own"))
    return done.select(*[c for c in df.columns if c not in made], *made)
