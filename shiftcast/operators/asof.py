"""Order statistics of all earlier rows (survey E6, G6), block by block.

Rows of a group are dealt in blocks of ``BLOCK`` rows in order.  A block knows the values of
all blocks before it, sorted, once; for a row of the block they are met by the few values
between the block's head and the row.  With ``e`` such values the k-th smallest of both is
among the sorted values at places k - e to k and these, so a row sorts at most 2 ``BLOCK`` + 1
values whatever the length of its history, and no frame grows with the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 64


def _kth(before: Column, own: Column, k: Column) -> Column:
    """k-th smallest (from 0) of the sorted array ``before`` and the array ``own`` together."""
    first = F.greatest(k - F.size(own), F.lit(0))
    near = F.slice(before, (first + 1).cast("int"), (k - first + 1).cast("int"))
    return F.element_at(F.array_sort(F.concat(near, own)), (k - first + 1).cast("int"))


def asof_quantiles(df: DataFrame, group: Sequence[str], order: str, value: str, qs: Sequence[float], out: str, count: str | None = None,
                   block: int | None = None) -> DataFrame:
    """``df`` with ``out``: the quantiles (linear interpolation, an array) of the non-null ``value`` of the group's earlier rows.

    Null without such a value; ``count`` names a column for their number.  Rows of a group have different ``order``.
    """
    group, block = list(group), block or BLOCK
    at = F.row_number().over(Window.partitionBy(*group).orderBy(order)) - 1
    rows = df.withColumn("_block", F.floor(at / block)).withColumn("_v", F.col(value).cast("double"))
    keyed = rows.select(*group, "_block", F.col(order).alias("_o"), "_v", F.struct(*df.columns).alias("_row"))
    blocks = keyed.groupBy(*group, "_block").agg(F.array_sort(F.collect_list(F.struct("_o", "_v", "_row"))).alias("_rows"))
    blocks = blocks.withColumn("_own", F.filter(F.transform("_rows", lambda r: r["_v"]), lambda v: v.isNotNull()))
    earlier = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.array_sort(F.flatten(F.collect_list("_own").over(earlier))))
    each = blocks.select(*group, "_before", "_rows", F.posexplode("_rows").alias("_i", "_r"))
    seen = F.filter(F.transform(F.slice(F.col("_rows"), F.lit(1), F.col("_i")), lambda r: r["_v"]), lambda v: v.isNotNull())
    each = each.select("_before", "_r", seen.alias("_seen")).withColumn("_n", F.size("_before") + F.size("_seen"))
    found = []
    for q in qs:
        place = F.lit(float(q)) * (F.col("_n") - 1)
        low, high = F.floor(place), F.ceil(place)
        a, b = _kth(F.col("_before"), F.col("_seen"), low), _kth(F.col("_before"), F.col("_seen"), high)
        found.append(F.when((low == high) | (a == b), a).otherwise((high - place) * a + (place - low) * b))
    made = each.withColumn("_q", F.when(F.col("_n") > 0, F.array(*found)))
    return made.select("_r._row.*", F.col("_q").alias(out), *([F.col("_n").cast("long").alias(count)] if count else []))
