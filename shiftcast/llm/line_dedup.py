"""Line deduplication by overlapping three-line windows, in DataFrame functions only.

Every run of ``WINDOW`` consecutive lines of a text is hashed (twice 64 bits).  A
window whose hashes occur more than once in the whole table is a repeat; its
first occurrence (smallest doc_id, then position) stays and the lines that later
ones cover are removed, overlapping ones merged.  Whatever is removed has an
earlier copy that stays, for the first window with a given line is never a later
occurrence.

Data flow: lines are split and hashed inside their row; only ``(hashes, doc_id,
position)`` goes through a shuffle, with map-side minima, so a window that fills
a third of all documents is one row per map task there.  The join that brings
positions back to the windows is a plain equi-join whose hot keys Spark can split.

Defined results: null text stays null and counts 0 lines; an empty text is one
empty line; texts of fewer than three lines have no window and stay; a window of
blank lines only is no window.  Repeated rows (same doc_id and text) count as one
and are treated alike; rows with the same doc_id but different texts are told
apart by the text; null doc_ids come last in the order.  Extra columns pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftcast.llm.common import store

WINDOW = 3
_END = 2**31 - 1


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_key", "pos")


def repeated_positions(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, covered): sorted line positions that later occurrences cover."""
    lines = (docs.where(F.col("text").contains("\n"))
             .select("doc_id", F.xxhash64("text").alias("text_key"), F.transform(_lines(F.col("text")), lambda x: F.struct(
                 F.xxhash64(x).alias("a"), F.xxhash64(F.lit("second"), x).alias("b"),
                 x.rlike(r"[^ \t\r]").alias("full"))).alias("l")))
    at = [lambda i, k=k: F.element_at(F.col("l"), i + k) for k in range(window)]
    rows = (lines.where(F.size("l") >= window)
            .select("doc_id", "text_key", F.explode(F.transform(
                F.sequence(F.lit(1), F.size("l") - (window - 1)),
                lambda i: F.struct((i - 1).alias("pos"), F.xxhash64(*[f(i)["a"] for f in at]).alias("h1"),
                                   F.xxhash64(*[f(i)["b"] for f in at]).alias("h2"),
                                   F.greatest(*[f(i)["full"] for f in at]).alias("full")))).alias("w"))
            .select("doc_id", "text_key", "w.*").where("full").drop("full"))
    rows = store(rows, "windows")
    first = rows.groupBy("h1", "h2").agg(F.min(_place()).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = rows.join(first, ["h1", "h2"]).where(_place() != F.col("first"))
    return (later.groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("starts"))
            .select("doc_id", "text_key", F.array_sort(F.array_distinct(F.flatten(F.transform(
                "starts", lambda p: F.sequence(p, p + (window - 1)))))).alias("covered")))


def dedup_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with ``text`` cut, and ``n_lines`` and ``n_removed`` (lines before, lines taken out)."""
    covered = repeated_positions(docs, window)
    # stretches of kept lines between covered positions
    gaps = covered.select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.size("covered").alias("_n"),
        F.filter(F.zip_with(F.concat(F.array(F.lit(-1)), "covered"), F.concat("covered", F.array(F.lit(_END))),
                            lambda a, b: F.struct((a + 2).alias("at"), (b - a - 1).alias("n"))),
                 lambda g: g["n"] > 0).alias("_gaps"))
    split = docs.select(*[_lines(F.col("text")).alias("_l") if c == "text" else F.col(c) for c in docs.columns],
                        F.xxhash64("text").alias("_h"))
    out = split.join(gaps, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_key")), "left")
    kept = F.flatten(F.transform("_gaps", lambda g: F.slice(F.col("_l"), g["at"], g["n"])))
    text = (F.when(F.col("_l").isNull(), F.lit(None).cast("string"))
            .when(F.col("_gaps").isNull(), F.array_join("_l", "\n")).otherwise(F.array_join(kept, "\n")))
    return out.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns],
                      F.when(F.col("_l").isNull(), 0).otherwise(F.size("_l")).cast("long").alias("n_lines"),
                      F.coalesce("_n", F.lit(0)).cast("long").alias("n_removed"))
