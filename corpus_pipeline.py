"""Training-corpus pipeline: documents through the stages below, each written and reread.

Every stage is a function of (spark, docs, sf_dir); ``docs`` is what its
predecessor kept.  All but the last return the columns of ``documents``.

1. toxicity: documents that the conditional random field scores 0.5 or more go.
2. line_dedup: later occurrences of repeated three-line windows are cut out;
   ``n_chars`` follows the text.  No document goes, emptied ones included.
3. ngram_jaccard: of each component of near copies the smallest doc_id stays, and
   one row of those with the same doc_id and text; different texts of one doc_id are
   documents of their own.  Documents without words or doc_id stay.
4. decontamination: documents that hold a benchmark item go, those without doc_id
   too; another text of the same doc_id stays.
5. packing: the pieces of what is left, in sequences of at most 2048 tokens.

Null texts pass every stage (packing: a single end token); extra columns are
kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftcast.llm import decontaminate, jaccard, line_dedup, packing, toxicity
from shiftcast.llm.common import keep_ids, store, table
from shiftcast.llm.queries import held_out, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    names = docs.columns
    # scored under names of its own, whatever other columns there are
    plain = docs.toDF(*["text" if c.lower() == "text" else f"c{i}" for i, c in enumerate(names)])
    scored = toxicity.score(plain, model)
    return scored.where("score < 0.5").drop("score", "spans").toDF(*names)


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs.drop("n_lines", "n_removed")).select(*[c for c in docs.columns])
    if "n_chars" not in docs.columns:
        return out
    kind = docs.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    known = docs.where("doc_id is not null")
    ids = known.select("doc_id")
    if ids.distinct().count() == ids.count():
        return keep_ids(docs, _copies(docs), "doc_id", "left_anti").select(*docs.columns)
    # a key of its own for each doc_id and text, in the order of doc_id
    by = ["doc_id", "text_1", "text_2"]
    rows = known.select("doc_id", F.xxhash64("text").alias("text_1"), F.xxhash64(F.lit(1), "text").alias("text_2"),
                        F.struct(*docs.columns).alias("row")).dropDuplicates(by)
    keyed = store(rows.orderBy(*by).select(F.monotonically_increasing_id().alias("key"), "row"), "keyed")
    copies = _copies(keyed.select(F.col("key").alias("doc_id"), "row.text")).withColumnRenamed("doc_id", "key")
    return keep_ids(keyed, copies, "key", "left_anti").select("row.*").unionByName(docs.where("doc_id is null"))


def _copies(docs: DataFrame) -> DataFrame:
    """doc_id of every document that is a near copy of one with a smaller doc_id in its component."""
    found = store(jaccard.similarity_components(docs), "components")
    return store(found.where("doc_id <> component_id").select("doc_id"), "copies")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # by doc_id and text: a doc_id may be null or have several texts
    key = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64("text").cast("string"))
    rows = docs.select(key.alias("doc_id"), "text", F.struct(*docs.columns).alias("row"))
    found = decontaminate.leaks(rows.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return keep_ids(rows, store(found.select("doc_id").distinct(), "leaks"), "doc_id", "left_anti").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_lines),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: No stage but line_dedup can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
