"""Mixing sources to target weights, exactly and in a hash-random order.

Every source has a share of all words by its weight.  A source gives at most
``REPEATS`` times what it has; what is beyond that is dealt to the others by their
weights until none is above.  Within a source every document gets a hash-random
key, the documents are sorted by it across tasks (``common.running_sum``), and the
running sum of their sizes says where the source's budget ends: whole passes over
the source first, then documents in the order of their keys, and of the one at the
cut its first words only, so a source gives the whole part of its target to the word.

Data flow: texts are read once for (size, key); the sort and the running sums are
on rows of a few numbers.  A source with a third of all rows takes a third of the
ranges.  The levels of the targets are found by sums over the table of sources,
two numbers a round; no list of sources reaches the driver.  Sources are joined
back broadcast below a counted size, otherwise shuffled.

Defined results: null texts and texts without words have size 0 and nothing is
taken of them; a null source is a source of its own, ordered last; repeated rows
are documents each for itself (rows that agree in doc_id, source and text are
interchangeable); without any word all targets are 0.  Extra columns are not read,
so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftcast.llm.common import BROADCAST_IDS, running_sum, store

WEIGHTS = (1, 2, 3)
REPEATS = 3
WORD = r"[^\x20\x09-\x0D]+"

_SOURCE = ["none", "name"]  # whether the source is null, and its name


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, source, none, name, key, text): the key is a hash of the seed, doc_id and text."""
    text = F.coalesce("text", F.lit(""))
    key = F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("/"), text))
    return docs.select("doc_id", "source", F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"),
                       key.alias("key"), text.alias("text"))


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, words: int | None = None, repeats: int = REPEATS) -> DataFrame:
    """``sources(none, name, words)`` with ``target`` (double) and ``budget``, its whole part.

    ``words`` is what all sources give together (None: as many as they have).  With
    ``rest`` words left for sources of weights ``open``, those that ``repeats`` times
    their words fall short of their part of it give that; the others share the rest anew.
    """
    placed = running_sum(store(sources, "sources"), [], _SOURCE, F.lit(1), "place")
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    placed = store(placed.withColumn("weight", F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int"))), "weights")
    big = "decimal(38,0)"
    full = (F.col("words") * repeats).cast(big)
    first = placed.agg(F.sum("words").alias("words"), F.sum("weight").alias("weight")).first()
    total = int(first["words"] or 0) if words is None else words
    rest, open_ = total, int(first["weight"] or 0)
    while True:
        short = full * F.lit(open_).cast(big) < F.lit(rest).cast(big) * F.col("weight")
        now = placed.agg(F.sum(F.when(short, full)).alias("given"), F.sum(F.when(~short, F.col("weight"))).alias("open")).first()
        before, rest, open_ = (rest, open_), total - int(now["given"] or 0), int(now["open"] or 0)
        if (rest, open_) == before or not open_:
            break
    if not open_:  # every source gives all it may
        return placed.select(*_SOURCE, "words", full.cast("double").alias("target"), full.cast("long").alias("budget"))
    part = F.lit(rest).cast(big) * F.col("weight")
    return placed.select(*_SOURCE, "words", F.when(short, full.cast("double")).otherwise(part.cast("double") / open_).alias("target"),
                         F.when(short, full.cast("long")).otherwise(F.floor(part / F.lit(open_)).cast("long")).alias("budget"))


def plan_mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, words: int | None = None, repeats: int = REPEATS, seed: int = 42) -> DataFrame:
    """One row for each row of ``docs(doc_id, source, text)``:

    doc_id, source, key, size, source_size, target, passes (times it is taken whole),
    cut (its first words that are taken once more) and taken (words in all)."""
    size = F.regexp_count("text", F.lit(WORD)).cast("long")
    # ``row`` parts rows that agree in everything, so that many of them need not be one range
    sized = store(_keyed(docs, seed).withColumn("size", size).withColumn("row", F.monotonically_increasing_id()).drop("text"), "sized")
    sums = targets(sized.groupBy(*_SOURCE).agg(F.sum("size").alias("words")), weights, words, repeats)
    sums = store(sums.withColumnRenamed("words", "source_size"), "targets")
    if sums.count() <= BROADCAST_IDS // 10:
        sums = F.broadcast(sums)
    rows = running_sum(sized, _SOURCE, ["key", "row"], F.col("size"), "before").join(sums, _SOURCE)
    passes = F.coalesce(F.expr("budget div nullif(source_size, 0)"), F.lit(0))
    rows = rows.withColumn("passes", passes).withColumn("_rest", F.col("budget") - F.col("passes") * F.col("source_size"))
    cut = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("before"))).cast("long")
    return rows.select("doc_id", "source", "key", "size", "source_size", "target", "passes", cut.alias("cut"),
                       (F.col("passes") * F.col("size") + cut).alias("taken"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed documents: (doc_id, source, pass, key, words, text), a row for each time that one is taken.

    Read it in the order of (pass, key) for a random order.  Of the document at a
    source's cut ``text`` has the first words, parted by blanks.  Arguments are
    those of :func:`plan_mix`.
    """
    plan = plan_mix(docs, **how).where("taken > 0").withColumn("none", F.col("source").isNull()).withColumn("name", F.coalesce("source", F.lit("")))
    texts = _keyed(docs, how.get("seed", 42)).select(*_SOURCE, "key", "text").dropDuplicates([*_SOURCE, "key"])
    took = plan.join(texts, [*_SOURCE, "key"])
    times = F.sequence(F.lit(1).cast("long"), F.col("passes") + F.when(F.col("cut") > 0, 1).otherwise(0))
    took = took.withColumn("pass", F.explode(times))
    part = (F.col("pass") > F.col("passes")) & (F.col("cut") < F.col("size"))
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.col("cut").cast("int")), " ")
    return took.select("doc_id", "source", "pass", "key", F.when(part, F.col("cut")).otherwise(F.col("size")).alias("words"),
                       F.when(part, head).otherwise(F.col("text")).alias("text"))
