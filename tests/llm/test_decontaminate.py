import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from shiftcast.llm import decontaminate
from shiftcast.llm.common import BATCH_BYTES, span_hashes
from shiftcast.llm.decontaminate import leaks


def _rows(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.choice([2, 3, 5])))
    common = [word() for _ in range(30)]
    say = lambda n: [rng.choice(common) if rng.random() < .4 else word() for _ in range(n)]
    items = [(k, " ".join(say(rng.randrange(6, 40))) + ". " + " ".join(say(rng.randrange(2, 12))) + ".") for k in range(60)]
    docs, want = [], set()
    for i in range(300):
        w = say(rng.randrange(1, 900))
        if i % 3 == 0:
            for k in rng.sample(range(60), rng.choice([1, 1, 3])):
                at = rng.randrange(len(w) + 1)
                text = items[k][1]
                w[at:at] = [text.upper() if rng.random() < .3 else text.replace(" ", "\n") if rng.random() < .3 else text]
                want.add((i, k))
        docs.append((i, " ".join(w)))
    return docs, items, want


@pytest.mark.parametrize("shard_terms", [10**6, 400])
def test_finds_planted_items_and_leaves_clean_documents(spark, shard_terms):
    docs, items, want = _rows()
    d = spark.createDataFrame([(i, t, 0) for i, t in docs] + [(990, None, 0), (991, "", 0)], "doc_id long, text string, score int").repartition(3)
    b = spark.createDataFrame([*items, (None, None), (77, ""), (78, "...")], "item_id long, text string")
    got = leaks(d, b, shard_terms=shard_terms).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert all(r.score >= 0.6 for r in got)


def test_half_an_item_is_no_leak(spark):
    b = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta. iota kappa lambda")], "item_id long, text string")
    d = spark.createDataFrame([(1, "x alpha beta gamma delta epsilon zeta eta theta y"), (2, "Alpha, beta gamma delta epsilon zeta eta theta? Iota kappa LAMBDA!")],
                              "doc_id long, text string")
    assert [r.doc_id for r in leaks(d, b).collect()] == [2]


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert leaks(d, b.where("false")).count() == 0
    assert leaks(d.where("false"), b).count() == 0
    assert leaks(d, b).count() == 1


def test_batches_are_bounded_by_bytes(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)

    def sizes(*_):
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0).slice(0, 1), pa.array([1]), *(pa.array([float(b.nbytes)]) for _ in range(3)), pa.array([b.num_rows])],
                                                 ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"])
        return run

    monkeypatch.setattr(decontaminate, "_leak_rows", sizes)
    d = spark.range(0, 3000, 1, 1).selectExpr("id doc_id", "repeat('some words ', 400) text")
    got = leaks(d, spark.createDataFrame([(1, "alpha beta. gamma")], "item_id long, text string")).collect()
    assert sum(r.first_word for r in got) == 3000
    assert max(r.score for r in got) < 1.1 * BATCH_BYTES
    assert spark.conf.get(key) == str(BATCH_BYTES)
    spark.conf.set(key, "1000000")  # a bound of the session's own stays
    got = leaks(d, spark.createDataFrame([(1, "alpha beta. gamma")], "item_id long, text string")).collect()
    spark.conf.unset(key)
    assert sum(r.first_word for r in got) == 3000 and max(r.score for r in got) < 1.1e6


def test_memory_of_a_step_is_bounded():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(3000)]
    items = [(k, k, " ".join(rng.sample(words, 30))) for k in range(200)]
    rows = pa.Table.from_batches(decontaminate._term_rows(iter([pa.RecordBatch.from_arrays(
        [pa.array([k for k, _, _ in items]), pa.array([t for _, _, t in items])], ["row", "text"])])))
    index = decontaminate.Index(items, rows["term"].to_numpy().view(np.uint64), rows["row"].to_numpy(), np.full(rows.num_rows, 1 / 30))
    texts = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(2000)]
    texts[1500] += " " + items[7][2]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(texts)], ["doc_id", "text"])
    run = decontaminate._leak_rows(SimpleNamespace(value=index), 128, 0.6, 0.5, pa.int64())
    span_hashes(*(np.zeros(n, t) for n, t in ((1, np.uint8), (0, np.int64), (0, np.int64))))  # the powers are there
    tracemalloc.start()
    got = [r for b in run(iter([batch])) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(1500, 7)]
    assert batch.nbytes > 3_500_000 and peak < 60_000_000
