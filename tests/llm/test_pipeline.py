import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline as P  # noqa: E402


@pytest.fixture()
def corpus(spark, tmp_dir):
    """Small tables with planted toxic documents, near copies, repeated passages and benchmark items."""
    rng = random.Random(11)
    say = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    lines = lambda n: "\n".join(" ".join(say(9)) for _ in range(n))
    docs, labels = [], []
    for i in range(300):
        t = lines(rng.randrange(1, 12))
        if i % 3 == 0:
            t += " " + " ".join(rng.choice(["vile", "rotten", "foul"]) for _ in range(2))
        docs.append((i, t))
        if i < 260:
            labels.append((i, int(i % 3 == 0)))
    toxic = {i for i in range(300) if i % 3 == 0}
    base = " ".join(say(120))
    near = list(range(400, 410))
    for i in near:
        w = base.split()
        w[rng.randrange(120)] = f"x{i}"
        docs.append((i, " ".join(w)))
    passage = lines(6)
    for i in (500, 501):
        docs.append((i, lines(2) + "\n" + passage + "\n" + lines(2)))
    item = " ".join(say(14)) + ". " + " ".join(say(5)) + "."
    docs.append((600, lines(3) + " " + item + " " + lines(2)))
    docs += [(700, None), (701, ""), (702, "short one")]
    d = spark.createDataFrame([(i, t, "en", "src0", len(t or ""), "kept") for i, t in docs],
                              "doc_id long, text string, lang string, source string, n_chars long, score string")
    d.write.parquet(f"{tmp_dir}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_dir}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_dir}/benchmark.parquet")
    return tmp_dir, dict(docs), toxic, near, passage, item


def test_stages_in_turn(spark, corpus):
    folder, texts, toxic, near, passage, item = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in P.STAGES[:-1]:
        docs = P.store(stage(spark, docs, folder), name)
        assert docs.columns == columns
        seen.append({r.doc_id: r for r in docs.collect()})
    clean, cut, single, last = seen
    assert set(clean) == set(texts) - toxic
    assert set(cut) == set(clean) and all(r.n_chars == len(r.text) for r in cut.values() if r.text is not None)
    assert passage in cut[500].text and passage.split("\n")[2] not in cut[501].text and cut[700].text is None
    assert all(cut[i].text == texts[i] for i in cut if i != 501)
    assert set(cut) - set(single) == set(near[1:])
    assert set(single) - set(last) == {600}
    assert all(r.score == "kept" for r in last.values())
    packed = P.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in packed} == set(last)
    assert len({r.sequence_id for r in packed}) <= -(-sum(r.length for r in packed) // 2048) + 1


def test_run_equals_its_stages(spark, corpus):
    folder = corpus[0]
    rows = P.run(spark, folder)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "decontamination", "packing"]
    ids = {r.doc_id for r in rows.collect()}
    assert 700 in ids and 600 not in ids and not ids & corpus[2]


def test_odd_ids_lose_no_text_and_keep_no_leak(spark, tmp_dir):
    rng = random.Random(5)
    say = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    item, base = say(14) + ". " + say(5) + ".", say(120)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_dir}/benchmark.parquet")
    one, two, bare = say(60), say(60), say(40)
    near = base.split()
    near[7] = "changed"
    rows = [(1, one), (1, two), (1, one), (2, two), (3, base), (3, " ".join(near)), (4, None), (4, say(30)), (None, bare), (None, bare),
            (5, one[:200] + " " + item), (5, say(50)), (None, say(30) + " " + item + " " + say(20))]
    docs = spark.createDataFrame([(i, t, "kept") for i, t in rows], "doc_id long, text string, row string").repartition(3)
    kept = P.drop_near_copies(spark, docs, tmp_dir)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    left = [x for k, x in enumerate(rows) if k not in (2, 3, 4, 5)]
    three = [x for x in got if x[0] == 3]
    assert len(three) == 1 and three[0] in rows
    assert [x for x in got if x[0] != 3] == sorted(left, key=str)
    out = P.drop_leaks(spark, docs, tmp_dir)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted((x for k, x in enumerate(rows) if k not in (10, 12)), key=str)
