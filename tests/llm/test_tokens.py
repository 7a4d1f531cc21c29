import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")

TEXTS = ["Hello, world! It's   DON'T re-do 12345 ...", "", None, "á éX Été İstanbul ΣσΣ",
         "<|endoftext|> x<|startoftext|>y < | >", "café. ÉCOLE!! ß×÷ µª", "日本語 \U0001f600 emoji,",
         "tab\tnew\nline\r\x0b\x0c\x1c\x85  end", "n't 'll ''s \"quoted\" a.b@c.de $5.00", "W " * 5000, "x" * 3000, "word#,* (z)"]


def test_ids_equal_the_librarys():
    from tokenizers import Tokenizer

    from shiftcast.llm.tokens import encode_column

    tok = Tokenizer.from_file(PATH)
    for _ in range(2):  # the second time from the table
        got = [list(map(int, x)) for _, _, ids, rows in encode_column(pa.array(TEXTS), PATH)
               for x in np.split(ids, np.cumsum(rows)[:-1])]
        assert got == [[*tok.encode(t or "", add_special_tokens=False).ids, 1] for t in TEXTS]


@pytest.mark.parametrize("cut_rest", [True, False])
def test_packing_round_trip(spark, cut_rest):
    from tokenizers import Tokenizer

    from shiftcast.llm.packing import pack

    rng = random.Random(3)
    rows = list(enumerate(TEXTS)) + [(100 + k, " ".join(rng.choice("the of cat dog tree".split())
                                      for _ in range(rng.randrange(1, 6000)))) for k in range(150)] + [(7, "the cat")] * 40
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, length int").repartition(6)
    got = pack(docs, PATH, cut_rest=cut_rest).collect()
    tok = Tokenizer.from_file(PATH)
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4"))
    assert sum(r.length for r in got) == sum(len(x) for v in ids.values() for x in v)
    for r in got:
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start:r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
    fill = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 2048 and sorted(fill) == list(range(len(fill)))
    assert len(fill) <= (1.002 if cut_rest else 1.02) * sum(fill.values()) / 2048 + 3
    assert pack(docs.where("false"), PATH).count() == 0


def test_patterns_meet_demand():
    from shiftcast.llm.packing import integer_patterns

    rng = np.random.default_rng(0)
    sizes = np.arange(1, 128)
    demand = rng.integers(0, 90, len(sizes))
    sizes, demand = sizes[demand > 0], demand[demand > 0]
    found = integer_patterns(sizes, demand, 128)
    assert (sum(n * p for p, n in found) == demand).all() and all(p @ sizes <= 128 for p, _ in found)
    free = []  # no worse than first-fit decreasing
    for size in np.repeat(sizes, demand)[::-1].tolist():
        k = next((k for k, f in enumerate(free) if f >= size), None)
        if k is None:
            free.append(128 - size)
        else:
            free[k] -= size
    assert sum(n for _, n in found) <= len(free)
