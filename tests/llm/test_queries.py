"""The registered queries, and their SQL where there is any, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from shiftcast.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = con.execute(Q.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = Q.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, want.fetchall()))


def test_one_query_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in Q.queries()) == list(range(1, 14))


#: Columns that a query returns at least, and the tables it has a row for each row of (None: it depends).
RESULTS = {
    "op1_embedding_near_dedup": ("vec_id n_links component_id kept", ["embeddings"]),
    "op3_html_extraction": ("page_id url text n_chars", ["pages"]),
    "op4_wavelet": ("doc_id start n_tokens ids_crc32", ["documents"]),
    "op5_language_id": ("kind doc_id page_id lang probability", ["pages", "documents"]),
    "op7_decontamination": ("doc_id item_id", None),
    "op8_toxicity": ("doc_id held_out score predicted", ["documents"]),
    "op9_ngram_jaccard": ("doc_id n_shingles component_id", ["documents"]),
    "op10_packing": ("doc_id start length ids_crc32 doc_tokens sequence_id offset", None),
}


@pytest.fixture(scope="module")
def ids():
    """Token ids of every document with the end id, by the tokenizer itself."""
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(Q.tokenizer_path())
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    return {i: [*tok.encode(x or "", add_special_tokens=False).ids, 1] for i, x in zip(t["doc_id"].to_pylist(), t["text"].to_pylist())}


def _crc(ids):
    import zlib

    import numpy as np

    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", sorted(RESULTS))
def test_runs_as_registered(spark, name, ids):
    columns, tables = RESULTS[name]
    rows = Q.queries()[name](spark, SF).collect()
    assert rows and set(columns.split()) <= set(rows[0].asDict())
    if tables:
        assert len(rows) == sum(spark.read.parquet(f"{SF}/{t}.parquet").count() for t in tables)
    if name == "op4_wavelet":
        start = 0
        for r in sorted(rows, key=lambda r: r.doc_id):
            assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids[r.doc_id]), _crc(ids[r.doc_id]))
            start += r.n_tokens
    if name == "op10_packing":
        of_doc, of_seq = {}, {}
        for r in rows:
            assert r.ids_crc32 == _crc(ids[r.doc_id][r.start:r.start + r.length]) and r.doc_tokens == len(ids[r.doc_id])
            of_doc.setdefault(r.doc_id, []).append((r.start, r.length))
            of_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts, ends in ((of_doc, {d: len(x) for d, x in ids.items()}), (of_seq, {s: sum(n for _, n in p) for s, p in of_seq.items()})):
            assert parts.keys() == ends.keys()
            for k, p in parts.items():  # gapless from 0
                at = 0
                for start, n in sorted(p):
                    assert start == at and n > 0
                    at += n
                assert at == ends[k]
        assert max(sum(n for _, n in p) for p in of_seq.values()) <= 2048
    if name == "op8_toxicity":
        assert all(0 < r.score < 1 or r.score in (0.0, 1.0) for r in rows) and any(r.score not in (0.0, 1.0) for r in rows)
