import gzip
import hashlib
import random

import numpy as np
import pytest

from shiftcast.llm import warc, wavelet


def test_wavelet_queries():
    rng = np.random.default_rng(4)
    for n, top in ((0, 1), (1, 1), (7, 2), (3000, 40), (5000, 49407), (2000, 70000)):
        ids = rng.integers(0, top, n)
        w = wavelet.WaveletMatrix(wavelet.shard_bytes(np.array([5, 9]), np.array([n, 0]), ids))
        assert (w.decode() == ids).all() and list(w.doc_ids) == [5, 9]
        for i in rng.integers(0, max(n, 1), 50) if n else []:
            assert w.access(int(i)) == ids[i]
        for s in [*np.unique(ids)[:20].tolist(), top, 1 << 40]:
            where = np.flatnonzero(ids == s)
            assert w.count(s) == len(where) and w.places(s) == where.tolist()
            assert w.count(s, n // 2) == (where < n // 2).sum()
    with pytest.raises(ValueError):
        wavelet.WaveletMatrix(wavelet.shard_bytes(np.array([1]), np.array([2]), np.array([1, 2]))[:-1])


@pytest.mark.parametrize("shard_ids", [10**6, 50])
def test_wavelet_round_trip(spark, tmp_dir, shard_ids):
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["the", "cat", "été", "12"]) for _ in range(rng.randrange(80)))) for i in rng.sample(range(10**6), 200)]
    rows += [(10**7, None), (10**7 + 1, ""), (10**7 + 2, "same"), (10**7 + 2, "same"), (None, "none")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, start int").repartition(5)
    got = wavelet.read_shards(wavelet.write_shards(docs, path, f"{tmp_dir}/w{shard_ids}", shard_ids), with_ids=True).collect()
    tok = Tokenizer.from_file(path)
    start = 0
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    texts = dict(rows)
    for r in ordered:
        ids = [*tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1]
        assert r.ids == ids and r.start == start and r.n_tokens == len(ids)
        start += len(ids)
    assert wavelet.read_shards(wavelet.write_shards(docs.where("false"), path, f"{tmp_dir}/e{shard_ids}")).count() == 0


def test_monolithic_stream_becomes_members(tmp_dir):
    records = [warc.record_bytes(k, f"http://x/{k}", b"\r\n\r\n" * k + bytes([k]) * 3000, "d", None if k % 3 else 0) for k in range(50)]
    warc.write_monolithic(f"{tmp_dir}/a.mono", iter(records))
    n, size = warc.normalise(f"{tmp_dir}/a.mono", f"{tmp_dir}/a.warc.gz")
    data = open(f"{tmp_dir}/a.warc.gz", "rb").read()
    assert n == 50 and size == len(data) and gzip.decompress(data) == b"".join(records)
    back = list(warc.read_indexed(f"{tmp_dir}/a.warc.gz"))
    assert [warc.parse_record(r) for r in records] == back
    with pytest.raises(ValueError):
        list(warc.split_records([b"".join(records)[:-2]]))


@pytest.mark.parametrize("limit", [32_000_000, 500])
def test_warc_round_trip(spark, tmp_dir, limit):
    body = "<p>" + "é" * 60
    rows = [(1, "http://a/1", body), (2, "http://a/2", body), (3, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""),
            (7, "http://b \n/7", body + "x"), (0, "http://a/0", body), (8, "u", "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 9),
            (9, "u", "x" * 200_000), (None, "u", body)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int").repartition(3)
    got = {r.page_id: r for r in warc.read_archives(warc.write_archives(pages, f"{tmp_dir}/p{limit}", limit)).collect()}
    assert sorted(got) == list(range(10))
    for i, _, html in rows[:-1]:
        data, r = (html or "").encode(), got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        again = html == body and i != 0
        assert (r.record_type, r.refers_to, r.payload) == (("revisit", 0, b"") if again else ("response", None, data))
    assert warc.read_archives(warc.write_archives(pages.where("false"), f"{tmp_dir}/e{limit}")).count() == 0
