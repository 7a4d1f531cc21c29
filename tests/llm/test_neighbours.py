import numpy as np

from shiftcast.llm.neighbours import link_vectors


def brute(ids, vecs):
    x = np.array(vecs, np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T >= 0.9
    np.fill_diagonal(s, False)
    label = np.array(ids)
    while True:
        new = np.array([min([label[i], *label[s[i]]]) for i in range(len(ids))])
        if (new == label).all():
            return s, label
        label = new


def test_matches_all_pairs(spark):
    rng = np.random.default_rng(3)
    vecs = []
    for k in range(250):  # groups whose members have cosines around the threshold and above
        c = rng.normal(size=48)
        for _ in range(rng.integers(1, 9)):
            vecs.append(c + rng.normal(size=48) * rng.choice([0.05, 0.2, 0.3]))
    c = rng.normal(size=48)
    vecs += [c + rng.normal(size=48) * 0.1 for _ in range(250)]
    vecs += [vecs[0]] * 3 + [2 * vecs[1]]
    vecs = np.array(vecs, np.float32)
    ids = [int(i) for i in rng.permutation(10 * len(vecs))[:len(vecs)]]
    rows = [(i, v.tolist(), 0) for i, v in zip(ids, vecs)]
    odd = [None, [], [0.0] * 48, [float("nan")] * 48, [None] + [1.0] * 47, [float("inf")] * 48, [1.0, 2.0], [-1.0, 2.0]]
    rows += [(10**6 + k, v, 0) for k, v in enumerate(odd)] + [(10**6 + 20, [1.0, 2.0], 0), (None, [1.0, 2.0], 0), rows[0]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, links int").repartition(5)
    got = {r.vec_id: r for r in link_vectors(df).collect()}
    assert len(got) == len(ids) + 9
    s, label = brute(ids, vecs)
    have = sum(got[i].n_links for i in ids)
    assert 0.97 * s.sum() <= have <= s.sum()
    assert all(got[i].n_links <= n for i, n in zip(ids, s.sum(1)))
    assert np.mean([got[i].component_id == k for i, k in zip(ids, label)]) > 0.98
    for k in range(len(odd)):
        r = got[10**6 + k]
        assert (r.n_links, r.component_id, r.kept) == ((1, 10**6 + 6, True) if k == 6 else (0, 10**6 + k, True))
    assert (got[10**6 + 20].n_links, got[10**6 + 20].component_id, got[10**6 + 20].kept) == (1, 10**6 + 6, False)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_large_list_in_blocks_and_empty(spark, monkeypatch):
    from shiftcast.llm import neighbours

    monkeypatch.setattr(neighbours, "BLOCK", 20)
    rng = np.random.default_rng(5)
    c = rng.normal(size=16)
    df = spark.createDataFrame([(k, (c + rng.normal(size=16) * 0.02).tolist()) for k in range(90)], "vec_id long, embedding array<double>")
    assert {(r.n_links, r.component_id) for r in link_vectors(df).collect()} == {(89, 0)}
    assert link_vectors(df.where("false")).count() == 0
