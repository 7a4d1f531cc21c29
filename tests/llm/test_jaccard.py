import random
import re
from collections import defaultdict

from shiftcast.llm.jaccard import similarity_components


def words(rng, n, vocab=4000):
    return [f"w{rng.randrange(vocab)}" for _ in range(n)]


def brute(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    inverted = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            inverted[x].append(i)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in {b for x in sets[a] for b in inverted[x] if b > a}:
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed=7):
    rng = random.Random(seed)
    rows, i = [], 0
    common = words(rng, 60)
    for n in [1, 2, 4, 5, 6, 9, 20, 60, 130, 300, 700, 1500, 4000]:
        for _ in range(4):
            base = words(rng, n)
            for _ in range(5):
                w = list(base)
                for _ in range(rng.choice([0, 1, 1 + n // 60, 1 + n // 45, 1 + n // 40])):
                    k = rng.randrange(len(w) + 1)
                    if rng.random() < .3 and len(w) > 1:
                        del w[min(k, len(w) - 1)]
                    elif rng.random() < .5:
                        w.insert(k, f"x{rng.randrange(99999)}")
                    else:
                        w[min(k, len(w) - 1)] = f"x{rng.randrange(99999)}"
                rows.append((i, " ".join(w)))
                i += 1
    for n in (10, 25, 60, 100, 200):  # texts that share a passage, in many components
        for _ in range(60):
            rows.append((i, " ".join(words(rng, n // 2) + common + words(rng, n - n // 2))))
            i += 1
    base = words(rng, 150)
    for _ in range(120):  # a large group of near copies
        w = list(base)
        w[rng.randrange(150)] = f"y{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
        i += 1
    for _ in range(300):  # copies of it that are too far from each other to link, or just not
        w = list(base)
        for k in rng.sample(range(150), rng.randrange(2, 9)):
            w[k] = f"z{rng.randrange(3)}"
        rows.append((i, " ".join(w)))
        i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " \n\t"), (i + 3, "A b\tC d\ne"), (i + 4, "a B c D E"), (i + 5, rows[3][1])]
    rng.shuffle(rows)
    return rows


def test_matches_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "extra") for i, t in rows], "doc_id long, text string, n string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similarity_components(docs).collect()}
    assert got == brute(rows)


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b c"), (None, "a b c"), (3, None)],
                                 "doc_id long, text string")
    assert sorted(map(tuple, similarity_components(docs).collect())) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]
    assert similarity_components(docs.where("false")).count() == 0
