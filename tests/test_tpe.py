import math
import random

import numpy as np
import pytest

from shiftcast.operators import tpe as T


def _cut_normal(x, mu, s, a, b):
    cdf = lambda z: (1 + math.erf(z / math.sqrt(2))) / 2
    return math.exp(-((x - mu) / s) ** 2 / 2) / (s * math.sqrt(2 * math.pi)) / (cdf((b - mu) / s) - cdf((a - mu) / s))


def test_density_by_hand():
    # one trial at 0.2 in [0, 1]: gaps of 0.2 and 0.3, not below a third of the range; the prior sits at 0.5 and is as wide as it
    d = T.Parzen([0.2], (0.0, 1.0))
    assert d.parts == [(0.2, pytest.approx(1 / 3)), (0.5, 1.0)]
    for x in (0.0, 0.2, 0.9):
        assert d.density(x) == pytest.approx((_cut_normal(x, 0.2, 1 / 3, 0, 1) + _cut_normal(x, 0.5, 1.0, 0, 1)) / 2)
    # trials at 1, 2 and 9 in [0, 10]: the larger gap of each, at least 10 / 5
    d = T.Parzen([2.0, 9.0, 1.0], (0.0, 10.0))
    assert d.parts == [(1.0, 2.0), (2.0, 3.0), (5.0, 10.0), (9.0, 4.0)]
    for values, ends in (([], (0, 1)), ([0.2], (0, 1)), ([2.0, 9.0, 1.0], (0, 10)), ([5.0] * 40, (0, 10))):
        grid = np.linspace(*ends, 20_001)
        assert np.trapezoid([T.Parzen(values, ends).density(x) for x in grid], grid) == pytest.approx(1, abs=1e-3)


def test_ranges():
    r = T.Range(3, 8, whole=True)
    assert r.ends == (2.5, 8.5) and [r.outer(x) for x in (2.5, 3.4, 7.6, 8.5)] == [3, 3, 8, 8]
    r = T.Range(0.01, 0.3, log=True)
    assert r.outer(r.inner(0.05)) == pytest.approx(0.05) and r.outer(math.log(9)) == 0.3


def test_better_tenth():
    trials = [({"x": i}, float(abs(i - 30))) for i in range(40)]
    good, rest = T.better(trials)
    assert [p["x"] for p in good] == [30, 29, 31, 28] and len(rest) == 36
    assert len(T.better([({}, 1.0)] * 1000)[0]) == 25


def test_seeded_and_finds_the_minimum():
    space = {"x": T.Range(0.0, 10.0), "k": T.Range(1, 9, whole=True), "r": T.Range(0.01, 1.0, log=True)}

    def run(seed):
        rng, trials = random.Random(seed), []
        while len(trials) < 60:
            p = T.propose(trials, space, rng)
            assert all(space[k].low <= v <= space[k].high for k, v in p.items()) and isinstance(p["k"], int)
            trials.append((p, (p["x"] - 7) ** 2 + (p["k"] - 3) ** 2 + math.log(p["r"] / 0.1) ** 2))
        return trials

    one = run(1)
    assert one == run(1) and one != run(2)
    late = [loss for _, loss in one[30:]]
    assert np.mean(late) < 0.5 * np.mean([loss for _, loss in one[:T.STARTUP]])
