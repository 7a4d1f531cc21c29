"""Tree-structured Parzen estimation of hyper-parameters (survey H11).

Finished trials are split into the better few and the rest.  For each parameter both sets
are described by a Parzen density: a mixture of one normal around every trial's value and
one wide normal in the middle of the range, all cut at the range's ends.  Candidates are
drawn from the better set's density and the one with the largest ratio of both densities
is tried next.  Parameters on a log scale are treated by their logarithm, whole numbers as
values half a unit to either side.
"""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

#: Trials drawn at random before densities are used; candidates drawn for each proposal.
STARTUP = 10
CANDIDATES = 24


@dataclass(frozen=True)
class Range:
    low: float
    high: float
    log: bool = False
    whole: bool = False

    @property
    def ends(self) -> tuple[float, float]:
        pad = 0.5 if self.whole else 0.0
        a, b = self.low - pad, self.high + pad
        return (math.log(a), math.log(b)) if self.log else (a, b)

    def inner(self, x: float) -> float:
        return math.log(x) if self.log else float(x)

    def outer(self, u: float) -> float:
        x = math.exp(u) if self.log else u
        x = min(max(x, self.low), self.high)
        return int(min(max(round(x), self.low), self.high)) if self.whole else x

    def draw(self, rng: random.Random) -> float:
        return self.outer(rng.uniform(*self.ends))


def _phi(z: float) -> float:
    return math.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def _cdf(z: float) -> float:
    return (1 + math.erf(z / math.sqrt(2))) / 2


class Parzen:
    """Density of a parameter's values in a set of trials, on the inner scale."""

    def __init__(self, values: Sequence[float], ends: tuple[float, float]):
        self.low, self.high = ends
        width = self.high - self.low
        middle = (self.low + self.high) / 2
        points = sorted([(v, False) for v in values] + [(middle, True)])
        self.parts: list[tuple[float, float]] = []
        for i, (mu, prior) in enumerate(points):
            if prior:
                self.parts.append((mu, width))
                continue
            # as wide as the larger gap to a neighbour (or to an end of the range)
            left = mu - (points[i - 1][0] if i else self.low)
            right = (points[i + 1][0] if i + 1 < len(points) else self.high) - mu
            self.parts.append((mu, min(max(left, right, width / min(100, len(points) + 1)), width)))

    def density(self, x: float) -> float:
        total = 0.0
        for mu, s in self.parts:
            inside = _cdf((self.high - mu) / s) - _cdf((self.low - mu) / s)
            total += _phi((x - mu) / s) / s / inside
        return total / len(self.parts)

    def draw(self, rng: random.Random) -> float:
        mu, s = self.parts[rng.randrange(len(self.parts))]
        while True:
            x = rng.gauss(mu, s)
            if self.low <= x <= self.high:
                return x


def better(trials: Sequence[tuple[Mapping, float]]) -> tuple[list[Mapping], list[Mapping]]:
    """Parameters of the best tenth of the trials (at most 25), and of the others."""
    order = sorted(range(len(trials)), key=lambda i: (trials[i][1], i))
    n = min(math.ceil(len(trials) / 10), 25)
    return [trials[i][0] for i in order[:n]], [trials[i][0] for i in order[n:]]


def propose(trials: Sequence[tuple[Mapping, float]], space: Mapping[str, Range], rng: random.Random) -> dict:
    """The next parameters to try after ``trials`` of (parameters, loss)."""
    if len(trials) < STARTUP:
        return {k: r.draw(rng) for k, r in space.items()}
    good, rest = better(trials)
    out = {}
    for k, r in space.items():
        up = Parzen([r.inner(p[k]) for p in good], r.ends)
        down = Parzen([r.inner(p[k]) for p in rest], r.ends)
        drawn = [up.draw(rng) for _ in range(CANDIDATES)]
        out[k] = r.outer(max(drawn, key=lambda x: math.log(up.density(x)) - math.log(down.density(x))))
    return out
