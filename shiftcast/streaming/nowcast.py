"""Nowcast features on the stream of closed hours (survey F1, F2, F4 on B8).

The roll-up appends each hour of a key once it is closed.  Here a key's state is a ring of
its last hours, as many as the features look back (``KEEP_ROWS`` rows and ``KEEP_HOURS`` by the
clock), so it is bounded whatever the length of the stream.  Every closed hour gives one row
with the features that the batch operators give it; a restart goes on from the state in
the query's checkpoint.

Hours of a key must come in order, as the roll-up's watermark sees to; an hour that is not
after the last one of its key is left out, as late rows are.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shiftcast.operators.features import CLOCK_LAGS, ROLLING
from shiftcast.session import ship_package

KEEP_ROWS, KEEP_HOURS = 168, 336
_HOUR = 3_600_000_000  # microseconds


def hour_features(times: np.ndarray, values: np.ndarray, n: int, value: str, lags: Sequence[int], clock: Mapping[int, str],
                  rolling: Mapping[str, tuple[int, str]]) -> dict[str, np.ndarray]:
    """Features of the last ``n`` rows of a key's sorted hours (NaN where there are none)."""
    at = np.arange(len(times) - n, len(times))
    out: dict[str, np.ndarray] = {}
    for k in lags:
        out[f"{value}_lag_{k}"] = np.where(at >= k, values[np.maximum(at - k, 0)], np.nan)
    for h, name in clock.items():
        want = times[at] - h * _HOUR
        hit = np.minimum(np.searchsorted(times, want), len(times) - 1)
        out[f"{value}_{name}"] = np.where(times[hit] == want, values[hit], np.nan)
    for name, (w, how) in rolling.items():
        col = np.full(n, np.nan)
        for i, k in enumerate(at):
            part = values[max(0, k - w):k]
            part = part[~np.isnan(part)]
            if len(part) >= max(1, w // 4) and not (how == "std" and len(part) < 2):
                col[i] = part.std(ddof=1) if how == "std" else part.max() if how == "max" else part.mean()
        out[f"{value}_{name}"] = col
    return out


def _step(value: str, keys: list[str], ts: str, lags, clock, rolling):
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old_t, old_v = (np.array(x) for x in state.get) if state.exists else (np.zeros(0, np.int64), np.zeros(0))
        new = pd.concat(list(parts)).sort_values(ts).drop_duplicates(ts)
        t = new[ts].to_numpy().astype("datetime64[us]").astype(np.int64)
        late = len(old_t) > 0
        new, t = (new[t > old_t[-1]], t[t > old_t[-1]]) if late else (new, t)
        v = new[value].to_numpy(dtype=float, na_value=np.nan)
        times = np.concatenate((old_t.astype(np.int64), t))
        values = np.concatenate((old_v.astype(float), v))
        if len(t):
            made = hour_features(times, values, len(t), value, lags, clock, rolling)
            kept = (np.arange(len(times)) >= len(times) - KEEP_ROWS) | (times >= times[-1] - KEEP_HOURS * _HOUR)
            state.update((times[kept].tolist(), [None if np.isnan(x) else x for x in values[kept].tolist()]))
            yield pd.DataFrame({**{k: new[k] for k in [*keys, ts]}, value: v, **{c: pd.Series(x, index=new.index) for c, x in made.items()}})
    return run


def nowcast_features(closed: DataFrame, value: str, keys: Sequence[str] = (), ts: str = "timestamp_hour", lags: Sequence[int] = (1, 2, 3),
                     clock: Mapping[int, str] | None = None, rolling: Mapping[str, tuple[int, str]] | None = None) -> DataFrame:
    """(keys, ts, value, features) for every hour of the stream ``closed(keys, ts, value)``, each once."""
    ship_package(closed.sparkSession)
    keys = list(keys)
    clock, rolling = dict(clock or CLOCK_LAGS), dict(rolling or ROLLING)
    names = [*[f"{value}_lag_{k}" for k in lags], *[f"{value}_{n}" for n in clock.values()], *[f"{value}_{n}" for n in rolling]]
    kinds = dict(closed.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in [*keys, ts]), f"`{value}` double", *(f"`{c}` double" for c in names)])
    rows = closed.select(*keys, ts, F.col(value).cast("double").alias(value)).where(F.col(ts).isNotNull())
    by = keys or [F.lit(0).alias("_series")]
    made = rows.groupBy(*by).applyInPandasWithState(_step(value, keys, ts, tuple(lags), clock, rolling), schema, "times array<long>, vals array<double>",
                                                   "append", GroupStateTimeout.NoTimeout)
    return made.select(*keys, ts, value, *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in names])
