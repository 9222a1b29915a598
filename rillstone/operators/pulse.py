"""Pulse from a waveform: for every second the strongest period of the seconds around it.

A window is centred on each second of a run of seconds without a gap. Its samples, less their straight line, are compared
with themselves at every lag between two rates; the first local peak that is nearly as high as the highest is the period,
refined by a parabola. Windows overlap by eight ninths, and nothing is read or multiplied again for that: running sums of
the samples, of their positions times themselves, and of the products at each lag give any window's line and correlation
by differences, so work grows with the samples and the number of lags. A device's time is cut in buckets; a bucket also
gets the few seconds around it that its windows need.

A record's own period can show as a comb (steps where records meet). Where the steps at the joints are above three times
the others, the mean of each place in a record is taken off first; such windows are worked out one by one.

Defined results: a second without samples, with another number of samples than the rate, or in a run shorter than three
seconds has no row, nor has a window whose highest correlation is below ``LEAST``; of repeated seconds the last by
``order`` counts; flat windows have no period.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Samples a second, seconds to each side, the rates searched, the least correlation, and the share of the
# highest peak that an earlier one must have.
RATE, HALF, SLOWEST, FASTEST, LEAST, NEARLY = 24, 4, 30.0, 220.0, 0.3, 0.85
COMB = 3
#: Seconds of a bucket.
BUCKET = 900


def lags(rate: int = RATE, slowest: float = SLOWEST, fastest: float = FASTEST) -> np.ndarray:
    return np.arange(max(2, int(rate * 60 / fastest + 0.5)), int(rate * 60 / slowest + 0.5) + 1)


def _sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values)])


def correlations(y: np.ndarray, starts: np.ndarray, stops: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Autocorrelation at the lags ``at`` of y[start:stop] less its straight line, a row a window; zero if it is flat."""
    y = y.astype(np.float64)
    y = y - (y.mean() if len(y) else 0.0)
    place = np.arange(len(y), dtype=np.float64)
    one, by_place, square = _sums(y), _sums(place * y), _sums(y * y)
    a, b = starts, stops
    n = (b - a).astype(np.float64)
    s = one[b] - one[a]
    t = by_place[b] - by_place[a] - a * s
    i1, i2 = n * (n - 1) / 2, (n - 1) * n * (2 * n - 1) / 6
    bend = n * i2 - i1 * i1
    slope = np.where(bend > 0, (n * t - i1 * s) / np.where(bend > 0, bend, 1), 0.0)
    level = (s - slope * i1) / n
    whole = square[b] - square[a] - level * s - slope * t
    # A row a lag: the products at each lag, behind the end zeros, and their running sums.
    lag = np.asarray(at)[:, None]
    if not len(y) or not lag.size:
        return np.zeros((len(starts), lag.size))
    ahead = np.lib.stride_tricks.sliding_window_view(np.concatenate([y, np.zeros(lag.max())]), len(y))[lag[:, 0]]
    products = np.zeros((lag.size, len(y) + 1))
    np.cumsum(y * ahead, axis=1, out=products[:, 1:])
    m = n - lag
    ok = m > 0
    end = np.where(ok, b - lag, a)
    cross = np.take_along_axis(products, end, 1) - products[:, a]
    s1 = one[end] - one[a]
    t1 = by_place[end] - by_place[a] - a * s1
    first = np.minimum(a + lag, b)
    s2 = one[b] - one[first]
    t2 = by_place[b] - by_place[first] - a * s2
    j1, j2 = m * (m - 1) / 2, (m - 1) * m * (2 * m - 1) / 6
    line = m * level * (level + slope * lag) + slope * (2 * level + slope * lag) * j1 + slope**2 * j2
    value = cross - (level + slope * lag) * s1 - slope * t1 - level * s2 - slope * (t2 - lag * s2) + line
    flat = whole <= 1e-9 * n
    return np.where(ok & ~flat, value / np.where(flat, 1, whole), 0.0).T.copy()


def without_comb(x: np.ndarray, rate: int = RATE) -> np.ndarray | None:
    """A window less the mean of each place in a record, if its records meet in steps; None if they do not."""
    if len(x) < 4 * rate:
        return None
    steps, joint = np.abs(np.diff(x)), np.arange(1, len(x)) % rate == 0
    inner, outer = steps[~joint].mean(), steps[joint].mean()
    if inner <= 0 or outer <= COMB * inner:
        return None
    return x - np.resize(x.reshape(-1, rate).mean(0), len(x))


def periods(table: np.ndarray, held: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The period in samples, refined between lags, and its correlation, for each row of ``table``; nan if there is none.

    Of a row the first ``held`` lags count.
    """
    n, column = len(table), np.arange(len(at))
    if not n or not len(at):
        return np.full(n, np.nan), np.full(n, np.nan)
    values = np.where(column < held[:, None], table, -np.inf)
    best = values.max(1)
    peak = np.zeros(values.shape, bool)
    mid = values[:, 1:-1]
    peak[:, 1:-1] = (mid >= NEARLY * best[:, None]) & (mid >= values[:, :-2]) & (mid >= values[:, 2:]) & (column[1:-1] < held[:, None] - 1)
    k = np.where(peak.any(1), peak.argmax(1), values.argmax(1))
    row, inner = np.arange(n), (k > 0) & (k < held - 1)
    before, here, after = (values[row, np.clip(k + d, 0, len(at) - 1)] for d in (-1, 0, 1))
    before, after = np.where(inner, before, 0.0), np.where(inner, after, 0.0)
    bend = np.where(inner, before - 2 * here + after, 0.0)
    lag = at[k] + np.where(bend < 0, np.clip(0.5 * (before - after) / np.where(bend < 0, bend, 1.0), -1, 1), 0.0)
    lag = np.clip(lag, at[0], at[np.clip(held - 1, 0, len(at) - 1)])
    found = (best >= LEAST) & (held > 0)
    return np.where(found, lag, np.nan), np.where(found, here, np.nan)


def period(values: np.ndarray, at: np.ndarray) -> tuple[float, float] | None:
    """The period in samples, refined between lags, and its correlation; None if there is none."""
    lag, value = periods(values[None], np.array([len(at)]), at)
    return None if np.isnan(lag[0]) else (float(lag[0]), float(value[0]))


def rates(seconds: np.ndarray, samples: np.ndarray, rate: int = RATE, half: int = HALF) -> list[tuple[int, float, float]]:
    """(second, rate a minute, correlation) of rising seconds with a row of samples each; runs shorter than three give none."""
    found, at = [], lags(rate)
    cuts = np.flatnonzero(np.diff(seconds) != 1) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(seconds)], strict=True):
        if b - a < 3:
            continue
        y, k = samples[a:b].ravel(), np.arange(b - a)
        starts, stops = np.maximum(k - half, 0) * rate, np.minimum(k + half + 1, b - a) * rate
        table = correlations(y, starts, stops, at)
        comb = _combed(samples[a:b], rate, half)
        for w in np.flatnonzero(comb).tolist():
            if (clean := without_comb(y[starts[w] : stops[w]].astype(float), rate)) is not None:
                table[w] = correlations(clean, np.array([0]), np.array([len(clean)]), at)[0]
        found.append((seconds[a:b], table, np.searchsorted(at, stops - starts - 1)))
    if not found:
        return []
    second, table, held = (np.concatenate(x) for x in zip(*found, strict=True))
    lag, value = periods(table, held, at)
    ok = ~np.isnan(lag)
    return list(zip(second[ok].tolist(), (rate * 60 / lag[ok]).tolist(), value[ok].tolist(), strict=True))


def _combed(samples: np.ndarray, rate: int, half: int) -> np.ndarray:
    """Which windows may have a comb: steps at joints against the others, by running sums over seconds."""
    n = len(samples)
    inner, joint = np.abs(np.diff(samples, axis=1)).sum(1), np.concatenate([[0], np.abs(samples[1:, 0] - samples[:-1, -1])])
    k = np.arange(n)
    a, b = np.maximum(k - half, 0), np.minimum(k + half + 1, n)
    si, sj = _sums(inner), _sums(joint)
    within = (si[b] - si[a]) / np.maximum((b - a) * (rate - 1), 1)
    between = (sj[b] - sj[np.minimum(a + 1, b)]) / np.maximum(b - a - 1, 1)
    return (b - a >= 4) & (within > 0) & (between > COMB * within)


def pulse(rows: DataFrame, key: str, ts: str, samples: str, order: str, rate: int = RATE, half: int = HALF, bucket: int = BUCKET) -> DataFrame:
    """(key, ts, bpm, confidence): a row for each second of each key that has a period."""
    # Whole seconds come first in the order; a filter before it would be moved below what makes the samples, and make them twice.
    last = Window.partitionBy(key, ts).orderBy(F.desc("_whole"), F.desc(order))
    one = rows.withColumn("_whole", F.size(samples) == rate).withColumn("_n", F.row_number().over(last)).filter("_n = 1 AND _whole").select(key, F.col(ts).cast("long").alias(ts), F.col(samples).alias("_x"))
    # A window needs its neighbours, and the run's bounds within them: half a window more tells whether a run is too short.
    reach = half + 2
    near = F.array_distinct(F.array(*(F.floor((F.col(ts) + d) / bucket) for d in (-reach, 0, reach))))
    dealt = one.withColumn("_bucket", F.explode(near))
    kind = rows.schema[key].dataType.simpleString()

    def run(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(ts)
        found = rates(frame[ts].to_numpy(), np.stack(frame["_x"].to_numpy()).astype(np.int64), rate, half)
        mine = [(group[0], t, round(b), round(c, 3)) for t, b, c in found if t // bucket == group[1]]
        return pd.DataFrame(mine, columns=[key, ts, "bpm", "confidence"])

    return dealt.groupBy(key, "_bucket").applyInPandas(run, f"`{key}` {kind}, `{ts}` long, bpm int, confidence double")
