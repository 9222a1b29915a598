"""Detectors with state: each is a plain step over one key's ordered rows, run by ``applyInPandasWithState``.

A step takes the state (a tuple), a time and a value, and returns the new state and an event name or None. The same
steps serve batch tests: ``fold`` runs one over a list.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Step = Callable[[tuple, int, float], tuple[tuple, str | None]]


def onset(state: tuple, t: int, x: float, alpha: float = 0.98, ratio: float = 0.6, sustain: int = 60, quiet: int = 900) -> tuple[tuple, str | None]:
    """Fires when the value stays under a share of its moving baseline; then holds off. state: baseline, since, fired."""
    baseline, since, fired = state or (x, -1, -(10**12))
    low = x < ratio * baseline
    since = (t if since < 0 else since) if low else -1
    event = None
    if low and t - since >= sustain and t - fired >= quiet:
        event, fired = "onset", t
    baseline = baseline if low else alpha * baseline + (1 - alpha) * x
    return (baseline, since, fired), event


def nudge(state: tuple, t: int, x: float, still: float = 0.15, after: int = 2700, again: int = 1800) -> tuple[tuple, str | None]:
    """Fires when nothing moved for a while, and again at intervals. state: still since, last nudge."""
    since, last = state or (t, -(10**12))
    if x >= still:
        return (t, last), None
    if t - since >= after and t - last >= again:
        return (since, t), "nudge"
    return (since, last), None


def latch(state: tuple, t: int, x: float, fire: float = 12.0, rearm: float = 25.0) -> tuple[tuple, str | None]:
    """Fires once at or under a level and is armed again above another."""
    armed = bool(state[0]) if state else True
    if armed and x <= fire:
        return (0,), "alert"
    return (int(armed or x > rearm),), None


def guard(state: tuple, t: int, x: float, low: float = 55.0, high: float = 120.0, margin: float = 2.0, dwell: int = 25, cooldown: int = 50) -> tuple[tuple, str | None]:
    """Says ``high`` or ``low`` when a zone is left for long enough. state: zone, since, told."""
    zone, since, told = state or (0, t, -(10**12))
    now = 1 if x > high + (0 if zone == 1 else margin) else -1 if x < low - (0 if zone == -1 else margin) else 0
    if now != zone:
        return (now, t, told), None
    if zone and t - since >= dwell and t - told >= cooldown:
        return (zone, since, t), "high" if zone > 0 else "low"
    return (zone, since, told), None


def smoothed(rows: Iterable[tuple[int, float]], seconds: int = 10, most: int = 40) -> Iterator[tuple[int, float]]:
    """The median of the last ``seconds``, of ``most`` samples at most."""
    held: list[tuple[int, float]] = []
    for t, x in rows:
        held = [(a, b) for a, b in [*held, (t, x)] if a > t - seconds][-most:]
        yield t, median(b for _, b in held)


def fold(step: Step, rows: Iterable[tuple[int, float]]) -> list[tuple[int, str]]:
    state: tuple = ()
    out = []
    for t, x in rows:
        state, event = step(state, t, x)
        if event:
            out.append((t, event))
    return out


def detected(rows: DataFrame, step: Step, width: int, key: str = "device", ts: str = "t", value: str = "value") -> DataFrame:
    """Events of a stream of (key, ts, value): rows of a batch are taken in order, the state goes on between batches."""
    kind = rows.schema[key].dataType.simpleString()

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = tuple(state.get) if state.exists else ()
        frame = pd.concat(list(frames)).sort_values([ts, value])
        out = []
        for t, x in zip(frame[ts].tolist(), frame[value].tolist(), strict=True):
            held, event = step(held, t, x)
            if event:
                out.append((group[0], t, event))
        state.update(tuple(float(v) for v in held))
        yield pd.DataFrame(out, columns=[key, "t", "event"])

    state_schema = ", ".join(f"s{k} double" for k in range(width))
    return rows.select(key, ts, value).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, t long, event string", state_schema, "append", GroupStateTimeout.NoTimeout)


def pacer(state: tuple, t: int, x: float, drop: float = 8.0, step: float = 0.5, floor: float = 4.5) -> tuple[tuple, str | None]:
    """Lowers a breathing pace step by step while the heart rate follows. state: pace, rate at the last step."""
    pace, mark = state or (6.5, x)
    if x <= mark - drop and pace > floor:
        return (pace - step, x), f"pace {pace - step:g}"
    return (pace, mark), None
