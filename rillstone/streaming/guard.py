"""A guard over a live session with event-time timers: a band of heart rate, dwell, cool-down, drift, and silence.

``Guard`` is the plain state of one key, moved on by ``update``; ``guarded`` runs it as ``transformWithStateInPandas``:
scalars in a value state, the last readings and the recent trend in list states that expire with their windows, and one
timer a key that fires when no reading was accepted for ``stale`` seconds. A device that goes silent ends by its timer as
soon as the watermark passes it; where the next row comes first, the same event with the same time is given before it. So
batches may be cut anywhere, and a restart goes on from the state.

Events: ``live`` (a first reading, or one after silence), ``push`` and ``ease`` (cues), ``drift`` (the ceiling moved up by a
step) and ``stale``. Rows of a key are taken in the order of time and value; rows before the last one taken are late and
dropped, as are nulls. Readings that cannot be (too low, above the maximum, a jump) count for time only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


@dataclass(frozen=True)
class Rules:
    """Fixed values of the model; seconds and beats a minute."""

    resting: float = 55.0
    most: float = 190.0
    charge: float | None = None
    low_ceiling: float = 0.60
    high_ceiling: float = 0.82
    width: float = 0.15
    least_floor: float = 0.40
    window: int = 12
    stale: int = 8
    warmup: int = 60
    climb_grace: int = 45
    dwell: int = 25
    cooldown: int = 50
    margin: float = 2.0
    climb: float = 8.0
    climb_window: int = 15
    climb_counts: int = 20
    drift_after: int = 90
    drift_step: float = 2.0
    drift_most: float = 8.0
    plausible: float = 25.0
    above_most: float = 5.0
    jump: float = 45.0

    def band(self) -> tuple[float, float]:
        share = 0.5 if self.charge is None else min(max(self.charge / 100, 0.0), 1.0)
        ceiling = self.low_ceiling + (self.high_ceiling - self.low_ceiling) * share
        floor, reserve = max(ceiling - self.width, self.least_floor), max(self.most - self.resting, 1.0)
        return self.resting + floor * reserve, self.resting + ceiling * reserve


#: The scalars of a state in the order of the value state's columns; None where there is none yet.
SCALARS = ("start", "last", "valid", "accepted", "zone", "below", "above", "slow", "climbed", "pushed", "eased", "drift", "silent")


class Guard:
    """One key: zone is -1 below the band, 0 in it, 1 above; the other scalars are times, or None."""

    def __init__(self, rules: Rules, scalars: tuple | None = None, readings: list | None = None, trend: list | None = None):
        self.rules, self.readings, self.trend = rules, readings or [], trend or []
        for name, value in zip(SCALARS, scalars or (None, None, None, None, 0, None, None, None, None, None, None, 0.0, 1), strict=True):
            setattr(self, name, value)

    def scalars(self) -> tuple:
        return tuple(None if getattr(self, s) is None else float(getattr(self, s)) for s in SCALARS)

    def deadline(self) -> int | None:
        """When the key is silent, if nothing more is accepted; None while it is."""
        return None if self.silent or self.valid is None else int(self.valid) + self.rules.stale

    def expire(self, now: int) -> list[tuple[int, str]]:
        """``stale``, if the deadline lies before ``now``."""
        at = self.deadline()
        if at is None or at >= now:
            return []
        self.silent = 1
        return [(at, "stale")]

    def _plausible(self, t: int, x: float) -> bool:
        r = self.rules
        if not r.plausible <= x <= r.most + r.above_most:
            return False
        return self.accepted is None or t - self.valid > r.window or abs(x - self.accepted) <= r.jump

    def update(self, t: int, x: float) -> list[tuple[int, str]]:
        r = self.rules
        if self.last is not None and t < self.last:
            return []
        events = self.expire(t)
        if self.start is None:
            self.start = t
        if self._plausible(t, x):
            self.readings.append((t, x))
            self.valid, self.accepted = t, x
            if self.silent:
                self.silent = 0
                events.append((t, "live"))
        self.last = t
        self.readings = [p for p in self.readings if p[0] >= t - r.window]
        if self.silent or not self.readings:
            return events
        trend = median(v for _, v in self.readings)
        self.trend = [p for p in [*self.trend, (t, trend)] if p[0] >= t - r.climb_window - 2]
        past = next((v for s, v in self.trend if t - s >= r.climb_window), None)
        if past is not None and trend - past >= r.climb:
            self.climbed = t
        return events + self._coach(t, trend)

    def _coach(self, t: int, trend: float) -> list[tuple[int, str]]:
        r = self.rules
        floor, ceiling = r.band()
        ceiling += self.drift
        zone = self.zone
        if trend > ceiling + r.margin:
            zone = 1
        elif trend < floor - r.margin:
            zone = -1
        elif floor + r.margin <= trend <= ceiling - r.margin:
            zone = 0
        since = lambda at: float("inf") if at is None else t - at
        if zone != -1:
            self.below = None
        elif self.zone != -1:
            self.below = t
        if zone != 1:
            self.above = self.slow = None
        elif self.zone != 1:
            self.above, self.slow = t, None if since(self.climbed) <= r.climb_counts else t
        self.zone, events = zone, []
        if t - self.start >= r.warmup:
            if zone == -1 and t - self.below >= r.dwell and since(self.pushed) >= r.cooldown and since(self.climbed) >= r.climb_grace:
                self.pushed = self.below = t
                events.append((t, "push"))
            elif zone == 1 and self.slow is None and t - self.above >= r.dwell and since(self.eased) >= r.cooldown:
                self.eased = self.above = t
                events.append((t, "ease"))
        if zone == 1 and self.slow is not None and t - self.slow >= r.drift_after and self.drift < r.drift_most:
            self.drift, self.slow = min(self.drift + r.drift_step, r.drift_most), t
            events.append((t, "drift"))
        return events


class _Processor(StatefulProcessor):
    def __init__(self, rules: Rules, key: str, ts: str, value: str):
        self.rules, self.names = rules, (key, ts, value)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("scalars", ", ".join(f"{s} double" for s in SCALARS))
        self.lists = [handle.getListState(n, "t long, x double") for n in ("readings", "trend")]

    def _load(self) -> Guard:
        held = tuple(self.value.get()) if self.value.exists() else None
        return Guard(self.rules, held, *([(int(t), float(x)) for t, x in one.get()] if one.exists() else [] for one in self.lists))

    def _save(self, guard: Guard) -> None:
        self.value.update(guard.scalars())
        for one, rows in zip(self.lists, (guard.readings, guard.trend), strict=True):
            if rows:
                one.put([(int(t), float(x)) for t, x in rows])
            else:
                one.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if guard.deadline() is not None:
            self.handle.registerTimer(guard.deadline() * 1000)

    def _frame(self, key, events: list[tuple[int, str]]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], int(t), e) for t, e in events], columns=[self.names[0], "t", "event"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        _, ts, value = self.names
        guard, events = self._load(), []
        held = [f[[ts, value]].dropna() for f in rows]
        for t, x in pd.concat(held).sort_values([ts, value]).itertuples(index=False):
            events += guard.update(int(t), float(x))
        self._save(guard)
        yield self._frame(key, events)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        guard = self._load()
        events = guard.expire(expiredTimerInfo.getExpiryTimeInMs() // 1000 + 1)
        self._save(guard)
        yield self._frame(key, events)

    def close(self) -> None:
        pass


#: The state store that timers and list states need.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def guarded(rows: DataFrame, rules: Rules = Rules(), key: str = "device", ts: str = "t", value: str = "value", at: str = "at") -> DataFrame:
    """Events (key, t, event) of a stream of (key, ts in seconds, value) with a watermark on its time column ``at``."""
    kind = rows.schema[key].dataType.simpleString()
    source = rows.select(key, ts, value, at).groupBy(key)
    return source.transformWithStateInPandas(_Processor(rules, key, ts, value), f"{key} {kind}, t long, event string", "append", "EventTime")

