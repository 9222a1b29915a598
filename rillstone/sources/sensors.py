"""Decoders of sensor notifications: heart rate, cycling, running, fitness machines, inertial blocks.

Each takes the bytes of one notification and gives a dictionary, or None if they are cut short. ``decoded`` runs one
over a table of notifications in Arrow batches.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, code: str) -> int:
        value = struct.unpack_from("<" + code, self.data, self.at)[0]
        self.at += struct.calcsize(code)
        return value

    def take24(self) -> int:
        low, high = self.take("H"), self.take("B")
        return high << 16 | low


def heart_rate(data: bytes) -> dict | None:
    """bpm, contact (None if not told), energy and the beat intervals in milliseconds."""
    try:
        r = _Reader(data)
        flags = r.take("B")
        out: dict = {"bpm": r.take("H" if flags & 1 else "B"), "contact": bool(flags & 2) if flags & 4 else None, "energy_kj": r.take("H") if flags & 8 else None, "rr_ms": []}
        while flags & 16 and r.at + 2 <= len(data):
            out["rr_ms"].append(r.take("H") * 1000 / 1024)
        return out
    except struct.error:
        return None


def cycling(data: bytes) -> dict | None:
    """Cumulative wheel and crank revolutions with their event times (1/1024 s)."""
    try:
        r = _Reader(data)
        flags = r.take("B")
        wheel = (r.take("I"), r.take("H")) if flags & 1 else (None, None)
        crank = (r.take("H"), r.take("H")) if flags & 2 else (None, None)
        return {"wheel_revs": wheel[0], "wheel_time": wheel[1], "crank_revs": crank[0], "crank_time": crank[1]}
    except struct.error:
        return None


def cadence(before: dict, now: dict) -> float | None:
    """Revolutions a minute between two readings; counters and times wrap at 65,536."""
    if before["crank_revs"] is None or now["crank_revs"] is None:
        return None
    turns, ticks = (now["crank_revs"] - before["crank_revs"]) % 65536, (now["crank_time"] - before["crank_time"]) % 65536
    return turns * 60 * 1024 / ticks if ticks else None


def running(data: bytes) -> dict | None:
    """Speed (m/s), cadence, stride and distance in metres, and whether it is a run."""
    try:
        r = _Reader(data)
        flags = r.take("B")
        speed, steps = r.take("H") / 256, r.take("B")
        return {"speed": speed, "cadence": steps, "stride_m": r.take("H") / 100 if flags & 1 else None, "distance_m": r.take("I") / 10 if flags & 2 else None, "is_run": bool(flags & 4)}
    except struct.error:
        return None


#: Fields of the bike data of a fitness machine in order: flag bit, name, code, divisor. Bit 0 cleared means speed is there.
BIKE = ((1, "avg_speed", "H", 100), (2, "cadence", "H", 2), (3, "avg_cadence", "H", 2), (4, "distance_m", "24", 1), (5, "resistance", "h", 1), (6, "power", "h", 1), (7, "avg_power", "h", 1), (9, "bpm", "B", 1))


def indoor_bike(data: bytes) -> dict | None:
    try:
        r = _Reader(data)
        flags = r.take("H")
        out: dict = {"speed": None if flags & 1 else r.take("H") / 100}
        for bit, name, code, divisor in BIKE:
            if bit == 9 and flags & 256:
                out["kcal"] = r.take("H")
                r.at += 3
            if flags >> bit & 1:
                value = r.take24() if code == "24" else r.take(code)
                out[name] = value / divisor if divisor > 1 else value
        return out
    except struct.error:
        return None


def inertial(data: bytes, axes: int = 6, scale: float = 1 / 4096) -> list[list[float]]:
    """Rows of ``axes`` little-endian 16-bit values; a cut row at the end is left out."""
    n = len(data) // (2 * axes)
    values = struct.unpack_from(f"<{n * axes}h", data)
    return [[v * scale for v in values[k * axes : (k + 1) * axes]] for k in range(n)]


def decoded(rows: DataFrame, decode: Callable[[bytes], dict | None], fields: str, keep: list[str], column: str = "data") -> DataFrame:
    """``keep`` and the fields (a schema string) of each notification; those that cannot be read are left out."""
    names = [f.strip().split(" ")[0] for f in fields.split(",")]
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), fields])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [None if b is None else decode(bytes(b)) for b in frame[column]]
            ok = [x is not None for x in found]
            out = frame.loc[ok, keep].reset_index(drop=True)
            for n in names:
                out[n] = [x.get(n) for x in found if x is not None]
            yield out

    return rows.select(*dict.fromkeys([*keep, column])).mapInPandas(run, schema)
