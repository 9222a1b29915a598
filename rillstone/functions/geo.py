"""Routes: great-circle distance as a column, and the encoded polyline format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def haversine(lat0: Column, lon0: Column, lat: Column, lon: Column) -> Column:
    """Metres between two points in degrees."""
    half = lambda a, b: F.pow(F.sin((F.radians(a) - F.radians(b)) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(half(lat, lat0) + F.cos(F.radians(lat0)) * F.cos(F.radians(lat)) * half(lon, lon0)))


def encode_polyline(points: list[tuple[float, float]], precision: int = 5) -> str:
    out, last = [], (0, 0)
    for point in points:
        now = tuple(round(v * 10**precision) for v in point)
        for a, b in zip(now, last, strict=True):
            v = (a - b) << 1
            v = ~v if v < 0 else v
            while v >= 0x20:
                out.append(chr((0x20 | v & 0x1F) + 63))
                v >>= 5
            out.append(chr(v + 63))
        last = now
    return "".join(out)


def decode_polyline(text: str, precision: int = 5) -> list[tuple[float, float]]:
    values, shift, v, out, at = [], 0, 0, [], [0, 0]
    for c in text:
        b = ord(c) - 63
        v |= (b & 0x1F) << shift
        shift += 5
        if b < 0x20:
            values.append(~(v >> 1) if v & 1 else v >> 1)
            shift = v = 0
    for k in range(0, len(values) - 1, 2):
        at = [at[0] + values[k], at[1] + values[k + 1]]
        out.append((at[0] / 10**precision, at[1] / 10**precision))
    return out


def fnv1a(data: bytes) -> int:
    """The 64-bit FNV-1a hash."""
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h
