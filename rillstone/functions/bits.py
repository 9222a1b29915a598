"""Bytes and bits of binary columns in native functions: no Python, so the scan stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def octets(data: Column) -> Column:
    """The bytes of a binary column as an array of integers from 0 to 255; null stays null."""
    letters = F.split(F.decode(data, "ISO-8859-1"), "")
    return F.when(F.octet_length(data) == 0, F.array().cast("array<int>")).otherwise(F.transform(letters, F.ascii))


def at(b: Column, k: Column | int) -> Column:
    """The byte at a place counted from zero; null outside."""
    return F.get(b, F.lit(k) if isinstance(k, int) else k)


def signed(value: Column, bits: int) -> Column:
    """Two's complement of a number of so many bits."""
    return F.when(value >= 1 << (bits - 1), value - (1 << bits)).otherwise(value)


def little(b: Column, k: Column | int, size: int) -> Column:
    """An unsigned little-endian number of ``size`` bytes; null if any of them is missing."""
    total = at(b, k).cast("long")
    for j in range(1, size):
        total = total + at(b, k + j).cast("long") * (1 << 8 * j)
    return total


def big(b: Column, k: Column | int, size: int) -> Column:
    """An unsigned big-endian number of ``size`` bytes; null if any of them is missing."""
    total = at(b, k).cast("long")
    for j in range(1, size):
        total = total * 256 + at(b, k + j).cast("long")
    return total


def bits(b: Column, first: Column, width: int) -> Column:
    """An unsigned number of ``width`` bits, most significant first, from bit ``first`` of the bytes on.

    The bits may begin anywhere in a byte; widths up to 48 are exact. Null if the bytes end before.
    """
    span = (width + 14) // 8  # bytes that the bits touch at most
    place, shift = F.floor(first / 8).cast("int"), (first % 8).cast("int")
    total = F.coalesce(at(b, place), F.lit(0)).cast("long")
    for j in range(1, span):
        total = total * 256 + F.coalesce(at(b, place + j), F.lit(0)).cast("long")
    value = F.call_function("shiftright", total, F.lit(8 * span - width).cast("int") - shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
    return F.when(first + width <= F.size(b) * 8, value)


def _nth(b: Column, step: int, offset: int, width: int):
    return lambda k: signed(bits(b, k * step + offset, width), width)


def channels(b: Column, first: int, widths: list[int], rounds: Column) -> Column:
    """Interleaved channels of signed numbers of the given bit widths: an array a channel, ``rounds`` numbers each.

    A round holds one number of every channel, without gaps; rounds that the bytes do not hold whole are left out.
    """
    whole = sum(widths)
    held = F.least(rounds, F.floor((F.size(b) * 8 - first) / whole)).cast("int")
    out, offset = [], first
    for w in widths:
        number = _nth(b, whole, offset, w)
        out.append(F.when(held > 0, F.transform(F.sequence(F.lit(0), held - 1), number)).otherwise(F.array().cast("array<bigint>")))
        offset += w
    return F.array(*out)
