"""Optical frames: five blocks of two channels each, decoded in native functions behind both checksums.

A frame has ``LENGTH`` bytes: a start byte, its length, a CRC-16 of the first six bytes at 6, class and layout at 8 and 9,
the record's number at 11 and its second at 15, blocks from 26 on and a CRC-32 of the bytes from 8 on at its end. A block
is a count, twenty bytes of settings, two slots of fifty signed samples in four bytes each, and a spare byte. A frame that
is cut, has another layout, a wrong checksum or a count above a slot's capacity gives nothing at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import at, little, octets, signed

# Fixed values of the layout.
START, CLASS, LAYOUT, LENGTH = 0xAA, 0x2F, 20, 2140
BLOCKS, FIRST, BLOCK, HEAD, SLOT, CAPACITY = 5, 26, 422, 21, 200, 50
NUMBER_AT, SECOND_AT, SUM_AT = 11, 15, 2136


def crc16(b: Column) -> Column:
    """The CRC-16 of a short array of bytes (reflected polynomial 0xA001, start 0xFFFF), in native functions."""
    shifted = lambda c: F.when(c % 2 == 1, F.shiftright(c, 1).bitwiseXOR(F.lit(0xA001))).otherwise(F.shiftright(c, 1))
    eight = F.sequence(F.lit(1), F.lit(8))
    return F.aggregate(b, F.lit(0xFFFF), lambda c, v: F.aggregate(eight, c.bitwiseXOR(v), lambda x, _: shifted(x)))


def sound(data: Column, b: Column) -> Column:
    """Whether a frame and both of its checksums are right; ``b`` are its bytes."""
    counts = [at(b, FIRST + k * BLOCK) <= CAPACITY for k in range(BLOCKS)]
    ok = (F.size(b) == LENGTH) & (at(b, 0) == START) & (at(b, 8) == CLASS) & (at(b, 9) == LAYOUT)
    for c in counts:
        ok = ok & c
    inner = F.substring(data, 9, SUM_AT - 8)
    return F.coalesce(ok & (crc16(F.slice(b, 1, 6)) == little(b, 6, 2)) & (F.crc32(inner) == little(b, SUM_AT, 4)), F.lit(False))


def blocks(frames: DataFrame, data: str = "data") -> DataFrame:
    """A row a block of sound frames: the frames' other columns, number, second, block, settings, and both channels' samples."""
    names = [c for c in frames.columns if c != data]
    rows = frames.withColumn("_b", octets(F.col(data)))
    # Unsound frames give an array that is null: a filter (also one that an inner explode implies) would be moved below the
    # column of bytes and repeat it.
    kept = F.when(sound(F.col(data), F.col("_b")), F.sequence(F.lit(0), F.lit(BLOCKS - 1)))
    b, start = F.col("_b"), F.col("block") * BLOCK + FIRST

    def samples(slot: int) -> Column:
        n, begin = at(b, start), start + HEAD + slot * SLOT
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: signed(little(b, begin + 4 * k, 4), 32).cast("int"))).otherwise(F.array().cast("array<int>"))

    rows = rows.select(*names, little(b, NUMBER_AT, 4).alias("number"), little(b, SECOND_AT, 4).alias("second"), "_b", F.explode_outer(kept).alias("block")).filter("block IS NOT NULL")
    settings = F.struct(
        at(b, start + 1).alias("source_a"), little(b, start + 2, 2).alias("drive_a"), at(b, start + 4).alias("source_b"), little(b, start + 5, 2).alias("drive_b"),
        at(b, start + 7).alias("detector_a"), little(b, start + 8, 4).alias("range_a"), signed(little(b, start + 12, 2), 16).alias("offset_a"),
        at(b, start + 14).alias("detector_b"), little(b, start + 15, 4).alias("range_b"), signed(little(b, start + 19, 2), 16).alias("offset_b"),
    )
    return rows.select(*names, "number", "second", "block", settings.alias("settings"), samples(0).alias("a"), samples(1).alias("b"))
