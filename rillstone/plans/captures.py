"""Raw captures over all events: optical frames of an hour of a device, channels packed by bits, and waveforms of seconds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import bits
from ..operators.pulse import pulse
from ..operators.windows import by
from ..session import shared_folder
from ..sources import optical
from .bindings import STREAM, stream

#: A sample of channel ``c`` (0 to 9) from a row's number: signed twenty bits with both extremes.
SAMPLE = "CASE seq % 50 WHEN 0 THEN 524287 WHEN 1 THEN -524288 ELSE seq * 7919 * (c + 1) % 1048576 - 524288 END"
CHUNKS = f"{STREAM}, n AS (SELECT device, t // 3600 AS hour, seq, row_number() OVER (PARTITION BY device, t // 3600 ORDER BY t, seq) - 1 AS i FROM s)"


def _byte(value) -> F.Column:
    return F.lpad(F.hex(value), 2, "0")


def _number(value, size: int):
    """Hexadecimal little-endian bytes of a number, negative ones as two's complement."""
    value = F.when(value < 0, value + (1 << 8 * size)).otherwise(value).cast("long")
    return F.concat(*(_byte(F.floor(value / (1 << 8 * k)) % 256) for k in range(size)))


def frames(spark, sf) -> DataFrame:
    """A frame for fifty rows of an hour of a device; the last block is empty, some frames are damaged or cut."""
    rows = stream(spark, sf).withColumn("hour", F.expr("t DIV 3600")).withColumn("i", F.row_number().over(by(["device", "hour"], ["t", "seq"])) - 1)
    rows = rows.groupBy("device", "hour", F.floor(F.col("i") / 50).cast("int").alias("part")).agg(F.array_sort(F.collect_list(F.struct("i", "seq"))).alias("rows"))
    n = F.size("rows")

    def block(k: int):
        count = n if k < 4 else F.lit(0)
        one = lambda x, c: F.when(x["seq"] % 50 == 0, 524287).when(x["seq"] % 50 == 1, -524288).otherwise(x["seq"] * 7919 * (c + 1) % 1048576 - 524288)
        slot = lambda c: F.rpad(F.array_join(F.transform("rows", lambda x: _number(one(x, c), 4)), "") if k < 4 else F.lit(""), 400, "0")
        settings = F.concat(F.lit("07"), _number(F.lit(1150), 2), F.lit("04"), _number(F.lit(2300), 2), F.lit("01"), _number(F.lit(32), 4), _number(F.lit(-800), 2), F.lit("02"), _number(F.lit(16), 4), _number(F.lit(2400), 2))
        return F.concat(_byte(count), settings, slot(2 * k), slot(2 * k + 1), F.lit("00"))

    head = F.unhex(F.lit("AA0154080001"))
    inner = F.concat(F.lit("2F1400"), _number(F.col("part"), 4), _number(F.col("hour") * 3600, 4), F.lit("00" * 7), *(block(k) for k in range(5)))
    wrong = F.when(F.col("hour") % 11 == 0, 1).otherwise(0)
    rows = rows.withColumn("inner", F.unhex(inner)).withColumn("check", (F.crc32("inner") + wrong) % (1 << 32)).withColumn("first", optical.crc16(bits.octets(head)))
    data = F.concat(head, F.unhex(_number(F.col("first"), 2)), F.col("inner"), F.unhex(_number(F.col("check"), 4)))
    path = shared_folder(spark, "frames")
    rows.select("device", "hour", "part", data.alias("data")).write.parquet(path)
    return spark.read.parquet(path).withColumn("data", F.when(F.col("hour") % 13 == 0, F.substring("data", 1, 2000)).otherwise(F.col("data")))


@query(f"""WITH {CHUNKS} SELECT device, hour, i // 50 AS part, CAST(c // 2 AS INT) AS block, CASE WHEN c % 2 = 0 THEN 'a' ELSE 'b' END AS channel, CAST(i % 50 AS INT) AS place, CAST({SAMPLE} AS INT) AS value
FROM n, range(0, 8) AS q(c) WHERE hour % 11 <> 0 AND hour % 13 <> 0""")
def optical_samples(spark, sf):
    """Every sample of every channel of sound frames; frames with a wrong checksum or an early end give none."""
    rows = optical.blocks(frames(spark, sf))
    both = F.explode(F.array(F.struct(F.lit("a").alias("channel"), F.col("a").alias("values")), F.struct(F.lit("b").alias("channel"), F.col("b").alias("values"))))
    flat = rows.select("device", "hour", F.col("part").cast("long").alias("part"), "block", both.alias("x")).select("device", "hour", "part", "block", "x.channel", F.posexplode("x.values").alias("place", "value"))
    return flat.select("device", "hour", "part", "block", "channel", "place", "value")


@query(f"""WITH {CHUNKS}, g AS (SELECT device, hour, max(i) // 50 AS last FROM n GROUP BY ALL), p AS (SELECT device, hour, unnest(range(0, last + 1)) AS part FROM g)
SELECT device, hour, part, hour * 3600 AS second, k AS block, 1150 AS drive_a, -800 AS offset_a, 16 AS range_b, 2400 AS offset_b FROM p, range(0, 5) AS q(k) WHERE hour % 11 <> 0 AND hour % 13 <> 0""")
def optical_settings(spark, sf):
    s = optical.blocks(frames(spark, sf))
    return s.select("device", "hour", F.col("number").alias("part"), "second", F.col("block").cast("long").alias("block"), *(F.col(f"settings.{c}").alias(c) for c in ("drive_a", "offset_a", "range_b", "offset_b")))


#: Widths of the channels that are packed by bits.
WIDTHS = (19, 5, 12, 23)


@query(f"""WITH {CHUNKS}, v AS (SELECT device, hour, i, seq, c, {list(WIDTHS)}[c + 1] AS w FROM n, range(0, {len(WIDTHS)}) AS q(c))
SELECT device, hour, CAST(c AS INT) AS channel, count(*) AS n, CAST(sum((i + 1) * (CASE seq % 9 WHEN 0 THEN (1 << (w - 1)) - 1 WHEN 1 THEN -(1 << (w - 1)) ELSE (seq * 31 * (c + 3)) % (1 << w) - (1 << (w - 1)) END)) AS BIGINT) AS weighted FROM v GROUP BY ALL""")
def packed_channels(spark, sf):
    """Four channels of 19, 5, 12 and 23 bits, interleaved without gaps behind a head of three bits."""
    rows = stream(spark, sf).withColumn("hour", F.expr("t DIV 3600")).withColumn("i", F.row_number().over(by(["device", "hour"], ["t", "seq"])) - 1)
    rows = rows.groupBy("device", "hour").agg(F.array_sort(F.collect_list(F.struct("i", "seq"))).alias("rows"))

    def field(x, c: int, w: int):
        low = -(1 << (w - 1))
        value = F.when(x["seq"] % 9 == 0, -low - 1).when(x["seq"] % 9 == 1, low).otherwise(x["seq"] * 31 * (c + 3) % (1 << w) + low)
        return F.lpad(F.bin(F.pmod(value.cast("long"), F.lit(1 << w))), w, "0")

    text = F.concat(F.lit("101"), F.array_join(F.transform("rows", lambda x: F.concat(*(field(x, c, w) for c, w in enumerate(WIDTHS)))), ""))
    # The text of bits is cut in bytes once, the last filled up with zeros: a look into it for each byte would build it anew.
    eights = F.regexp_extract_all(F.concat(text, F.lit("0" * 7)), F.lit("[01]{8}"), F.lit(0))
    data = F.unhex(F.array_join(F.transform(eights, lambda x: F.lpad(F.conv(x, 2, 16), 2, "0")), ""))
    found = rows.select("device", "hour", F.size("rows").alias("rounds"), bits.octets(data).alias("b")).select("device", "hour", F.posexplode(bits.channels(F.col("b"), 3, list(WIDTHS), F.col("rounds"))).alias("channel", "values"))
    weighted = F.aggregate(F.transform("values", lambda v, k: v * (k + 1)), F.lit(0).cast("long"), lambda a, v: a + v)
    return found.select("device", "hour", "channel", F.size("values").cast("long").alias("n"), weighted.alias("weighted"))


def waveforms(spark, sf) -> DataFrame:
    """A second of 24 samples for each row, seconds in turn with gaps; pulses of 40 to 160 a minute on a drifting level."""
    rows = stream(spark, sf).withColumn("i", F.row_number().over(by(["device"], ["t", "seq"])))
    second = F.col("i") + F.floor(F.col("i") / 97) * 5
    hertz = (40 + F.floor(F.col("i") / 97) * 17 % 120) / 60
    sample = lambda k: F.round(2000 * F.sin(2 * math.pi * hertz * (F.col("i") + k / 24)) + 30 * F.col("i") + (F.col("seq") * 7 + k * 13) % 200).cast("int")
    # Rows are numbered in a task a device; the samples are made where the seconds are dealt to all tasks.
    rows = rows.select("device", "seq", "i", second.cast("long").alias("second")).repartition("device", "second")
    return rows.select("device", "seq", "second", F.transform(F.sequence(F.lit(0), F.lit(23)), sample).alias("samples"))


@query()
def pulse_rates(spark, sf):
    return pulse(waveforms(spark, sf), "device", "second", "samples", "seq")
