"""Ring records: a tag and a payload each, decoded in one pass to events and dealt to typed streams.

``events`` gives each record an array of (stream, place, back, body): ``place`` is the position in the record, ``back`` the
seconds before the record's stamp at which it lies, ``body`` a variant whose fields belong to the stream. Records that
carry a span are laid back from their stamp: beat summaries by five minutes a pair, oxygen samples by a second, sleep
phases by half a minute. A payload that is too short or breaks a rule of its kind gives no events; what a decoder reads as
absent is not made up. Tags that are known and not stored, and tags that are not known, give none either and are counted
by ``census``. All of it is native: one scan, one explode, whatever the number of streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import at, big, little, octets, signed

# The tags whose records are stored, the two that answer a command (live rate, battery) among them.
STORED = {
    0x0D: "battery", 0x44: "beat", 0x46: "temperature", 0x47: "motion", 0x4B: "phase", 0x4E: "phase", 0x55: "rate", 0x5A: "phase", 0x5D: "summary", 0x60: "beat",
    0x69: "temperature", 0x6A: "breath", 0x6E: "beat", 0x6F: "oxygen", 0x75: "temperature", 0x77: "oxygen", 0x7B: "oxygen", 0x80: "beat",
}
# Tags that are known but not stored, for diagnosis only or without a verified layout.
KNOWN = [0x41, 0x42, 0x43, 0x45, 0x49, 0x4C, 0x4F, 0x50, 0x51, 0x52, 0x53, 0x57, 0x58, 0x6B, 0x70, 0x71, 0x7E, 0x7F, 0x85]
#: The fields of each stream's body, as (name, type).
BODIES = {
    "rate": [("bpm", "int")],
    "beat": [("ms", "int"), ("amplitude", "int"), ("channel", "string")],
    "summary": [("bpm", "int"), ("rmssd", "int")],
    "oxygen": [("value", "int"), ("unit", "string")],
    "temperature": [("raw", "int"), ("unit", "string")],
    "phase": [("code", "int")],
    "motion": [("orientation", "int"), ("seconds", "int"), ("x", "int"), ("y", "int"), ("z", "int"), ("low", "int"), ("high", "int")],
    "breath": [("raw", "int"), ("unit", "string")],
    "battery": [("percent", "int"), ("mv", "int"), ("charging", "boolean")],
}
#: Bytes of unwritten sleep codes at the end of a record, from which on they are not codes.
UNWRITTEN = 6


def _event(stream: str, place: Column, back: Column, *values: Column) -> Column:
    body = F.struct(*(v.cast(t).alias(n) for (n, t), v in zip(BODIES[stream], values, strict=True)))
    return F.struct(F.lit(stream).alias("stream"), place.cast("int").alias("place"), back.cast("int").alias("back"), F.to_variant_object(body).alias("body"))


def _each(n: Column, make) -> Column:
    """``make`` of 0 to n - 1, without nulls."""
    return F.filter(F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), make)), lambda e: e.isNotNull())


def _low(k: int, high: int, low: int):
    """Bit places of the middle two bits of a beat."""
    return lambda b: F.shiftright(at(b, high), low).bitwiseAND(F.lit(6)) if low >= 0 else at(b, high).bitwiseAND(F.lit(3)) * 2


def _packed_beats(b: Column, channel: str) -> Column:
    """Six beats in fourteen bytes: eight high bits, two middle bits in bytes 12 and 13, a low bit beside each amplitude."""
    code = at(b, 13).bitwiseAND(F.lit(15))
    shift = F.when(code == 7, 0).otherwise(code + 1)
    out = []
    for k, (byte, down) in enumerate(((12, 5), (12, 3), (12, 1), (12, -1), (13, 5), (13, 3))):
        ms = at(b, 6 + k).bitwiseAND(F.lit(1)) + at(b, k) * 8 + _low(k, byte, down)(b)
        amplitude = F.call_function("shiftleft", F.shiftright(at(b, 6 + k), 1), shift)
        out.append(F.when(ms > 0, _event("beat", F.lit(k), F.lit(0), ms, amplitude, F.lit(channel))))
    return F.when(F.size(b) >= 14, F.filter(F.array(*out), lambda e: e.isNotNull()))


def _reversed_beats(b: Column) -> Column:
    beat = lambda k: F.when(at(b, 5 - k) > 0, _event("beat", k, F.lit(0), at(b, 5 - k) * 8, F.lit(None), F.lit("oxygen")))
    return F.when(F.size(b) >= 6, _each(F.lit(5), beat))


def _quality_beats(b: Column) -> Column:
    def beat(k):
        second = at(b, 2 * k + 1)
        ms = second.bitwiseAND(F.lit(7)) + at(b, 2 * k) * 8
        good = (F.shiftright(second, 3).bitwiseAND(F.lit(3)) == 1) & ms.between(300, 2000)
        return F.when(good, _event("beat", k, F.lit(0), ms, F.lit(None), F.lit("green")))

    return _each(F.least(F.floor(F.size(b) / 2), F.lit(7)).cast("int"), beat)


def _summaries(b: Column) -> Column:
    """Pairs of a rate and a variability; the last pair's five minutes end at the stamp, pads count."""
    n = F.size(b) / 2
    pair = lambda k: F.when((at(b, 2 * k) > 0) | (at(b, 2 * k + 1) > 0), _event("summary", k, (n - k) * 300, at(b, 2 * k), at(b, 2 * k + 1)))
    return F.when(F.size(b) % 2 == 0, _each(n.cast("int"), pair))


def _spread(values: Column, unit: str) -> Column:
    """Samples a second apart, the last at the stamp."""
    n = F.size(values)
    return _each(n, lambda k: _event("oxygen", k, n - 1 - k, F.get(values, k), F.lit(unit)))


def _oxygen(b: Column) -> Column:
    """Samples behind a header, up to the end mark."""
    stop = F.array_position(F.slice(b, 2, 1 << 20), 255)
    n = F.when(stop > 0, stop - 1).otherwise(F.size(b) - 1)
    return F.when(F.size(b) >= 2, _spread(F.slice(b, F.lit(2), n.cast("int")), "raw"))


def _oxygen_steps(b: Column) -> Column:
    """Sums of signed steps, scaled by the header, on a 24-bit base if the header says so."""
    based = at(b, 0).bitwiseAND(F.lit(0x40)) != 0
    scale = F.shiftright(at(b, 0), 4).bitwiseAND(F.lit(3))
    start = F.when(based, F.array(little(b, 1, 3))).otherwise(F.array().cast("array<bigint>"))
    first = F.when(based, 4).otherwise(1)
    steps = F.slice(b, first + 1, F.greatest(F.size(b) - first, F.lit(0)))
    size = lambda v: F.call_function("shiftleft", F.abs(v), scale) * F.signum(v).cast("int")
    last = lambda acc: F.coalesce(F.element_at(acc, -1), F.lit(0).cast("long"))
    sums = F.aggregate(steps, start, lambda acc, v: F.concat(acc, F.array(F.when(F.size(acc) > 0, last(acc)).otherwise(0) + size(signed(v, 8)))))
    return F.when((F.size(b) >= 1) & (~based | (F.size(b) >= 4)), _spread(sums, "dc"))


def _temperatures(b: Column, most: int | None, wide) -> Column:
    n = F.floor(F.size(b) / 2).cast("int")
    n = F.least(n, F.lit(most)) if most else n
    return F.when((F.size(b) >= 2) & (F.size(b) % 2 == 0), _each(n, lambda k: _event("temperature", k, F.lit(0), wide(little(b, 2 * k, 2)), F.lit("centi_c"))))


def _phases(b: Column) -> Column:
    """Four codes a byte behind a header; unwritten bytes at the end are no codes, codes end at the stamp."""
    codes = F.slice(b, 2, 1 << 20)
    n = F.size(codes)
    blank = F.aggregate(codes, F.lit(0), lambda a, v: F.when(v == 255, a + 1).otherwise(0))
    written = F.when((n >= 2) & (blank == n), 0).when(blank >= UNWRITTEN, n - blank).otherwise(n)

    def code(k):
        byte = F.get(codes, F.floor(k / 4).cast("int"))
        down = F.call_function("shiftright", byte, (6 - 2 * (k % 4)).cast("int"))
        return _event("phase", k, (4 * n - k) * 30, down.bitwiseAND(F.lit(3)))

    return F.when(F.size(b) >= 2, _each((4 * written).cast("int"), code))


def _motion(b: Column) -> Column:
    near = lambda k: signed(at(b, k), 8) * 8
    reserved = (F.coalesce(at(b, 4), F.lit(0)).bitwiseAND(F.lit(0x40)) != 0) | (F.coalesce(at(b, 5), F.lit(0)).bitwiseAND(F.lit(0x40)) != 0)
    strength = lambda k: at(b, k).bitwiseAND(F.lit(0x3F))
    event = _event("motion", F.lit(0), F.lit(0), F.shiftright(at(b, 0), 5), at(b, 0).bitwiseAND(F.lit(31)), near(1), near(2), near(3), strength(4), strength(5))
    return F.when((F.size(b) >= 4) & ~reserved, F.array(event))


def _rate(b: Column) -> Column:
    ms = at(b, 6).bitwiseAND(F.lit(15)) * 256 + at(b, 5)
    bpm = F.floor(60000 / F.nullif(ms, F.lit(0)) + 0.5)
    return F.when((F.size(b) >= 7) & bpm.between(1, 299), F.array(_event("rate", F.lit(0), F.lit(0), bpm)))


def _battery(b: Column) -> Column:
    return F.when((F.size(b) >= 3) & (at(b, 0) <= 100), F.array(_event("battery", F.lit(0), F.lit(0), at(b, 0), little(b, 4, 2), at(b, 1) > 0)))


def _one(good: Column, event: Column) -> Column:
    return F.when(good, F.array(event))


def decoded(tag: Column, b: Column) -> Column:
    """The events of a record with this tag and these bytes; null where there are none."""
    two = lambda wide: _one(F.size(b) >= 2, _event("temperature", F.lit(0), F.lit(0), wide(little(b, 0, 2)), F.lit("centi_c")))
    breath = (F.size(b) >= 10) & (at(b, 6) < 121) & (at(b, 7) <= 2)
    cases = {
        0x60: _packed_beats(b, "amplitude"), 0x44: _packed_beats(b, "bare"), 0x6E: _reversed_beats(b), 0x80: _quality_beats(b), 0x5D: _summaries(b),
        0x6F: _oxygen(b), 0x7B: _one(F.size(b) >= 2, _event("oxygen", F.lit(0), F.lit(0), big(b, 0, 2), F.lit("raw"))), 0x77: _oxygen_steps(b),
        0x46: _temperatures(b, 7, lambda v: signed(v, 16)), 0x69: two(lambda v: signed(v, 16)), 0x75: _temperatures(b, None, lambda v: v),
        0x47: _motion(b), 0x6A: _one(breath, _event("breath", F.lit(0), F.lit(0), at(b, 4) * 125, F.lit("milli_bpm"))), 0x0D: _battery(b), 0x55: _rate(b),
    }
    out = F.when(tag.isin(0x4B, 0x4E, 0x5A), _phases(b))
    for k, events in cases.items():
        out = out.when(tag == k, events)
    return F.when(F.size(out) > 0, out)


def decoded_records(records: DataFrame, tag: str = "tag", payload: str = "payload") -> DataFrame:
    """``records`` with a column ``events`` in the place of the payload."""
    names = [c for c in records.columns if c != payload]
    return records.withColumn("_bytes", octets(F.col(payload))).select(*names, decoded(F.col(tag), F.col("_bytes")).alias("events"))


def rows_of(records: DataFrame, ts: str = "ts") -> DataFrame:
    """A row an event: the records' columns, ts moved back by the event's share of the span, stream, place and body."""
    names = [c for c in records.columns if c not in ("events", ts)]
    # An inner explode would let the optimizer filter by the array's size below the decoding, and so repeat it.
    flat = records.select(*names, ts, F.explode_outer("events").alias("e")).filter("e IS NOT NULL")
    return flat.select(*names, (F.col(ts) - F.col("e.back")).alias(ts), F.col("e.stream").alias("stream"), F.col("e.place").alias("place"), F.col("e.body").alias("body"))


def stream_of(rows: DataFrame, stream: str) -> DataFrame:
    """One stream with the fields of its body as columns."""
    fields = [F.variant_get("body", f"$.{n}", t).alias(n) for n, t in BODIES[stream]]
    return rows.filter(F.col("stream") == stream).select(*(c for c in rows.columns if c not in ("body", "stream")), *fields)


def beats_in_order(beats: DataFrame, key: str, ts: str, arrived: str) -> DataFrame:
    """Beats with ``ord``: their position among the beats of their key and second, in the order of arrival."""
    from pyspark.sql import Window

    order = Window.partitionBy(key, ts).orderBy(arrived, "place")
    return beats.withColumn("ord", F.row_number().over(order) - 1)


def census(records: DataFrame, tag: str = "tag") -> DataFrame:
    """Of each tag: its records, those that gave events, its events, and whether it is stored, known or unknown."""
    kind = F.when(F.col(tag).isin(*STORED), "stored").when(F.col(tag).isin(*KNOWN), "known").otherwise("unknown")
    counted = records.groupBy(F.col(tag).alias("tag"), kind.alias("kind")).agg(F.count("*").alias("records"), F.count("events").alias("decoded"), F.sum(F.greatest(F.size("events"), F.lit(0))).alias("events"))
    return counted.withColumn("events", F.coalesce("events", F.lit(0)).cast("long"))
