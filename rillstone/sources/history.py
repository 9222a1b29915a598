"""Records of a transfer as typed streams: dispatch by packet type, clock correction, and bounds that belong to the session.

``records`` are wide rows (``RECORD``); ``sessions`` have session, device_clock and wall_clock (two readings of the same
moment), oldest and newest (what the device says that it holds; either may be null) and now. ``timed`` joins the session
to each of its records and gives every record a time or the reason why it has none:

* ``corrupt``: not decoded, or a checksum that failed; ``unhandled``: a type without rows, ``expected`` where that is by design;
* ``no session``, ``no stamp``;
* ``before floor``, ``after now``: no time of a record at all; ``outside session``: a week and more off what the device holds.

Times of records are the device's own seconds. They are corrected by the clocks' difference only where that is above a
day, in steps of five minutes, so that a repeated transfer gives the same times, and not where that would lead past the
wall clock. Raw packets carry device time and move by the whole difference; answers to commands are stamped by the wall.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECORD = """session long, seq long, type string, ok boolean, crc_ok boolean, stamp long, version int, bpm int, rr array<int>, red int, ir int, temperature int, aux1 int, aux2 int, counter int, activity int,
 state int, state_byte int, breath int, gx double, gy double, gz double, dynamic double, waveform array<int>, burst int, event string, soc double, mv int, charging boolean"""
# Bounds of plausible times, the clock difference that is corrected, and the grid of corrections, in seconds.
FLOOR, AHEAD, SLACK, STALE, GRID = 1_700_000_000, 86_400, 7 * 86_400, 86_400, 300
# Packet types, and those that give no rows by design.
HISTORY, RAW, EVENT, ANSWER = "HISTORICAL_DATA", "REALTIME_RAW_DATA", "EVENT", "COMMAND_RESPONSE"
EXPECTED = ("METADATA", "CONSOLE_LOGS")
# Events that tell of a lost or set clock; their loss is reported by name.
CLOCK_EVENTS = ("RTC_LOST", "BOOT", "SET_RTC")
#: Streams, and which of the common columns their fields are in.
STREAMS = {
    "hr": {"bpm": "a"}, "rr": {"ms": "a"}, "spo2": {"red": "a", "ir": "b"}, "temperature": {"raw": "a", "aux1": "b", "aux2": "c"}, "steps": {"counter": "a", "activity": "b"},
    "state": {"state": "a", "byte": "b"}, "breath": {"raw": "a"}, "gravity": {"x": "a", "y": "b", "z": "c", "dynamic": "d"}, "waveform": {"samples": "samples", "burst": "a"},
    "event": {"kind": "text"}, "battery": {"percent": "a", "mv": "b", "charging": "c"},
}


def plausible(ts: Column, now: Column, oldest: Column, newest: Column) -> Column:
    """The reason why a time cannot be, or null. Bounds of the session count only if both are there and in order."""
    trusted = (oldest >= FLOOR) & (newest >= oldest)
    return F.when(ts < FLOOR, "before floor").when(ts > now + AHEAD, "after now").when(trusted & ((ts < oldest - SLACK) | (ts > newest + SLACK)), "outside session")


def corrected(stamp: Column, device_clock: Column, wall_clock: Column) -> Column:
    """The device's seconds on the wall clock."""
    gap = wall_clock - device_clock
    steps = F.signum(gap).cast("long") * F.floor((F.abs(gap) + GRID // 2) / GRID) * GRID
    moved = stamp + steps
    return F.when(F.abs(gap) <= STALE, stamp).when(moved <= wall_clock + GRID, moved).otherwise(stamp)


def timed(records: DataFrame, sessions: DataFrame) -> DataFrame:
    """``records`` with candidate (the time that was judged), ts (null if rejected) and reason (null if accepted)."""
    c = F.col
    rows = records.join(sessions.select("session", "device_clock", "wall_clock", "oldest", "newest", "now", F.lit(True).alias("_met")), "session", "left")
    handled = c("type").isin(HISTORY, RAW, EVENT, ANSWER)
    candidate = F.when(c("type") == ANSWER, c("wall_clock")).when(c("type") == RAW, c("stamp") + c("wall_clock") - c("device_clock")).otherwise(corrected(c("stamp"), c("device_clock"), c("wall_clock")))
    good = F.coalesce("ok", F.lit(False)) & F.coalesce("crc_ok", F.lit(True))
    bad = F.when(~good, "corrupt").when(~F.coalesce(handled, F.lit(False)), F.when(c("type").isin(*EXPECTED), "expected").otherwise("unhandled")).when(c("_met").isNull(), "no session")
    judged = F.when((c("type") != ANSWER) & c("stamp").isNull(), "no stamp").when(c("type") != ANSWER, plausible(c("candidate"), F.greatest("now", "wall_clock"), c("oldest"), c("newest")))
    rows = rows.withColumn("candidate", F.when(good & handled, candidate)).withColumn("reason", F.coalesce(bad, judged))
    return rows.withColumn("ts", F.when(c("reason").isNull(), c("candidate"))).drop("_met", "device_clock", "wall_clock", "oldest", "newest", "now")


def _row(stream: str, when: Column, a=None, b=None, c=None, d=None, text=None, samples=None, place=None) -> Column:
    number = lambda x: (F.lit(None) if x is None else x).cast("double")
    row = F.struct(F.lit(stream).alias("stream"), (F.lit(0) if place is None else place).cast("int").alias("place"), number(a).alias("a"), number(b).alias("b"), number(c).alias("c"), number(d).alias("d"), (F.lit(None) if text is None else text).cast("string").alias("text"), (F.lit(None) if samples is None else samples).cast("array<int>").alias("samples"))
    return F.when(when, row)


def streams(rows: DataFrame) -> DataFrame:
    """The rows of all streams from accepted records, in one pass: session, seq, ts, stream, place and the common columns."""
    c = F.col
    old, raw, event = c("type") == HISTORY, c("type") == RAW, c("type") == EVENT
    told = lambda *names: old & F.coalesce(*names).isNotNull()
    there = c("bpm").isNotNull()
    single = [
        _row("hr", (old & there & (c("bpm") != 0)) | (raw & there), c("bpm")),
        _row("spo2", told("red"), c("red"), F.coalesce("ir", F.lit(0))),
        _row("temperature", told("temperature"), c("temperature"), c("aux1"), c("aux2")),
        _row("steps", told("counter"), c("counter"), c("activity")),
        _row("state", told("state"), c("state"), c("state_byte")),
        _row("breath", told("breath"), c("breath")),
        _row("gravity", told("gx"), c("gx"), F.coalesce("gy", F.lit(0.0)), F.coalesce("gz", F.lit(0.0)), c("dynamic")),
        _row("waveform", old & (F.size("waveform") > 0), c("burst"), samples=c("waveform")),
        _row("event", event, text=c("event")),
        _row("battery", (event & c("event").startswith("BATTERY_LEVEL") | (c("type") == ANSWER)) & c("soc").isNotNull(), c("soc"), c("mv"), c("charging").cast("int")),
    ]
    beats = F.transform(F.when(old | raw, F.coalesce("rr", F.array().cast("array<int>"))), lambda ms, k: _row("rr", F.lit(True), ms, place=k))
    events = F.concat(F.filter(F.array(*single), lambda e: e.isNotNull()), F.coalesce(beats, F.array().cast(beats_type())))
    flat = rows.filter(c("ts").isNotNull()).select("session", "seq", "ts", F.explode(events).alias("e"))
    return flat.select("session", "seq", "ts", "e.*")


def beats_type() -> str:
    return "array<struct<stream:string,place:int,a:double,b:double,c:double,d:double,text:string,samples:array<int>>>"


def stream_of(rows: DataFrame, stream: str) -> DataFrame:
    """One stream with its own column names."""
    return rows.filter(F.col("stream") == stream).select("session", "seq", "ts", "place", *(F.col(c).alias(n) for n, c in STREAMS[stream].items()))


def rejected(rows: DataFrame) -> DataFrame:
    """What was not taken, and why; types that give no rows by design are not reported."""
    return rows.filter(F.col("reason").isNotNull() & (F.col("reason") != "expected")).select("session", "seq", "type", "candidate", "reason")


def accounting(rows: DataFrame) -> DataFrame:
    """Of each session: records, accepted, implausible with the span of their times, unhandled, corrupt, and lost clock events."""
    c = F.col
    off = c("reason").isin("before floor", "after now", "outside session")
    n = lambda p, name: F.count_if(p).alias(name)
    return rows.groupBy("session").agg(
        F.count("*").alias("records"), n(c("reason").isNull(), "accepted"), n(off, "implausible"), F.min(F.when(off, c("candidate"))).alias("off_oldest"), F.max(F.when(off, c("candidate"))).alias("off_newest"),
        n(c("reason") == "unhandled", "unhandled"), n(c("reason") == "corrupt", "corrupt"), n(off & (c("type") == EVENT) & c("event").isin(*CLOCK_EVENTS), "clock_events"),
    )
