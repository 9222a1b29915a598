"""Edges of ring records, transfers, optical frames, packed bits and the pulse."""

import binascii
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillstone.functions import bits
from rillstone.operators import pulse
from rillstone.sources import binary, history, optical
from rillstone.sources import ring_records as ring


def events(spark, *records):
    df = spark.createDataFrame([(k, t, 10_000, None if p is None else bytearray(p)) for k, (t, p) in enumerate(records)], "seq int, tag int, ts long, payload binary")
    return ring.decoded_records(df)


def test_ring_edges(spark):
    extremes = struct.pack("<7h", -32768, 32767, 0, 1, -1, 3650, 100) + struct.pack("<h", 5)
    found = events(spark, (0x46, extremes), (0x46, b"\x01"), (0x46, b""), (0x46, None), (None, b"\0\0"), (0x77, bytes([0x70, 1, 0, 0, 0x80, 0x7F])), (0x77, bytes([0x40, 1])), (0x4E, b"\0" + b"\xff" * 2), (0x4E, b"\0\x1b" + b"\xff" * 6), (0xEE, b"\0" * 20), (0x5D, bytes([60, 40, 0, 0])))
    rows = ring.rows_of(found)
    assert [r["raw"] for r in ring.stream_of(rows, "temperature").orderBy("place").collect()] == [-32768, 32767, 0, 1, -1, 3650, 100]
    oxygen = ring.stream_of(rows, "oxygen").orderBy("place").collect()
    assert [(r["value"], r["ts"]) for r in oxygen] == [(1, 9998), (1 - 128 * 8, 9999), (1 - 8, 10_000)]
    assert [(r["code"], r["ts"]) for r in ring.stream_of(rows, "phase").orderBy("place").collect()] == [(k, 10_000 - 30 * (28 - k)) for k in range(4)]
    assert [(r["bpm"], r["ts"]) for r in ring.stream_of(rows, "summary").collect()] == [(60, 9400)]
    by = {r["tag"]: (r["kind"], r["records"], r["decoded"]) for r in ring.census(found).collect()}
    assert by[0x46] == ("stored", 4, 1) and by[0xEE] == ("unknown", 1, 0) and by[None] == ("unknown", 1, 0)
    assert ring.rows_of(events(spark, (0xEE, b"x"))).count() == 0


def test_one_scan_for_all_streams(spark, tmp_path):
    spark.createDataFrame([(0x46, 1, bytearray(b"\1\0"))], "tag int, ts long, payload binary").write.parquet(str(tmp_path / "r"))
    plan = ring.rows_of(ring.decoded_records(spark.read.parquet(str(tmp_path / "r"))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Python" not in plan


@pytest.mark.parametrize("device, wall, stamp, want", [(1_710_000_000, 1_710_000_100, 1_709_999_000, 1_709_999_000), (1_710_000_000 - 90_001, 1_710_000_000, 1_709_000_000, 1_709_090_000 + 0), (1000, 1_710_000_000, 1_709_000_000, 1_709_000_000), (1_710_200_000, 1_710_000_000, 1_709_500_000, 1_709_300_100)])
def test_clock_correction(spark, device, wall, stamp, want):
    gap = wall - device
    steps = int(math.copysign((abs(gap) + 150) // 300 * 300, gap)) if abs(gap) > 86_400 else 0
    plain = stamp + steps if stamp + steps <= wall + 300 else stamp
    got = spark.range(1).select(history.corrected(F.lit(stamp), F.lit(device), F.lit(wall))).first()[0]
    assert got == plain and abs(got - want) <= 300


def test_times_on_both_sides_and_missing_sessions(spark):
    record = lambda seq, stamp, session=1, kind=history.HISTORY, **more: {"session": session, "seq": seq, "type": kind, "ok": True, "stamp": stamp, "bpm": 60, **more}
    rows = [record(1, 1_700_000_000), record(2, 1_699_999_999), record(3, 1_710_086_460), record(4, 1_710_086_461), record(5, None), record(6, 1_705_000_000, session=9), record(7, 1_709_000_000, session=2), record(8, 1_707_000_000, session=2), record(9, 1_709_000_000, kind=None), record(10, 1_709_000_000, crc_ok=False), record(11, 1_709_000_000, kind="METADATA")]
    sessions = spark.createDataFrame([(1, 1_710_000_000, 1_710_000_000, None, None, 1_710_000_060), (2, 1_710_000_000, 1_710_000_000, 1_709_000_000, 1_709_500_000, 1_710_000_060)], "session long, device_clock long, wall_clock long, oldest long, newest long, now long")
    timed = history.timed(spark.createDataFrame(rows, history.RECORD), sessions)
    got = {r["seq"]: r["reason"] for r in timed.collect()}
    assert got == {1: None, 2: "before floor", 3: None, 4: "after now", 5: "no stamp", 6: "no session", 7: None, 8: "outside session", 9: "unhandled", 10: "corrupt", 11: "expected"}
    assert sorted(r["seq"] for r in history.stream_of(history.streams(timed), "hr").collect()) == [1, 3, 7]
    assert {r["session"]: (r["implausible"], r["off_oldest"], r["off_newest"]) for r in history.accounting(timed).collect()}[1] == (2, 1_699_999_999, 1_710_086_461)
    assert history.rejected(timed).count() == 7


def frame(counts=(50, 1, 0, 50, 3), seed=1):
    draw = random.Random(seed)
    data = bytearray(optical.LENGTH)
    data[:6] = bytes([optical.START, 1, 0x54, 8, 0, 1])
    struct.pack_into("<H", data, 6, binary.crc16(bytes(data[:6])))
    data[8], data[9] = optical.CLASS, optical.LAYOUT
    struct.pack_into("<II", data, 11, 7, 1_700_000_000)
    want = []
    for k, n in enumerate(counts):
        at = optical.FIRST + k * optical.BLOCK
        data[at] = n
        pair = [[draw.choice([524287, -524288, 0, -1, -22101, draw.randint(-(2**19), 2**19 - 1)]) for _ in range(n)] for _ in range(2)]
        for slot, values in enumerate(pair):
            struct.pack_into(f"<{n}i", data, at + optical.HEAD + slot * optical.SLOT, *values)
        want.append(tuple(pair))
    struct.pack_into("<I", data, optical.SUM_AT, binascii.crc32(bytes(data[8 : optical.SUM_AT])))
    return bytes(data), want


def test_optical_frames(spark):
    good, want = frame()
    above, _ = frame()
    above = bytearray(above)
    above[optical.FIRST] = 51
    struct.pack_into("<I", above, optical.SUM_AT, binascii.crc32(bytes(above[8 : optical.SUM_AT])))
    bad = [good[:-1], good + b"\0", bytes(above), b"", good[:100] + b"\x01" + good[101:], good[:6] + b"\0\0" + good[8:], None]
    rows = spark.createDataFrame([(k, None if b is None else bytearray(b)) for k, b in enumerate([good, *bad])], "k int, data binary")
    got = optical.blocks(rows).orderBy("block").collect()
    assert {r["k"] for r in got} == {0} and [(r["a"], r["b"]) for r in got] == want
    assert (got[0]["number"], got[0]["second"]) == (7, 1_700_000_000)


def test_bits_of_odd_widths(spark):
    draw, widths = random.Random(2), [19, 5, 12, 23, 1, 8]
    rounds = [[draw.choice([0, -1, 2 ** (w - 1) - 1, -(2 ** (w - 1))]) for w in widths] for _ in range(9)]
    text = "10110" + "".join(f"{v % (1 << w):0{w}b}" for r in rounds for v, w in zip(r, widths, strict=True))
    data = int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")
    rows = spark.createDataFrame([(bytearray(data),), (bytearray(data[:-9]),), (bytearray(),)], "data binary")
    whole, cut, empty = (r["c"] for r in rows.select(bits.channels(bits.octets(F.col("data")), 5, widths, F.lit(99)).alias("c")).collect())
    assert whole == [list(x) for x in zip(*rounds, strict=True)]
    n = (len(data[:-9]) * 8 - 5) // sum(widths)
    assert cut == [list(x) for x in zip(*rounds[:n], strict=True)] and empty == [[]] * 6


def slow_rate(window):
    """The rate of a window of samples by the plain definition."""
    x = np.asarray(window, float)
    clean = pulse.without_comb(x)
    x = x if clean is None else clean
    i = np.arange(len(x))
    x = x - np.polyval(np.polyfit(i, x, 1), i)
    x = x - x.mean()
    at = pulse.lags()
    at = at[at < len(x) - 1]
    values = np.array([(x[: len(x) - lag] * x[lag:]).sum() / (x * x).sum() if (x * x).sum() > 1e-6 else 0 for lag in at])
    found = pulse.period(values, at)
    return found and (24 * 60 / found[0], found[1])


@pytest.mark.parametrize("kind", ["pulse", "noise", "comb", "flat"])
def test_pulse_equals_the_plain_definition(kind):
    draw = np.random.default_rng(3)
    seconds = np.array([*range(100, 130), *range(140, 142), *range(150, 153), *range(160, 175)])
    t = np.repeat(seconds, 24) + np.tile(np.arange(24) / 24, len(seconds))
    y = {"pulse": 900 * np.sin(2 * np.pi * 1.17 * t) + 40 * t, "noise": 0 * t, "comb": np.repeat(draw.integers(-4000, 4000, len(seconds)), 24) + 300 * np.sin(2 * np.pi * 0.8 * t), "flat": 0 * t + 7}[kind]
    y = np.round(y + (draw.normal(0, 60, len(t)) if kind != "flat" else 0)).astype(np.int64).reshape(-1, 24)
    got = {s: (b, c) for s, b, c in pulse.rates(seconds, y)}
    want = {}
    for s in seconds.tolist():
        run = [u for u in seconds.tolist() if abs(u - s) <= 60 and all(v in set(seconds.tolist()) for v in range(min(u, s), max(u, s) + 1))]
        if len(run) >= 3:
            window = [k for k, u in enumerate(seconds.tolist()) if u in run and abs(u - s) <= 4]
            if found := slow_rate(y[window].ravel()):
                want[s] = found
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(want[s], rel=1e-6, abs=1e-6)
    if kind == "pulse":
        assert all(abs(b - 70.2) < 1.5 for b, _ in got.values())


def test_pulse_over_buckets(spark):
    seconds = [s for s in range(880, 1830) if s not in (899, 1200, 1201, 1797)]
    rows = [(k, s, s, [int(1000 * math.sin(2 * math.pi * (1.1 + k / 3) * (s + j / 24))) for j in range(24)]) for k in range(2) for s in seconds] + [(0, 900, -1, [0] * 24), (0, 5000, 1, [1, 2]), (1, 6000, 1, None)]
    df = spark.createDataFrame(rows, "device int, second long, seq int, samples array<int>")
    got = {(r["device"], r["second"]): (r["bpm"], r["confidence"]) for r in pulse.pulse(df, "device", "second", "samples", "seq").collect()}
    for k in range(2):
        mine = [r for r in rows if r[0] == k and r[2] == r[1]]
        want = pulse.rates(np.array([r[1] for r in mine]), np.array([r[3] for r in mine]))
        assert {s: (round(b), round(c, 3)) for s, b, c in want} == {s: v for (d, s), v in got.items() if d == k}
    assert pulse.pulse(df.limit(0), "device", "second", "samples", "seq").count() == 0


def test_a_dense_hour_is_packed_in_proportion_to_its_rows(spark, tmp_path):
    """Each byte used to build the hour's text of bits anew, with work by the square of the rows."""
    import time

    from oracle import connect, rows

    from rillstone import catalog

    spark.range(6000).selectExpr("id AS event_id", "timestamp_seconds(1704067200 + id DIV 2) AS ts", "id * 8 AS user_id", "'view' AS event_type", "CAST(id AS DOUBLE) AS value", "'' AS props").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    start = time.monotonic()
    got = catalog.queries()["packed_channels"](spark, str(tmp_path)).toPandas()
    assert time.monotonic() - start < 60
    con = connect("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert rows(got) == rows(con.execute(catalog.oracle_sql()["packed_channels"]).df())


def test_samples_are_made_once_and_where_seconds_are_dealt(spark, sf):
    """A filter on the samples was moved into the stage with a task a device, and made them there a second time."""
    from rillstone import catalog

    plan = catalog.queries()["pulse_rates"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("SIN(") == 1
    assert plan.index("SIN(") < plan.index("RepartitionByExpression [device")
