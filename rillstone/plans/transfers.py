"""Transfers of records over all events: five days of a device are a session; clocks that are right, late, reset or ahead."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import query
from ..sources import history
from .bindings import STREAM, stream

#: How a session's device clock reads at a wall time ``w``, by the session's number modulo four.
CLOCKS = ("w - 30", "w - 3456137", "1000", "w + 259277")


def _sessions(spark, sf) -> DataFrame:
    ends = stream(spark, sf).groupBy(F.expr("device * 1000 + t DIV 432000 % 1000").alias("session")).agg(F.max("t").alias("w"), F.min("t").alias("first"))
    kind = F.col("session") % 4
    clock = F.when(kind == 0, F.expr(CLOCKS[0])).when(kind == 1, F.expr(CLOCKS[1])).when(kind == 2, F.expr(CLOCKS[2])).otherwise(F.expr(CLOCKS[3])).cast("long")
    bounds = lambda a, b: F.when(kind <= 1, F.col(a)).when(kind == 3, F.col(b))
    return ends.select("session", F.col("w").alias("wall_clock"), clock.alias("device_clock"), bounds("first", "w").alias("oldest"), bounds("w", "first").alias("newest"), (F.col("w") + 60).alias("now"))


STAMP = """CASE WHEN seq % 43 = 0 THEN NULL WHEN seq % 23 = 0 THEN 1600000000 + seq WHEN seq % 29 = 0 THEN t + 34560000 WHEN seq % 31 = 0 THEN t - 1728000
  WHEN session % 4 = 1 THEN t - 3456137 WHEN seq % 9 = 4 THEN t - wall_clock + device_clock ELSE t END"""
TYPE = "CASE WHEN seq % 9 <= 3 THEN 'HISTORICAL_DATA' WHEN seq % 9 = 4 THEN 'REALTIME_RAW_DATA' WHEN seq % 9 = 5 THEN 'EVENT' WHEN seq % 9 = 6 THEN 'COMMAND_RESPONSE' WHEN seq % 9 = 7 THEN 'METADATA' ELSE 'IMU_DATA' END"
#: Fields by expressions that both engines read alike.
FIELDS = {
    "type": TYPE, "ok": "seq % 37 <> 0", "crc_ok": "CASE WHEN seq % 41 = 0 THEN false WHEN seq % 2 = 0 THEN true END", "bpm": "CASE WHEN seq % 7 = 0 THEN 0 ELSE CAST(seq % 150 AS INT) END",
    "red": "CASE WHEN seq % 5 <> 0 THEN CAST(seq % 1000 AS INT) END", "ir": "CASE WHEN seq % 3 <> 0 THEN CAST(seq % 900 AS INT) END", "temperature": "CASE WHEN seq % 4 = 1 THEN CAST(seq % 700 AS INT) END", "aux1": "CASE WHEN seq % 8 = 1 THEN 5 END",
    "counter": "CASE WHEN seq % 6 = 2 THEN CAST(seq % 65536 AS INT) END", "state": "CASE WHEN seq % 10 = 3 THEN CAST(seq % 4 AS INT) END", "breath": "CASE WHEN seq % 11 = 1 THEN 14750 END", "gx": "CASE WHEN seq % 3 = 0 THEN value / 500 END", "dynamic": "CASE WHEN seq % 6 = 0 THEN value / 100 END",
    "event": "CASE seq % 3 WHEN 0 THEN 'BATTERY_LEVEL(3)' WHEN 1 THEN 'RTC_LOST' ELSE 'WRIST_ON' END", "soc": "CASE WHEN seq % 5 <> 4 THEN CAST(seq % 101 AS DOUBLE) END",
}


def _records(spark, sf) -> DataFrame:
    rows = stream(spark, sf).withColumn("session", F.expr("device * 1000 + t DIV 432000 % 1000")).join(_sessions(spark, sf).select("session", "wall_clock", "device_clock"), "session")
    rr = F.transform(F.expr("CASE WHEN seq % 3 = 0 THEN CAST(array() AS array<int>) ELSE sequence(1, CAST(seq % 3 AS INT)) END"), lambda k: (600 + F.col("seq") % 400 + k).cast("int"))
    waveform = F.expr("CASE WHEN seq % 13 = 1 THEN array(CAST(seq % 100 AS INT), -1, 7) END")
    rows = rows.select("session", "seq", F.expr(STAMP).cast("long").alias("stamp"), *(F.expr(e).alias(n) for n, e in FIELDS.items()), rr.alias("rr"), waveform.alias("waveform"))
    empty = {"version": "int", "aux2": "int", "activity": "int", "state_byte": "int", "gy": "double", "gz": "double", "burst": "int", "mv": "int", "charging": "boolean"}
    return rows.withColumns({n: F.lit(None).cast(t) for n, t in empty.items()})


def _timed(spark, sf) -> DataFrame:
    return history.timed(_records(spark, sf), _sessions(spark, sf))


_STEPS = "sign(gap) * ((abs(gap) + 150) // 300) * 300"
TIMED = f"""{STREAM}, se AS (SELECT device * 1000 + t // 432000 % 1000 AS session, max(t) AS w, min(t) AS first FROM s GROUP BY ALL),
ss AS (SELECT session, w AS wall_clock, CASE session % 4 WHEN 0 THEN {CLOCKS[0]} WHEN 1 THEN {CLOCKS[1]} WHEN 2 THEN {CLOCKS[2]} ELSE {CLOCKS[3]} END AS device_clock,
  CASE WHEN session % 4 <= 1 THEN first WHEN session % 4 = 3 THEN w END AS oldest, CASE WHEN session % 4 <= 1 THEN w WHEN session % 4 = 3 THEN first END AS newest FROM se),
r0 AS (SELECT s.*, ss.*, wall_clock - device_clock AS gap FROM s JOIN ss ON ss.session = device * 1000 + t // 432000 % 1000),
r AS (SELECT * EXCLUDE (bpm), {", ".join(f"{e} AS {n}" for n, e in FIELDS.items())}, {STAMP} AS stamp FROM r0),
c AS (SELECT *, ok AND coalesce(crc_ok, true) AS good, CASE WHEN type = 'COMMAND_RESPONSE' THEN wall_clock WHEN type = 'REALTIME_RAW_DATA' THEN stamp + gap
  WHEN abs(gap) <= 86400 THEN stamp WHEN stamp + {_STEPS} <= wall_clock + 300 THEN stamp + {_STEPS} ELSE stamp END AS cand FROM r),
v AS (SELECT *, CASE WHEN NOT good THEN 'corrupt' WHEN type = 'METADATA' THEN 'expected' WHEN type = 'IMU_DATA' THEN 'unhandled' WHEN type = 'COMMAND_RESPONSE' THEN NULL WHEN stamp IS NULL THEN 'no stamp'
  WHEN cand < 1700000000 THEN 'before floor' WHEN cand > wall_clock + 60 + 86400 THEN 'after now' WHEN oldest >= 1700000000 AND newest >= oldest AND (cand < oldest - 604800 OR cand > newest + 604800) THEN 'outside session' END AS reason FROM c),
v2 AS (SELECT * EXCLUDE (cand), CASE WHEN good AND type NOT IN ('METADATA', 'IMU_DATA') THEN CAST(cand AS BIGINT) END AS candidate FROM v)"""
_OLD, _RAW = "type = 'HISTORICAL_DATA'", "type = 'REALTIME_RAW_DATA'"


def _part(stream: str, when: str, a: str = "NULL", b: str = "NULL", c: str = "NULL", d: str = "NULL", text: str = "NULL") -> str:
    return f"SELECT session, seq, candidate AS ts, '{stream}' AS stream, 0 AS place, CAST({a} AS DOUBLE) AS a, CAST({b} AS DOUBLE) AS b, CAST({c} AS DOUBLE) AS c, CAST({d} AS DOUBLE) AS d, CAST({text} AS VARCHAR) AS text FROM v2 WHERE reason IS NULL AND ({when})"


PARTS = " UNION ALL ".join(
    (
        _part("hr", f"{_OLD} AND bpm <> 0 OR {_RAW}", "bpm"),
        _part("spo2", f"{_OLD} AND red IS NOT NULL", "red", "coalesce(ir, 0)"),
        _part("temperature", f"{_OLD} AND temperature IS NOT NULL", "temperature", "aux1"),
        _part("steps", f"{_OLD} AND counter IS NOT NULL", "counter"),
        _part("state", f"{_OLD} AND state IS NOT NULL", "state"),
        _part("breath", f"{_OLD} AND breath IS NOT NULL", "breath"),
        _part("gravity", f"{_OLD} AND gx IS NOT NULL", "gx", "0", "0", "dynamic"),
        _part("waveform", f"{_OLD} AND seq % 13 = 1", text="(seq % 100) || ',-1,7'"),
        _part("event", "type = 'EVENT'", text="event"),
        _part("battery", "(type = 'EVENT' AND event LIKE 'BATTERY%' OR type = 'COMMAND_RESPONSE') AND soc IS NOT NULL", "soc"),
        f"SELECT session, seq, candidate, 'rr', k - 1, CAST(600 + seq % 400 + k AS DOUBLE), NULL, NULL, NULL, NULL FROM v2, range(1, 3) AS q(k) WHERE reason IS NULL AND ({_OLD} OR {_RAW}) AND k <= seq % 3",
    )
)


@query(f"WITH {TIMED}, p AS ({PARTS}) SELECT session, seq, ts, stream, CAST(place AS INT) AS place, round(a, 6) AS a, b, c, round(d, 6) AS d, text FROM p")
def transfer_streams(spark, sf):
    """All streams of accepted records, from one pass over the records."""
    rows = history.streams(_timed(spark, sf))
    return rows.select("session", "seq", "ts", "stream", "place", F.round("a", 6).alias("a"), "b", "c", F.round("d", 6).alias("d"), F.coalesce("text", F.array_join("samples", ",")).alias("text"))


@query(f"WITH {TIMED} SELECT session, seq, type, CAST(candidate AS VARCHAR) AS candidate, reason FROM v2 WHERE reason <> 'expected'")
def transfer_rejected(spark, sf):
    return history.rejected(_timed(spark, sf)).withColumn("candidate", F.col("candidate").cast("string"))


@query(f"""WITH {TIMED}, o AS (SELECT *, coalesce(reason IN ('before floor', 'after now', 'outside session'), false) AS away FROM v2)
SELECT session, count(*) AS records, count(*) FILTER (reason IS NULL) AS accepted, count(*) FILTER (away) AS implausible, CAST(min(candidate) FILTER (away) AS VARCHAR) AS off_oldest, CAST(max(candidate) FILTER (away) AS VARCHAR) AS off_newest,
count(*) FILTER (reason = 'unhandled') AS unhandled, count(*) FILTER (reason = 'corrupt') AS corrupt, count(*) FILTER (away AND type = 'EVENT' AND event = 'RTC_LOST') AS clock_events FROM o GROUP BY session""")
def transfer_accounting(spark, sf):
    return history.accounting(_timed(spark, sf)).withColumns({c: F.col(c).cast("string") for c in ("off_oldest", "off_newest")})
