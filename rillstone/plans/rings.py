"""Ring records over all events: the tags in turn, payloads of every length up to eighteen bytes made from the row's number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import query
from ..sources import ring_records as ring
from .bindings import STREAM, stream

#: Every tag, and two that no list has.
TAGS = [*ring.STORED, *ring.KNOWN, 0x99, 0xEE]


def records(spark, sf) -> DataFrame:
    """device, seq, tag, ts and payload; every tenth payload is mostly unwritten bytes."""
    n = F.expr(f"CAST(seq DIV {len(TAGS)} AS INT)") % 19
    byte = lambda k: F.when((F.col("seq") % 10 == 0) & (k >= 3), 255).otherwise(F.pmod(F.col("seq") * (k + 3) * 7 + k * 31 + F.col("device"), F.lit(256)))
    hexed = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.lpad(F.hex(byte(k)), 2, "0")), "")
    tags = F.array(*map(F.lit, TAGS))
    return stream(spark, sf).select("device", "seq", F.get(tags, (F.col("seq") % len(TAGS)).cast("int")).alias("tag"), F.col("t").alias("ts"), F.unhex(F.when(n > 0, hexed).otherwise("")).alias("payload"))


# The same bytes as lists, and the same events: b[1] is the first byte.
RECORDS = f"""{STREAM}, r AS (SELECT device, seq, {TAGS}[seq % {len(TAGS)} + 1] AS tag, t AS ts,
  list_transform(range(0, seq // {len(TAGS)} % 19), lambda k : CASE WHEN seq % 10 = 0 AND k >= 3 THEN 255 ELSE (seq * (k + 3) * 7 + k * 31 + device) % 256 END) AS b FROM s),
rn AS (SELECT *, len(b) AS n FROM r)"""
_EVENT = "{{'stream': '{0}', 'place': CAST({1} AS INT), 'back': CAST({2} AS INT), 'a': CAST({3} AS INT), 'b': CAST({4} AS INT), 'text': {5}}}"


def _sql_event(stream: str, place: str, back: str, a: str, b: str = "NULL", text: str = "NULL::VARCHAR") -> str:
    return _EVENT.format(stream, place, back, a, b, text)


def _sql_each(n: str, event: str, keep: str = "true") -> str:
    """Events of k = 0 to n - 1 that pass a test."""
    return f"list_transform(list_filter(range(0, CAST({n} AS BIGINT)), lambda k : {keep}), lambda k : {event})"


_SIGNED = "(CASE WHEN {0} >= {1} THEN {0} - 2 * {1} ELSE {0} END)"
_I8 = lambda v: _SIGNED.format(v, 128)
_I16 = lambda k: _SIGNED.format(f"(b[{k}] + 256 * b[{k} + 1])", 32768)
_MIDDLE = "[(b[13] >> 5) & 6, (b[13] >> 3) & 6, (b[13] >> 1) & 6, (b[13] & 3) * 2, (b[14] >> 5) & 6, (b[14] >> 3) & 6][k + 1]"
_MS = f"((b[7 + k] & 1) + b[1 + k] * 8 + {_MIDDLE})"
_AMPLITUDE = "((b[7 + k] >> 1) << CASE WHEN b[14] & 15 = 7 THEN 0 ELSE (b[14] & 15) + 1 END)"
_PACKED = lambda name: f"CASE WHEN n >= 14 THEN {_sql_each('6', _sql_event('beat', 'k', '0', _MS, _AMPLITUDE, repr(name)), _MS + ' > 0')} END"
_GREEN = "((b[2 * k + 2] & 7) + b[2 * k + 1] * 8)"
_STOP = "(CASE WHEN list_position(b[2:], 255) > 0 THEN list_position(b[2:], 255) - 1 ELSE n - 1 END)"
_BASED = "(b[1] & 64) <> 0"
_STEP = f"(abs({_I8('b[j]')}) << ((b[1] >> 4) & 3)) * sign({_I8('b[j]')})"
_SUMS = f"(CASE WHEN {_BASED} THEN list_transform(range(0, n - 3), lambda k : b[2] + 256 * b[3] + 65536 * b[4] + coalesce(list_sum(list_transform(range(5, 5 + k), lambda j : {_STEP})), 0)) ELSE list_transform(range(0, n - 1), lambda k : list_sum(list_transform(range(2, k + 3), lambda j : {_STEP}))) END)"
_BLANK = "(CASE WHEN len(list_filter(range(2, n + 1), lambda j : b[j] <> 255)) = 0 THEN n - 1 ELSE n - list_max(list_filter(range(2, n + 1), lambda j : b[j] <> 255)) END)"
_WRITTEN = f"(CASE WHEN n >= 3 AND {_BLANK} = n - 1 THEN 0 WHEN {_BLANK} >= {ring.UNWRITTEN} THEN n - 1 - {_BLANK} ELSE n - 1 END)"
EVENTS = f"""{RECORDS}, e AS (SELECT device, seq, tag, ts, CASE
  WHEN tag = 96 THEN {_PACKED("amplitude")} WHEN tag = 68 THEN {_PACKED("bare")}
  WHEN tag = 110 THEN CASE WHEN n >= 6 THEN {_sql_each("5", _sql_event("beat", "k", "0", "b[6 - k] * 8", "NULL", "'oxygen'"), "b[6 - k] > 0")} END
  WHEN tag = 128 THEN {_sql_each("least(n // 2, 7)", _sql_event("beat", "k", "0", _GREEN, "NULL", "'green'"), f"(b[2 * k + 2] >> 3) & 3 = 1 AND {_GREEN} BETWEEN 300 AND 2000")}
  WHEN tag = 93 THEN CASE WHEN n % 2 = 0 THEN {_sql_each("n // 2", _sql_event("summary", "k", "(n // 2 - k) * 300", "b[2 * k + 1]", "b[2 * k + 2]"), "b[2 * k + 1] > 0 OR b[2 * k + 2] > 0")} END
  WHEN tag = 111 THEN CASE WHEN n >= 2 THEN {_sql_each(_STOP, _sql_event("oxygen", "k", f"{_STOP} - 1 - k", "b[k + 2]", "NULL", "'raw'"))} END
  WHEN tag = 123 THEN CASE WHEN n >= 2 THEN [{_sql_event("oxygen", "0", "0", "b[1] * 256 + b[2]", "NULL", "'raw'")}] END
  WHEN tag = 119 THEN CASE WHEN n >= 1 AND (NOT {_BASED} OR n >= 4) THEN {_sql_each(f"len({_SUMS})", _sql_event("oxygen", "k", f"len({_SUMS}) - 1 - k", f"{_SUMS}[k + 1]", "NULL", "'dc'"))} END
  WHEN tag = 70 THEN CASE WHEN n >= 2 AND n % 2 = 0 THEN {_sql_each("least(n // 2, 7)", _sql_event("temperature", "k", "0", _I16("2 * k + 1"), "NULL", "'centi_c'"))} END
  WHEN tag = 105 THEN CASE WHEN n >= 2 THEN [{_sql_event("temperature", "0", "0", _I16("1"), "NULL", "'centi_c'")}] END
  WHEN tag = 117 THEN CASE WHEN n >= 2 AND n % 2 = 0 THEN {_sql_each("n // 2", _sql_event("temperature", "k", "0", "b[2 * k + 1] + 256 * b[2 * k + 2]", "NULL", "'centi_c'"))} END
  WHEN tag IN (75, 78, 90) THEN CASE WHEN n >= 2 THEN {_sql_each(f"4 * {_WRITTEN}", _sql_event("phase", "k", "(4 * (n - 1) - k) * 30", "(b[k // 4 + 2] >> (6 - 2 * (k % 4))) & 3"))} END
  WHEN tag = 71 THEN CASE WHEN n >= 4 AND (n < 5 OR b[5] & 64 = 0) AND (n < 6 OR b[6] & 64 = 0) THEN [{_sql_event("motion", "0", "0", "b[1] & 31", _I8("b[2]") + " * 8", f"concat_ws('|', b[1] >> 5, {_I8('b[3]')} * 8, {_I8('b[4]')} * 8, b[5] & 63, b[6] & 63)")}] END
  WHEN tag = 106 THEN CASE WHEN n >= 10 AND b[7] < 121 AND b[8] <= 2 THEN [{_sql_event("breath", "0", "0", "b[5] * 125", "NULL", "'milli_bpm'")}] END
  WHEN tag = 13 THEN CASE WHEN n >= 3 AND b[1] <= 100 THEN [{_sql_event("battery", "0", "0", "b[1]", "b[5] + 256 * b[6]", "CASE WHEN b[2] > 0 THEN 'true' ELSE 'false' END")}] END
  WHEN tag = 85 THEN CASE WHEN n >= 7 AND floor(60000 / nullif((b[7] & 15) * 256 + b[6], 0) + 0.5) BETWEEN 1 AND 299 THEN [{_sql_event("rate", "0", "0", "floor(60000 / ((b[7] & 15) * 256 + b[6]) + 0.5)")}] END
  END AS events FROM rn),
x AS (SELECT device, seq, tag, ts, unnest(events) AS e FROM e)"""
#: Of each stream, what goes to the columns a, b and text of the flat table.
FLAT = {
    "rate": ("bpm", None, None), "beat": ("ms", "amplitude", "channel"), "summary": ("bpm", "rmssd", None), "oxygen": ("value", None, "unit"), "temperature": ("raw", None, "unit"), "phase": ("code", None, None),
    "motion": ("seconds", "x", ("orientation", "y", "z", "low", "high")), "breath": ("raw", None, "unit"), "battery": ("percent", "mv", "charging"),
}


@query(f"WITH {EVENTS} SELECT device, seq, tag, e.stream AS stream, ts - e.back AS ts, e.place AS place, e.a AS a, CAST(e.b AS VARCHAR) AS b, e.text AS text FROM x")
def ring_events(spark, sf):
    """All streams from one scan, their fields in common columns."""
    field = lambda n, t="int": F.variant_get("body", f"$.{n}", t)
    a, b, text = F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(None).cast("string")
    for name, (first, second, words) in FLAT.items():
        here = F.col("stream") == name
        a = F.when(here, field(first)).otherwise(a)
        b = F.when(here, field(second)).otherwise(b) if second else b
        if words:
            text = F.when(here, F.concat_ws("|", *map(field, words)) if isinstance(words, tuple) else field(words, "string")).otherwise(text)
    rows = ring.rows_of(ring.decoded_records(records(spark, sf)))
    return rows.select("device", "seq", "tag", "stream", "ts", "place", a.alias("a"), b.cast("string").alias("b"), text.alias("text"))


@query(f"WITH {EVENTS} SELECT tag, CASE WHEN tag IN {tuple(ring.STORED)} THEN 'stored' WHEN tag IN {tuple(ring.KNOWN)} THEN 'known' ELSE 'unknown' END AS kind, count(*) AS records, count(*) FILTER (len(events) > 0) AS decoded, CAST(coalesce(sum(len(events)), 0) AS BIGINT) AS events FROM e GROUP BY ALL")
def ring_tag_census(spark, sf):
    """Records and events of every tag, those that are not stored and those that are not known among them."""
    return ring.census(ring.decoded_records(records(spark, sf)))


@query(f"WITH {EVENTS} SELECT device, seq, ts - e.back AS ts, e.place AS place, e.a AS ms, e.text AS channel, row_number() OVER (PARTITION BY device, ts - e.back ORDER BY seq, e.place) - 1 AS ord FROM x WHERE e.stream = 'beat'")
def ring_beats(spark, sf):
    """The beats as a stream of their own, numbered in the order of arrival within a second."""
    beats = ring.stream_of(ring.rows_of(ring.decoded_records(records(spark, sf))), "beat")
    return ring.beats_in_order(beats, "device", "ts", "seq").select("device", "seq", "ts", "place", "ms", "channel", F.col("ord").cast("long").alias("ord"))
