"""Binary sources: framed blobs with checksums, packed sample rows, FIT files, waveforms; whole files a row each."""

from __future__ import annotations

import binascii
import gzip
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def crc8(data: bytes, polynomial: int = 0x07) -> int:
    crc = 0
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = ((crc << 1) ^ polynomial if crc & 0x80 else crc << 1) & 0xFF
    return crc


@lru_cache(4)
def _crc16_table(polynomial: int) -> list[int]:
    table = []
    for byte in range(256):
        crc = byte
        for _ in range(8):
            crc = (crc >> 1) ^ polynomial if crc & 1 else crc >> 1
        table.append(crc)
    return table


def crc16(data: bytes, polynomial: int = 0xA001, start: int = 0xFFFF) -> int:
    crc, table = start, _crc16_table(polynomial)
    for b in data:
        crc = (crc >> 8) ^ table[(crc ^ b) & 0xFF]
    return crc


def crc32(data: bytes) -> int:
    return binascii.crc32(data)


def pack_frames(frames: list[bytes]) -> bytes:
    """A count, each frame behind its length, compressed behind the length of the whole."""
    body = struct.pack("<I", len(frames)) + b"".join(struct.pack("<H", len(f)) + f for f in frames)
    return struct.pack("<I", len(body)) + zlib.compress(body)


def unpack_frames(blob: bytes) -> list[bytes]:
    """The frames of a blob; what follows a cut or a wrong length is left out."""
    try:
        size, body = struct.unpack_from("<I", blob)[0], zlib.decompressobj().decompress(blob[4:])
        count, at, out = struct.unpack_from("<I", body)[0], 4, []
        for _ in range(count):
            n = struct.unpack_from("<H", body, at)[0]
            if at + 2 + n > len(body):
                break
            out.append(body[at + 2 : at + 2 + n])
            at += 2 + n
        return out if len(body) <= size else []
    except (struct.error, zlib.error):
        return []


def reassembled(chunks: list[bytes], start: int = 0xAA) -> list[bytes]:
    """Frames (start byte, length, payload, CRC-8 of the payload) out of chunks cut anywhere; bad frames are skipped."""
    data, at, out = b"".join(chunks), 0, []
    while (at := data.find(start, at)) >= 0 and at + 2 < len(data):
        n = data[at + 1]
        payload = data[at + 2 : at + 2 + n]
        if at + 2 + n < len(data) and len(payload) == n and crc8(payload) == data[at + 2 + n]:
            out.append(payload)
            at += 3 + n
        else:
            at += 1
    return out


ROW = struct.Struct("<qdi")


def pack_rows(rows: list[tuple[int, float, int]], compress: bool = True) -> bytes:
    body = b"RSB1" + struct.pack("<I", len(rows)) + b"".join(ROW.pack(*r) for r in rows)
    return gzip.compress(body, mtime=0) if compress else body


def iter_rows(blob: bytes) -> Iterator[tuple[int, float, int]]:
    """The rows of a blob one after another, so that only its bytes are held."""
    body = gzip.decompress(blob) if blob[:2] == b"\x1f\x8b" else blob
    if body[:4] == b"RSB1":
        n = struct.unpack_from("<I", body, 4)[0]
        yield from islice(ROW.iter_unpack(body[8 : 8 + (len(body) - 8) // ROW.size * ROW.size]), n)


def unpack_rows(blob: bytes) -> list[tuple[int, float, int]]:
    return list(iter_rows(blob))


#: Seconds from the Unix epoch to that of FIT times.
FIT_EPOCH = 631065600
SIZES = {0: "B", 1: "b", 2: "B", 3: "h", 4: "H", 5: "i", 6: "I", 7: "s", 8: "f", 9: "d", 10: "B", 11: "H", 12: "I", 13: "B", 14: "q", 15: "Q", 16: "Q"}


def fit_records(data: bytes) -> list[dict]:
    """ts, lat, lon, ele, hr, distance of the record messages of a FIT file, of either byte order."""
    if len(data) < 14 or data[8:12] != b".FIT":
        return []
    at, end, kinds, out = data[0], min(len(data), data[0] + struct.unpack_from("<I", data, 4)[0]), {}, []
    while at < end:
        head = data[at]
        at += 1
        kind = (head >> 5) & 3 if head & 0x80 else head & 0x0F
        try:
            if head & 0x40 and not head & 0x80:
                order = ">" if data[at + 1] else "<"
                number, fields = struct.unpack_from(order + "HB", data, at + 2)
                at += 5
                found = [tuple(data[at + 3 * k : at + 3 * k + 3]) for k in range(fields)]
                at += 3 * fields
                if head & 0x20:
                    extra = data[at]
                    found += [(-1, data[at + 1 + 3 * k + 1], 13) for k in range(extra)]
                    at += 1 + 3 * extra
                kinds[kind] = (order, number, found)
                continue
            order, number, fields = kinds[kind]
            values = {}
            for field, size, base in fields:
                code = SIZES.get(base & 0x1F, "B")
                if field >= 0 and code != "s" and struct.calcsize(code) == size:
                    values[field] = struct.unpack_from(order + code, data, at)[0]
                at += size
        except (struct.error, IndexError, KeyError):
            break
        if number == 20 and 253 in values:
            degrees = lambda k: values[k] * 180 / 2**31 if values.get(k, 0x7FFFFFFF) != 0x7FFFFFFF else None  # noqa: B023, E731
            out.append({"ts": values[253] + FIT_EPOCH, "lat": degrees(0), "lon": degrees(1), "ele": values[2] / 5 - 500 if values.get(2, 0xFFFF) != 0xFFFF else None, "hr": values[3] if values.get(3, 0xFF) != 0xFF else None, "distance": values[5] / 100 if values.get(5, 0xFFFFFFFF) != 0xFFFFFFFF else None})
    return out


#: The fields of an activity file's messages as (number, size, base type): what a record holds, and what sums it up.
FIT_RECORD = ((253, 4, 0x86), (0, 4, 0x85), (1, 4, 0x85), (2, 2, 0x84), (3, 1, 0x02))
FIT_SPORTS = {"generic": 0, "running": 1, "cycling": 2, "swimming": 5, "walking": 11, "hiking": 17}
_BASES = {0x00: "B", 0x02: "B", 0x84: "H", 0x85: "i", 0x86: "I"}


def _fit_message(local: int, number: int, fields: list[tuple[int, int, int, int]]) -> bytes:
    """The definition of a message and one message of it; fields are (number, size, base type, value)."""
    kinds = b"".join(bytes(f[:3]) for f in fields)
    head = bytes([0x40 | local, 0, 0]) + struct.pack("<HB", number, len(fields)) + kinds
    return head + bytes([local]) + struct.pack("<" + "".join(_BASES[f[2]] for f in fields), *(f[3] for f in fields))


def fit_file(points: list[tuple[int, float | None, float | None, float | None, int | None]], sport: str = "generic", distance_m: float | None = None, kcal: float | None = None) -> bytes:
    """A FIT activity: file, records (ts, lat, lon, ele, hr), a lap, a session and the activity that they make.

    What is None in a record is the invalid value of its field; what the session does not know it does not name.
    """
    known = lambda k, kind: np.array([np.nan if p[k] is None else p[k] for p in points], kind)
    rows = np.zeros(len(points), np.dtype([("head", "u1"), ("ts", "<u4"), ("lat", "<i4"), ("lon", "<i4"), ("ele", "<u2"), ("hr", "u1")]))
    rows["head"], rows["ts"] = 1, np.array([p[0] for p in points], np.int64) - FIT_EPOCH
    for name, k, invalid, scaled in (("lat", 1, 0x7FFFFFFF, lambda v: v * 2**31 / 180), ("lon", 2, 0x7FFFFFFF, lambda v: v * 2**31 / 180), ("ele", 3, 0xFFFF, lambda v: (v + 500) * 5), ("hr", 4, 0xFF, lambda v: v)):
        value = scaled(known(k, float))
        rows[name] = np.where(np.isnan(value), invalid, np.rint(np.nan_to_num(value))).astype(np.int64)
    first, last = (int(points[k][0]) - FIT_EPOCH if points else 0 for k in (0, -1))
    rates = [p[4] for p in points if p[4] is not None]
    span, metres = 1000 * max(last - first, 0), 0xFFFFFFFF if distance_m is None else round(distance_m * 100)
    session = [(253, 4, 0x86, last), (2, 4, 0x86, first), (7, 4, 0x86, span), (5, 1, 0x00, FIT_SPORTS.get(sport, 0))]
    session += [(9, 4, 0x86, metres)] if distance_m is not None else []
    session += [(11, 2, 0x84, min(max(round(kcal), 0), 65534))] if kcal is not None else []
    session += [(16, 1, 0x02, min(round(sum(rates) / len(rates)), 254)), (17, 1, 0x02, min(max(rates), 254))] if rates else []
    parts = [
        _fit_message(0, 0, [(0, 1, 0x00, 4), (1, 2, 0x84, 255), (4, 4, 0x86, first)]),
        b"\x41\x00\x00" + struct.pack("<HB", 20, len(FIT_RECORD)) + b"".join(map(bytes, FIT_RECORD)),
        rows.tobytes(),
        _fit_message(2, 19, [(253, 4, 0x86, last), (2, 4, 0x86, first), (7, 4, 0x86, span), (9, 4, 0x86, metres)]),
        _fit_message(3, 18, session),
        _fit_message(4, 34, [(253, 4, 0x86, last), (1, 2, 0x84, 1), (2, 1, 0x00, 0)]),
    ]
    body = b"".join(parts)
    head = struct.pack("<BBHI", 14, 0x20, 2132, len(body)) + b".FIT"
    head += struct.pack("<H", crc16(head, start=0))
    return head + body + struct.pack("<H", crc16(head + body, start=0))


def fit_points(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, ts, lat, lon, ele, hr, distance of the records of files, a file a row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"], strict=True):
                rows = pd.DataFrame(fit_records(bytes(data)), columns=["ts", "lat", "lon", "ele", "hr", "distance"])
                rows.insert(0, "path", name)
                yield rows

    plain = files.select(F.col(path).cast("string").alias("path"), F.col(content).alias("content")).filter("content IS NOT NULL")
    rows = plain.mapInPandas(run, "path string, ts double, lat double, lon double, ele double, hr double, distance double")
    return rows.withColumn("ts", F.timestamp_seconds("ts"))


def read_fit(spark: SparkSession, path: str) -> DataFrame:
    return fit_points(spark.read.format("binaryFile").load(path))


def decoded_samples(blobs: DataFrame, column: str = "samples") -> DataFrame:
    """A waveform of little-endian 16-bit samples as an array of integers, in native functions.

    The hexadecimal text is cut in samples once, so work is in proportion to the bytes; a last odd byte is left out.
    """
    pairs = F.regexp_extract_all(F.hex(F.col(column)), F.lit("[0-9A-F]{4}"), F.lit(0))
    number = lambda x: F.conv(F.concat(F.substring(x, 3, 2), F.substring(x, 1, 2)), 16, 10).cast("int")
    signed = F.transform(F.transform(pairs, number), lambda v: F.when(v >= 32768, v - 65536).otherwise(v))
    return blobs.withColumn("values", F.coalesce(signed, F.array().cast("array<int>")))


def sqlite_tables(data: bytes) -> list[str]:
    import sqlite3

    con = sqlite3.connect(":memory:")
    try:
        con.deserialize(data)
        return [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name")]
    except sqlite3.DatabaseError:
        return []
    finally:
        con.close()


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    """The rows of a table of SQLite files, a file a row of work; files without the table give none."""
    return sqlite_rows(spark.read.format("binaryFile").load(path), table, schema)


def sqlite_rows(files: DataFrame, table: str, schema: str, content: str = "content") -> DataFrame:
    """The rows of a table of SQLite files that a column holds."""
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sqlite3

        for frame in frames:
            for content in frame["content"]:
                if table not in sqlite_tables(bytes(content)):
                    continue
                con = sqlite3.connect(":memory:")
                con.deserialize(bytes(content))
                there = {r[1] for r in con.execute(f'PRAGMA table_info("{table}")')}
                columns = ", ".join(f'"{n}"' if n in there else f'NULL AS "{n}"' for n in names)
                yield pd.DataFrame(con.execute(f'SELECT {columns} FROM "{table}"').fetchall(), columns=names)
                con.close()

    return files.select(F.col(content).alias("content")).filter("content IS NOT NULL").mapInPandas(run, schema)
