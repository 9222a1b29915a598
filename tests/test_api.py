import json
import sqlite3
import struct

import pytest

from rillstone import api
from rillstone.functions import geo
from rillstone.sources import binary, sensors
from rillstone.streaming import detectors


def test_tools_check_their_arguments(spark, sf):
    assert api.dispatch(spark, sf, "metric_series", {"key": "value", "days": 100_000, "limit": 5}).count() == 5
    assert api.dispatch(spark, sf, "snapshot", {"day": "1998-02-02"}).columns[:2] == ["device", "day"]
    assert api.dispatch(spark, sf, "snapshot", {"day": "no day"}).count() == 0
    assert api.dispatch(spark, sf, "sleep_summary").count() > 0
    for name, arguments in (("nothing", {}), ("metric_series", {}), ("metric_series", {"key": "value", "x": 1}), ("metric_series", {"key": "value", "days": "7"}), ("metric_series", {"key": "value", "source": "z"})):
        with pytest.raises(api.BadRequest):
            api.dispatch(spark, sf, name, arguments)


def test_json_requests(spark, sf):
    got = json.loads(api.answer(spark, sf, '{"id": 3, "tool": "freshness"}'))
    assert got["id"] == 3 and got["rows"][0].keys() >= {"device", "kind", "newest", "fresh"}
    assert "freshness" in json.loads(api.answer(spark, sf, '{"tool": "list"}'))["tools"]
    assert "error" in json.loads(api.answer(spark, sf, "{")) and "error" in json.loads(api.answer(spark, sf, '{"tool": "zz"}'))


def test_sensor_decoders(spark):
    assert sensors.heart_rate(bytes([0x16, 60]) + struct.pack("<HH", 1024, 512)) == {"bpm": 60, "contact": True, "energy_kj": None, "rr_ms": [1000.0, 500.0]}
    assert sensors.heart_rate(bytes([1, 60])) is None and sensors.heart_rate(b"") is None
    a, b = (sensors.cycling(bytes([2]) + struct.pack("<HH", r, t)) for r, t in ((65535, 64512), (1, 1024)))
    assert sensors.cadence(a, b) == 60
    assert sensors.running(bytes([4]) + struct.pack("<HB", 512, 80)) == {"speed": 2.0, "cadence": 80, "stride_m": None, "distance_m": None, "is_run": True}
    assert sensors.indoor_bike(struct.pack("<HHHh", 0b1000100, 2500, 180, 210)) == {"speed": 25.0, "cadence": 90.0, "power": 210}
    assert sensors.inertial(struct.pack("<7h", 4096, 0, 0, 0, 0, -4096, 9)) == [[1.0, 0, 0, 0, 0, -1.0]]
    rows = spark.createDataFrame([(1, bytearray([0, 70])), (2, bytearray(b"")), (3, None)], "seq int, data binary")
    got = sensors.decoded(rows, sensors.heart_rate, "bpm int, contact boolean", ["seq"]).collect()
    assert [(r["seq"], r["bpm"], r["contact"]) for r in got] == [(1, 70, None)]


def test_routes_and_hashes():
    points = [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]
    assert geo.encode_polyline(points) == "_p~iF~ps|U_ulLnnqC_mqNvxq`@" and geo.decode_polyline("_p~iF~ps|U_ulLnnqC_mqNvxq`@") == points
    assert geo.decode_polyline("") == [] and geo.fnv1a(b"a") == 0xAF63DC4C8601EC8C


def test_sqlite_files(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "band.db")
    con.execute("CREATE TABLE days (day TEXT, steps INT)")
    con.execute("INSERT INTO days VALUES ('2024-01-02', 5)")
    con.commit()
    con.close()
    (tmp_path / "other.db").write_bytes(b"not a database")
    rows = binary.read_sqlite(spark, str(tmp_path / "*.db"), "days", "day string, steps long, missing double").collect()
    assert [tuple(r) for r in rows] == [("2024-01-02", 5, None)]


def test_pacer_follows_the_heart():
    assert [e for _, e in detectors.fold(detectors.pacer, [(k, 100.0 - 5 * k) for k in range(12)])] == ["pace 6", "pace 5.5", "pace 5", "pace 4.5"]
