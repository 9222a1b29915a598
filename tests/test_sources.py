import struct

from pyspark.sql import functions as F

from rillstone import schemas
from rillstone.sources import binary, exports, files, sinks


def test_delimited_with_bom_semicolons_and_line_ends(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿Cycle start time;Recovery score %;Day Strain;Skin temp (F);Sleep efficiency %\n2024-01-02 10:00:00;"66";10,5;98,6;90\n03/01/2024;;;;\n"x\ny";1;1;1;1\n', encoding="utf-8")
    raw = files.read_delimited(spark, str(tmp_path / "a.csv"))
    assert raw.columns == ["cycle_start_time", "recovery_score_pct", "day_strain", "skin_temp_f", "sleep_efficiency_pct"]
    got = {str(r["day"]): r for r in files.read_cycles(spark, str(tmp_path / "a.csv")).collect()}
    assert set(got) == {"2024-01-02", "2024-01-03"}
    assert abs(got["2024-01-02"]["strain"] - 50) < 1e-9 and abs(got["2024-01-02"]["skin_temp_c"] - 37) < 1e-9 and got["2024-01-02"]["efficiency"] == 0.9
    assert got["2024-01-03"]["recovery"] is None


def test_cycles_round_trip(spark, tmp_path):
    days = spark.sql("SELECT DATE'2024-02-01' AS day, 50.0D AS recovery, 55 AS resting_hr, 60.5D AS hrv, 34.2D AS skin_temp_c, 42.0D AS strain, 0.91D AS efficiency")
    exports.write_cycles(days, str(tmp_path / "out"))
    back = files.read_cycles(spark, str(tmp_path / "out")).first()
    assert str(back["day"]) == "2024-02-01" and back["resting_hr"] == 55 and abs(back["strain"] - 42) < 1e-9 and abs(back["efficiency"] - 0.91) < 1e-9


def test_health_records_and_days(spark, tmp_path):
    record = '<Record type="HKQuantityTypeIdentifier{k}" sourceName="{s}" unit="c" startDate="2024-01-02 0{h}:00:00 +0000" endDate="2024-01-02 0{h}:01:00 +0000" value="{v}"/>'
    body = [record.format(k=k, s=s, h=h, v=v) for k, s, h, v in (("StepCount", "a", 1, 10), ("StepCount", "a", 1, 10), ("StepCount", "a", 2, 5), ("StepCount", "b", 3, 12), ("HeartRate", "a", 4, 60), ("HeartRate", "a", 5, 80), ("BodyMass", "a", 6, 71.5))]
    (tmp_path / "export.xml").write_text("<HealthData>" + "\n".join(body) + "</HealthData>")
    records = files.read_health_records(spark, str(tmp_path / "export.xml"))
    assert records.count() == 6
    day = files.health_days(records).first()
    assert (day["steps"], day["avg_hr"], day["max_hr"], day["weight_kg"]) == (15.0, 70.0, 80.0, 71.5)


def test_tracks(spark, tmp_path):
    points = "".join(f'<trkpt lat="48.0" lon="{11 + k / 1000}"><ele>{500 + k}</ele><time>2024-01-02T10:00:0{k}Z</time></trkpt>' for k in range(4)) + '<trkpt lat="99" lon="0"><time>2024-01-02T10:00:09Z</time></trkpt>'
    (tmp_path / "a.gpx").write_text(f"<gpx><trk><trkseg>{points}</trkseg></trk></gpx>")
    a = files.activity(files.read_gpx(spark, str(tmp_path / "a.gpx"))).first()
    assert a["n"] == 4 and abs(a["distance_m"] - 223.2) < 0.5 and a["ascent_m"] == 3
    gpx = exports.route_gpx(files.read_gpx(spark, str(tmp_path / "a.gpx")).withColumn("track", F.lit(1)), "track").first()["gpx"]
    (tmp_path / "b.gpx").write_text(gpx)
    assert files.read_gpx(spark, str(tmp_path / "b.gpx")).count() == 4
    (tmp_path / "a.tcx").write_text("<T><Trackpoint><Time>2024-01-02T10:00:00Z</Time><HeartRateBpm><Value>90</Value></HeartRateBpm><DistanceMeters>5</DistanceMeters></Trackpoint></T>")
    assert files.read_tcx(spark, str(tmp_path / "a.tcx")).first()["hr"] == 90


def test_logs(spark, tmp_path):
    (tmp_path / "lift.csv").write_text("title,start_time,exercise_title,weight_kg,reps\nA,2024-01-02 10:00,Squat,100,5\nA,2024-01-02 10:00,Squat,100,3\nA,2024-01-02 10:00,Plank,,\n")
    r = files.read_lifting(spark, str(tmp_path / "lift.csv")).first()
    assert (r["sets"], r["exercises"], r["volume"]) == (3, 2, 800.0)
    (tmp_path / "food.csv").write_text("Date,Calories (kcal),Protein (g),Carbs (g),Fat (g)\n2024-01-02,500,20,30,10\n2024-01-02,300,10,5,2\n")
    assert files.read_nutrition(spark, str(tmp_path / "food.csv")).first()["kcal"] == 800
    (tmp_path / "lab.csv").write_text("Date,Marker,Value,Unit\n2024-01-02,Blood Pressure,120/80,mmHg\n2024-01-02,Ferritin,\"45,5\",ug\n2024-01-02,Bad,none,x\n")
    assert {r["marker"]: r["value"] for r in files.read_markers(spark, str(tmp_path / "lab.csv")).collect()} == {"systolic": 120, "diastolic": 80, "ferritin": 45.5}


def test_json_sources(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"id":"a","day":"2024-01-02","bedtime_start":"2024-01-01T22:00:00Z","bedtime_end":"2024-01-01T22:20:00Z","sleep_phase_5_min":"4213","average_hrv":50.0,"lowest_heart_rate":48}\n')
    r = files.read_ring_sleep(spark, str(tmp_path / "s.json")).first()
    assert [s["stage"] for s in r["stages"]] == ["awake", "light", "deep", "rem"] and r["stages"][-1]["end"] == r["end_ts"]
    line = '{"batchId":"b","stream":"hr","key":{"ts":"1"},"data":{"v":"2"}}\n'
    (tmp_path / "b.ndjson").write_text('{"batchId":"b","stream":"hr"}\n' + line + line + line.replace('"hr"', '"zz"'))
    good, bad = files.read_batches(spark, str(tmp_path / "b.ndjson"), ["hr"])
    assert (good.count(), bad.count()) == (1, 1)
    assert files.detect_kind(["x/Export.xml"]) == "health_xml" and files.detect_kind(["q.txt"]) is None


def test_binary_codecs(spark, tmp_path):
    frames = [b"abc", b"", b"\xaa" * 300]
    blob = binary.pack_frames(frames)
    assert binary.unpack_frames(blob) == frames and binary.unpack_frames(b"zz") == []
    packets = [b"hello", b"\xaa\x02"]
    stream = b"\x01" + b"".join(b"\xaa" + bytes([len(p)]) + p + bytes([binary.crc8(p)]) for p in packets)
    assert binary.reassembled([stream[:4], stream[4:9], stream[9:]]) == packets
    rows = [(1, 2.5, 3), (2, -1.0, 4)]
    assert binary.unpack_rows(binary.pack_rows(rows)) == rows == binary.unpack_rows(binary.pack_rows(rows, False))
    assert (binary.crc8(b"123456789"), binary.crc16(b"123456789"), binary.crc32(b"123456789")) == (0xF4, 0x4B37, 0xCBF43926)
    body = b"\x40\x00\x00" + struct.pack("<HB", 20, 2) + bytes([253, 4, 6, 3, 1, 2]) + b"\x00" + struct.pack("<IB", 1000, 140)
    (tmp_path / "a.fit").write_bytes(bytes([14, 16]) + struct.pack("<HI", 0, len(body)) + b".FIT" + b"\0\0" + body)
    assert binary.read_fit(spark, str(tmp_path / "a.fit")).first()["hr"] == 140
    waves = spark.createDataFrame([(bytearray(struct.pack("<3h", 1, -2, 300)),), (bytearray(b""),)], "samples binary")
    assert [r["values"] for r in binary.decoded_samples(waves).collect()] == [[1, -2, 300], []]


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, s string, v double")
    new = spark.createDataFrame([(2, "c", None), (3, "d", 3.0), (3, "d", 3.0)], "k int, s string, v double")
    assert {r["k"]: r["s"] for r in sinks.latest_wins(old, new.distinct(), ["k"]).collect()} == {1: "a", 2: "c", 3: "d"}
    assert {r["k"]: r["v"] for r in sinks.preserve_columns(old, new.distinct(), ["k"], ["v"]).collect()} == {1: 1.0, 2: 2.0}
    assert sinks.append_new(old, new, ["k"]).count() == 3
    assert {r["k"] for r in sinks.range_replaced(old, new.limit(0), F.col("k") == 1).collect()} == {2}
    path = str(tmp_path / "days")
    sinks.write_days(spark.sql("SELECT 1 AS v, DATE'2024-01-01' AS day UNION ALL SELECT 2, DATE'2024-01-02'"), path)
    sinks.write_days(spark.sql("SELECT 9 AS v, DATE'2024-01-02' AS day"), path)
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [1, 9]


def test_exports(spark):
    rows = spark.createDataFrame([("d", 0, 60.0), ("d", 10, 80.0), ("d", 3700, 90.0)], "device string, t long, bpm double")
    got = {r["start"]: [(x["t"], x["v"]) for x in r["series"]] for r in exports.decimated(rows, "device", "t", "bpm").collect()}
    assert got == {0: [(0, 70.0)], 3600: [(3690, 90.0)]}
    assert exports.metric_json(spark.sql("SELECT 'a' AS key, DATE'2024-01-02' AS day, 1.5D AS value")).first()["json"] == '[{"day":"2024-01-02","value":1.5}]'
    assert schemas.missing_columns(rows.schema, "device string, t int, z double") == ["t", "z"]


def test_export_tables_with_zones_and_gaps(spark, tmp_path):
    (tmp_path / "sleeps.csv").write_text("Cycle start time,Cycle timezone,Sleep onset,Wake onset,Nap,Deep (SWS) duration (min)\n2024-01-02 00:30:00,UTC-05:30,2024-01-02 00:30:00,,TRUE,12\n,,,,,\n2024-01-03 00:00:00,,,,,\n")
    got = {r["cycle_start"]: r for r in files.read_sleeps(spark, str(tmp_path / "sleeps.csv")).collect()}
    assert set(got) == {1704175200, 1704240000}
    assert got[1704175200]["is_nap"] and got[1704175200]["deep_min"] == 12 and got[1704175200]["end_ts"] is None and not got[1704240000]["is_nap"]
    (tmp_path / "w.csv").write_text("Workout start time,Activity name,Activity Strain,HR Zone 1 %\n2024-01-02 10:00:00,Run,10.5,40\n,Lost,1,1\n")
    w = files.read_workouts(spark, str(tmp_path / "w.csv")).collect()
    assert len(w) == 1 and w[0]["strain"] == 50 and w[0]["zones"] == [40, None, None, None, None]
    (tmp_path / "j.csv").write_text("Cycle start time,Question text,Answered yes/no,Notes\n2024-01-02 10:00:00,Coffee?,yes,\n2024-01-02 10:00:00,,,\n")
    assert [(r["question"], r["answer"]) for r in files.read_journal(spark, str(tmp_path / "j.csv")).collect()] == [("Coffee?", "yes")]


def test_marker_cells_with_units(spark, tmp_path):
    (tmp_path / "lab.csv").write_text('Date,Marker,Value\n2024-01-02,A,"1,5 mg/L"\n2024-01-02,B,<0.4 ng/mL\n2024-01-02,C,No data\n2024-01-02,D,118/76 mmHg\n2024-01-02,E,7\n')
    got = {r["marker"]: (r["value"], r["unit"]) for r in files.read_markers(spark, str(tmp_path / "lab.csv")).collect()}
    assert got == {"a": (1.5, "mg/L"), "b": (0.4, "ng/mL"), "systolic": (118, "mmHg"), "diastolic": (76, "mmHg"), "e": (7, None)}


def test_ring_documents_and_captures(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"day":"2024-01-02","score":80,"temperature_deviation":-0.2,"contributors":{"hrv":70,"sleep":0}}\n{"score":1}\n')
    days, extras = files.read_ring_readiness(spark, str(tmp_path / "r.json"))
    assert [(r["score"], r["skin_temp_dev_c"]) for r in days.collect()] == [(80, -0.2)]
    assert [(r["key"], r["value"]) for r in extras.collect()] == [("readiness_hrv", 70)]
    (tmp_path / "w.json").write_text('{"start_datetime":"2024-01-02T10:00:00+02:00","end_datetime":"2024-01-02T11:00:00+02:00","calories":-1}\n{"start_datetime":"2024-01-02T10:00:00Z","end_datetime":"2024-01-02T10:00:00Z"}\n{"start_datetime":"never","end_datetime":null}\n')
    assert [(r["start_ts"], r["sport"], r["energy_kcal"]) for r in files.read_ring_workouts(spark, str(tmp_path / "w.json")).collect()] == [(1704182400, "workout", None)]
    (tmp_path / "c.json").write_text('{"session":"s","frames":[{"ts":1,"hex":"AA 01:ff"},{"ts":2,"hex":"xyz"},{"ts":3,"hex":null},{"ts":4,"hex":"abc"}]}\n{"session":"t"}\n')
    assert [(r["position"], bytes(r["data"])) for r in files.read_capture(spark, str(tmp_path / "c.json")).collect()] == [(0, b"\xaa\x01\xff")]


def test_fit_files_round_trip():
    points = [(1704182400, 48.5, 11.25, 500.2, 140), (1704182401, None, None, None, None), (1704182402, -33.0, -70.0, -10.0, 60)]
    data = binary.fit_file(points)
    got = binary.fit_records(data)
    assert [r["ts"] for r in got] == [p[0] for p in points] and [r["hr"] for r in got] == [140, None, 60]
    assert got[1]["lat"] is None and abs(got[2]["lon"] + 70) < 1e-6 and abs(got[0]["ele"] - 500.2) < 1e-9 and got[2]["ele"] == -10
    assert binary.crc16(data, start=0) == 0
    assert binary.fit_records(binary.fit_file([])) == []


def test_a_whole_fit_activity():
    points = [(1_700_000_000 + k, 40 + k / 1e4, None if k == 3 else 10.0, None if k % 2 else 100.2, 100 + k if k < 250 else None) for k in range(5000)]
    data = binary.fit_file(points, "running", 1234.56, 88)
    assert binary.crc16(data[:-2], start=0) == int.from_bytes(data[-2:], "little") and binary.crc16(data[:12], start=0) == int.from_bytes(data[12:14], "little")
    back = binary.fit_records(data)
    assert len(back) == 5000 and back[3]["lon"] is None and back[1]["ele"] is None and abs(back[0]["ele"] - 100.2) < 1e-9 and back[4999]["hr"] is None
    assert [m for m in (0, 19, 18, 34, 20) if bytes([m, 0]) in data] == [0, 19, 18, 34, 20]
    assert binary.fit_records(binary.fit_file([])) == []


def test_csv_without_quoted_lines_is_split(spark, tmp_path):
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "a.csv").write_text("a,b\n" + "".join(f'{k},"x, {k}"\n' for k in range(40_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        df = files.read_delimited(spark, str(tmp_path / "plain"))
        assert df.rdd.getNumPartitions() > 4 and df.count() == 40_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.csv").write_text('a,b\n1,"two\nlines"\n2,"a ""quote"""\n')
    assert [tuple(r) for r in files.read_delimited(spark, str(tmp_path / "lines")).collect()] == [("1", "two\nlines"), ("2", 'a "quote"')]


def test_a_long_waveform_is_decoded_in_proportion_to_its_bytes(spark):
    """Each sample used to write the whole blob in hexadecimal anew; a last odd byte has no sample, no blob no samples."""
    import struct
    import time

    from rillstone.sources import binary

    values = [k % 65536 - 32768 for k in range(200_000)]
    frame = spark.createDataFrame([(1, bytearray(struct.pack("<200000h", *values) + b"\x07")), (2, bytearray()), (3, None), (4, bytearray(b"\x01"))], "k int, samples binary")
    start = time.monotonic()
    got = {r["k"]: r["values"] for r in binary.decoded_samples(frame).collect()}
    assert time.monotonic() - start < 60
    assert got == {1: values, 2: [], 3: [], 4: []}


def test_numbers_with_an_exponent(spark):
    """A daily sum above ten million is written as 1.57606E7, which was read as 1.576067."""
    from pyspark.sql import functions as F

    from rillstone.sources import files

    cells = {"1.57606E7": 15760600.0, "-2e-3": -0.002, " 5E0 ": 5.0, "1,5": 1.5, "1,234.5 ms": 1234.5, "E7 beats": 7.0, "none": None, "": None}
    frame = spark.createDataFrame([(c,) for c in cells], "c string")
    assert {r["c"]: r["n"] for r in frame.select("c", files.number(F.col("c")).alias("n")).collect()} == cells


def test_results_of_a_large_row_are_not_held_whole(spark):
    """All results of a batch's rows were gathered in a list and a frame before the first went back."""
    from rillstone.plans import imports

    def many(r):
        for k in range(r["n"]):
            yield k, float(k), int(open("/proc/self/statm").read().split()[1]) // 256 if k % 50_000 == 0 else None

    frame = spark.createDataFrame([(1_000_000,), (0,), (3,)], "n long").coalesce(1)
    rows = imports._per_row(frame, many, "k long, v double, mb long")
    got = rows.agg({"k": "count", "v": "sum"}).first()
    assert (got["count(k)"], got["sum(v)"]) == (1_000_003, 1_000_000 * 999_999 / 2 + 3)
    low, high = rows.selectExpr("min(mb)", "max(mb)").first()
    assert high - low < 60
    blob = binary.pack_rows([(k, 0.5, k) for k in range(5)])
    assert next(iter(binary.iter_rows(blob))) == (0, 0.5, 0) and len(binary.unpack_rows(blob)) == 5 and binary.unpack_rows(b"RSB1\x05\x00\x00\x00") == []
