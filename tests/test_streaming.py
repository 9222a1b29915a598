import threading

import pytest

from rillstone.session import shared_folder
from rillstone.streaming import detectors, guard
from rillstone.streaming.guard import Guard, Rules
from rillstone.streaming.ledger import Ledger
from rillstone.streaming.sinks import available


def test_latch_fires_once_until_armed_again():
    values = [50, 12, 11, 20, 26, 10, 9]
    assert detectors.fold(detectors.latch, enumerate(values)) == [(1, "alert"), (5, "alert")]


def test_onset_needs_a_lasting_drop_and_then_holds_off():
    rows = [(k, 100.0) for k in range(50)] + [(50 + k, 40.0) for k in range(200)]
    assert detectors.fold(detectors.onset, rows) == [(110, "onset")]
    assert detectors.fold(detectors.onset, rows[:100]) == []


def test_nudge_repeats_and_motion_resets():
    rows = [(60 * k, 0.0) for k in range(120)]
    assert [t for t, _ in detectors.fold(detectors.nudge, rows)] == [2700, 4500, 6300]
    rows[40] = (2400, 1.0)
    assert detectors.fold(detectors.nudge, rows)[0][0] == 5100


def test_guard_needs_dwell():
    assert detectors.fold(detectors.guard, [(k, 130.0) for k in range(0, 30, 5)]) == [(25, "high")]
    assert detectors.fold(detectors.guard, [(0, 130.0), (5, 100.0), (10, 130.0), (30, 130.0)]) == []


def test_smoothing_is_a_median_of_recent_rows():
    assert [v for _, v in detectors.smoothed([(0, 1.0), (1, 9.0), (2, 2.0), (20, 5.0)])] == [1.0, 5.0, 2.0, 5.0]


def test_stream_equals_fold(spark, tmp_path):
    rows = [(k % 2, k, float((k * 37) % 50)) for k in range(300)]
    schema = "device long, t long, value double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = available(detectors.detected(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), detectors.latch, 1))
    want = [(d, t, e) for d in (0, 1) for t, e in detectors.fold(detectors.latch, [(t, v) for k, t, v in rows if k == d])]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_ledger(spark):
    ledger = Ledger(spark, shared_folder(spark, "ledger"))
    a, b = spark.range(3), spark.range(4)
    assert [ledger.accept(a, 1), ledger.accept(a, 1), ledger.accept(b, 1), ledger.accept(b, 2)] == ["accepted", "repeated", "conflict", "accepted"]


def test_a_stream_without_input_gives_an_empty_table(spark, tmp_path):
    (tmp_path / "none").mkdir()
    rows = spark.readStream.schema("device long, t long, value double").parquet(str(tmp_path / "none"))
    assert available(rows).count() == 0
    assert available(rows.groupBy("device").count(), "complete").count() == 0


def contents(ledger):
    return sorted((r["batch_id"], r["id"]) for r in ledger.rows("id long").collect())


@pytest.mark.parametrize("step", ["_write", "_commit", "_read"])
def test_a_crash_at_each_step_leaves_none_or_one_copy(spark, step):
    ledger = Ledger(spark, shared_folder(spark, "ledger"))
    broken = Ledger(spark, ledger.folder)

    def fail(*_):
        raise OSError("lost")

    setattr(broken, step, fail)
    with pytest.raises(OSError, match="lost"):
        broken.accept(spark.range(5), 7)
    assert contents(ledger) == []
    assert ledger.accept(spark.range(5), 7) == "accepted"
    assert contents(ledger) == [(7, k) for k in range(5)]
    assert ledger.sweep(0) == 1 and contents(ledger) == [(7, k) for k in range(5)]


def test_a_crash_after_the_commit_leaves_the_batch(spark):
    ledger = Ledger(spark, shared_folder(spark, "ledger"))
    real, calls = ledger._read, []

    def fail(place):
        calls.append(place)
        if len(calls) > 1:
            raise OSError("lost")
        return real(place)

    ledger._read = fail
    with pytest.raises(OSError, match="lost"):
        ledger.accept(spark.range(5), 7)
    again = Ledger(spark, ledger.folder)
    assert again.accept(spark.range(5), 7) == "repeated" and contents(again) == [(7, k) for k in range(5)]


@pytest.mark.parametrize("other, outcome", [(5, "repeated"), (6, "conflict")])
def test_two_writers_that_race_leave_one_copy(spark, other, outcome):
    folder, gate, got = shared_folder(spark, "ledger"), threading.Barrier(2), []

    class Racing(Ledger):
        def _commit(self, staged, place):
            gate.wait(60)  # both have seen a free place
            super()._commit(staged, place)

    def run(n):
        got.append(Racing(spark, folder).accept(spark.range(n), 3))

    threads = [threading.Thread(target=run, args=(n,)) for n in (5, other)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert sorted(got) == sorted(["accepted", outcome])
    assert len(contents(Ledger(spark, folder))) in (5, other)


def drive(rows, rules=Rules(), until=None):
    g = Guard(rules)
    events = [e for t, x in rows for e in g.update(t, x)]
    return events + (g.expire(until) if until else [])


def test_silence_is_told_once_at_its_own_time():
    rows = [(k, 140.0) for k in range(5)] + [(40, 140.0), (41, 300.0), (60, 140.0)]
    assert drive(rows) == [(0, "live"), (12, "stale"), (40, "live"), (48, "stale"), (60, "live")]


def test_cues_need_dwell_and_cooldown_and_a_climb():
    rules = Rules(resting=50, most=190)
    floor, ceiling = rules.band()
    assert drive([(k, floor - 20) for k in range(180)], rules) == [(0, "live"), (60, "push"), (110, "push"), (160, "push")]
    slow = [(k, ceiling + 20) for k in range(500)]
    assert [e for e in drive(slow, rules) if e[1] == "ease"] == []
    assert [e for e in drive(slow, rules) if e[1] == "drift"] == [(90 * k, "drift") for k in range(1, 5)]
    climb = [(k, floor + 8) for k in range(100)] + [(100 + k, ceiling + 12) for k in range(120)]
    assert [e for e in drive(climb, rules) if e[1] == "ease"][0][0] >= 125


def guarded_rows():
    rows = []
    for d in range(3):
        for k in range(400):
            if (k // 37 + d) % 5 != 2:
                rows.append((d, 1000 + k, 90.0 + 45 * ((k // 60 + d) % 3) + (k * 7 + d) % 5))
    return sorted(rows, key=lambda r: (r[1], r[0]))


@pytest.mark.parametrize("cuts", [1, 4])
def test_guard_stream_equals_fold_however_batches_are_cut(spark, tmp_path, cuts):
    rows = guarded_rows()
    want = sorted((d, t, e) for d in range(3) for t, e in drive([(t, x) for k, t, x in rows if k == d], until=rows[-1][1]))
    size = -(-len(rows) // cuts)
    folder = shared_folder(spark, "guard")
    schema = "device long, t long, value double"
    (tmp_path / "in").mkdir()
    before = {k: spark.conf.get(k, None) for k in guard.STORE}
    for k, v in guard.STORE.items():
        spark.conf.set(k, v)
    try:
        for c in range(cuts):  # each part is a run of its own: the state survives the restart
            spark.createDataFrame(rows[c * size : (c + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).selectExpr("*", "timestamp_seconds(t) AS at").withWatermark("at", "0 seconds")
            stream = guard.guarded(stream)
            stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = sorted(map(tuple, spark.read.parquet(f"{folder}/rows").collect()))
    assert out == want and any(e == "stale" for _, _, e in out)


def test_a_silent_device_ends_by_its_timer(spark, tmp_path):
    rows = [(1, 1000 + k, 120.0) for k in range(3)] + [(2, 1000 + k, 120.0) for k in range(60)]
    spark.createDataFrame(rows, "device long, t long, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("device long, t long, value double").parquet(str(tmp_path / "in")).selectExpr("*", "timestamp_seconds(t) AS at").withWatermark("at", "5 seconds")
    got = available(guard.guarded(stream), settings=guard.STORE)
    assert (1, 1010, "stale") in set(map(tuple, got.collect()))
