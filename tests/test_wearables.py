import datetime
import json

from rillstone.sources import wearables

DAY = datetime.date


def put(tmp_path, name, docs, whole=False):
    folder = tmp_path / name
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps(docs) if whole else "\n".join(map(json.dumps, docs)) + "\n")
    return str(folder)


def test_tracker_sleeps_in_arrays_and_odd_documents(spark, tmp_path):
    good = {"dateOfSleep": "2024-03-02", "startTime": "2024-03-01T23:00:00.000", "endTime": "2024-03-02T06:30:00.500", "minutesAsleep": 400, "efficiency": 0, "levels": {"summary": {"deep": {"minutes": 60, "count": 3}, "wake": {"minutes": 0}}, "data": [{"dateTime": "2024-03-02T01:00:00.000", "level": "REM", "seconds": 30}, {"dateTime": "2024-03-01T23:00:00.000", "level": "odd", "seconds": 90}, {"dateTime": "no time", "level": "rem", "seconds": 9}, {"dateTime": "2024-03-01T23:00:00.000", "seconds": 5}]}, "surplus": [1]}
    docs = [good, {**good, "endTime": "2024-03-01T22:00:00.000"}, {"startTime": None}, {}, {**good, "dateOfSleep": None, "levels": None, "minutesAwake": 12}]
    rows = wearables.tracker_sleeps(spark, put(tmp_path, "s", docs, True), True).collect()
    assert len(rows) == 2
    a, b = sorted(rows, key=lambda r: r["awake_min"] is not None)
    assert (a["day"], a["deep_min"], a["awake_min"], a["efficiency"], a["end_ts"] - a["start_ts"]) == (DAY(2024, 3, 2), 60, None, None, 27000)
    assert [(x["stage"], x["end"] - x["start"]) for x in a["stages"]] == [("wake", 90), ("rem", 30)]
    assert (b["day"], b["awake_min"], b["stages"]) == (DAY(2024, 3, 2), 12, None)


def test_tracker_days(spark, tmp_path):
    steps = [{"dateTime": "03/02/24 10:00:00", "value": "10"}, {"dateTime": "03/02/24 11:00:00", "value": 5}, {"dateTime": "03/03/24 11:00:00", "value": "0"}, {"dateTime": "2024-03-04", "value": "-3"}, {"dateTime": None, "value": "8"}, {"dateTime": "2024-03-05T01:00:00", "value": "x"}]
    assert [tuple(r) for r in wearables.tracker_steps(spark, put(tmp_path, "a", steps)).collect()] == [(DAY(2024, 3, 2), 15)]
    rest = [{"dateTime": "03/02/24 00:00:00", "value": {"date": "x", "value": 54.6}}, {"dateTime": "03/03/24 00:00:00", "value": 50}, {"dateTime": "03/04/24 00:00:00", "value": {"value": 0}}, {"dateTime": "03/05/24 00:00:00", "value": None}]
    assert sorted(tuple(r) for r in wearables.tracker_resting(spark, put(tmp_path, "b", rest)).collect()) == [(DAY(2024, 3, 2), 55), (DAY(2024, 3, 3), 50)]


def test_account_files_and_merged_days(spark, tmp_path):
    sleeps = [{"calendarDate": "2024-03-02", "sleepStartTimestampGMT": 1709330400000, "sleepEndTimestampGMT": 1709355600000, "deepSleepSeconds": 3600, "remSleepSeconds": 0, "overallSleepScore": None, "sleepScores": {"overall": {"value": 71}}}, {"StartTimeInSeconds": 1709330400, "EndTimeInSeconds": 1709340000, "AwakeDurationInSeconds": 60}, {"sleepStartTimestampGMT": "2024-03-03T22:00:00.0", "sleepEndTimestampGMT": "2024-03-04T05:00:00.0", "averageHrvValue": 40.5}, {"calendarDate": "2024-03-09"}]
    got = wearables.account_sleeps(spark, put(tmp_path, "s", sleeps)).orderBy("end_ts").collect()
    assert [(r["day"], r["total_min"], r["score"]) for r in got] == [(DAY(2024, 3, 2), None, None), (DAY(2024, 3, 2), 60, 71), (DAY(2024, 3, 4), None, None)] and got[2]["hrv"] == 40.5
    days = wearables.account_days(spark, put(tmp_path, "d", [{"calendarDate": "2024-03-02", "totalSteps": 0, "steps": 9}, {"calendar_date": "2024-03-06", "restingHeartRateInBeatsPerMinute": 50}, {"totalSteps": 4}]))
    merged = {r["day"]: (r["deep_min"], r["steps"], r["resting_hr"]) for r in wearables.merged_days(wearables.account_sleeps(spark, str(tmp_path / "s")), days).collect()}
    assert merged == {DAY(2024, 3, 2): (60, 9, None), DAY(2024, 3, 4): (None, None, None), DAY(2024, 3, 6): (None, None, 50)}
