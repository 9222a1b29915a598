import datetime
import math

from rillstone.plans import bundles


def test_nightly_scores_need_a_baseline_and_turn_towards_illness(spark):
    day = lambda k: datetime.date(2024, 1, 1) + datetime.timedelta(k)
    rows = [(1, day(k), 50.0 + k % 3, 0, 60 - k % 2, None) for k in range(20)] + [(1, day(20), 58.0, 5, 50, 3), (1, day(21), None, None, None, None), (2, day(0), 1.0, 1, 1, 1)]
    got = {(r["device"], r["day"]): r for r in bundles.nightly(spark.createDataFrame(rows, "device int, day date, price double, high int, n int, urgent int"), "device", "day", bundles.SIGNALS).collect()}
    assert got[1, day(12)]["resting_z"] is None and not got[1, day(12)]["trusted"] and got[1, day(13)]["trusted"]
    assert got[1, day(14)]["resting_z"] is not None and got[1, day(14)]["breath_z"] is None
    ill = got[1, day(20)]
    assert ill["resting_z"] > 2 and ill["variability_z"] > 2 and ill["warmth_z"] > 1000 and ill["fires"] and ill["told"] == "resting,warmth,variability"
    assert math.isclose(ill["distance"], math.sqrt(sum(ill[f"{n}_z"] ** 2 for n in ("resting", "warmth", "variability"))))
    none = got[1, day(21)]
    assert (none["told"], none["distance"], none["fires"], none["resting_z"]) == ("", 0.0, False, None)
    assert got[2, day(0)]["distance"] == 0.0


def test_catalogue_of_metrics_is_sound_and_precedence_holds(spark):
    assert len({m[:2] for m in bundles.METRICS}) == len(bundles.METRICS)
    assert all(p in {m[:2] for m in bundles.METRICS} for order in bundles.PRECEDENCE.values() for p in order)
    points = [(1, 1, "steps_est", "band", 5.0), (1, 1, "steps", "phone", 7.0), (1, 2, "steps", "phone", 7.0), (1, 2, "steps", "band", None), (1, 3, "hrv", "band", 4.0), (2, 1, "steps_est", "band", 9.4)]
    got = {(r["device"], r["day"]): (r["key"], r["source"], r["text"]) for r in bundles.shown(spark.createDataFrame(points, "device int, day int, key string, source string, value double"), spark, "steps").collect()}
    assert got == {(1, 1): ("steps", "phone", "7"), (1, 2): ("steps", "phone", "7"), (2, 1): ("steps_est", "band", "9")}
