"""Schemas of the engine's stored shapes, as schema strings."""

from __future__ import annotations

from pyspark.sql.types import StructType

STREAM = "device_id string, ts long, value double"
BEATS = "device_id string, ts long, rr_ms int, seq int, ord int"
DAILY = (
    "device_id string, day date, total_sleep_min double, efficiency double, deep_min double, rem_min double, light_min double, disturbances int, resting_hr int, avg_hrv double, "
    "recovery double, strain double, exercise_count int, spo2_pct double, skin_temp_dev_c double, resp_rate_bpm double, steps int, active_kcal_est double"
)
METRICS = "device_id string, day date, key string, value double"
SESSIONS = "device_id string, start_ts long, end_ts long, efficiency double, resting_hr int, avg_hrv double, stages array<struct<start:long,end:long,stage:string>>"
WORKOUTS = "device_id string, start_ts long, end_ts long, sport string, source string, duration_s double, energy_kcal double, avg_hr int, max_hr int, strain double, distance_m double, zones map<int,double>, notes string"


def missing_columns(found: StructType, wanted: str) -> list[str]:
    """Names that a table lacks or holds in another type; empty if it can be read as ``wanted``."""
    types = {f.name: f.dataType for f in found.fields}
    return [f.name for f in StructType.fromDDL(wanted).fields if types.get(f.name) != f.dataType]
