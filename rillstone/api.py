"""The read interface: named tools over a folder of tables, with checked arguments; results are DataFrames or JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import bindings, reports

#: Tool: its arguments and their kinds; those with a default may be left out.
TOOLS = {
    "snapshot": {"day": (str, None)},
    "metric_series": {"key": (str, None), "source": (str, "auto"), "days": (int, 30), "limit": (int, 1000)},
    "freshness": {},
    "sleep_summary": {"days": (int, 30)},
    "workout_summary": {},
}
SOURCES, KEYS = ("auto", "orders", "lineitem"), ("value", "price", "n", "urgent", "high", "low")


class BadRequest(ValueError):
    """An unknown tool, or an argument that is missing, unknown or of the wrong kind."""


def _checked(name: str, arguments: dict | None) -> dict:
    if name not in TOOLS:
        raise BadRequest(f"no tool {name}")
    known, given = TOOLS[name], dict(arguments or {})
    if extra := set(given) - set(known):
        raise BadRequest(f"{name} has no argument {sorted(extra)[0]}")
    out = {}
    for key, (kind, default) in known.items():
        value = given.get(key, default)
        if value is None:
            raise BadRequest(f"{name} needs {key}")
        if not isinstance(value, kind) or isinstance(value, bool):
            raise BadRequest(f"{key} is not of kind {kind.__name__}")
        out[key] = value
    return out


def dispatch(spark: SparkSession, sf_dir: str, name: str, arguments: dict | None = None) -> DataFrame:
    a = _checked(name, arguments)
    if name == "metric_series":
        if a["source"] not in SOURCES or a["key"] not in KEYS:
            raise BadRequest("unknown source or key")
        return reports.metric_series(spark, sf_dir, a["key"], a["source"], a["days"], a["limit"])
    if name == "snapshot":
        day = F.lit(a["day"]).try_cast("date")
        d = bindings.daily(spark, sf_dir).filter(F.col("day") == day)
        return d.join(bindings.shipped(spark, sf_dir).filter(F.col("day") == day), ["device", "day"], "left")
    if name == "sleep_summary":
        s = bindings.sessions(spark, sf_dir)
        last = s.agg(F.max("end_t")).first()[0] or 0
        days = max(1, min(3660, a["days"]))
        return s.filter(F.col("end_t") > last - days * 86400).groupBy("device").agg(F.count("*").alias("sessions"), F.avg((F.col("end_t") - F.col("start_t")) / 60).alias("mean_minutes"), F.max("end_t").alias("latest"))
    return {"freshness": reports.freshness, "workout_summary": reports.workout_summary}[name](spark, sf_dir)


def answer(spark: SparkSession, sf_dir: str, request: str, most: int = 1000) -> str:
    """A JSON request (id, tool, arguments) answered in JSON: rows, or an error. At most ``most`` rows are given."""
    try:
        asked = json.loads(request)
        if not isinstance(asked, dict):
            raise BadRequest("a request is an object")
        if asked.get("tool") == "list":
            return json.dumps({"id": asked.get("id"), "tools": {k: list(v) for k, v in TOOLS.items()}})
        rows = dispatch(spark, sf_dir, asked.get("tool"), asked.get("arguments")).limit(most).toJSON().collect()
        return json.dumps({"id": asked.get("id"), "rows": [json.loads(r) for r in rows]})
    except (BadRequest, json.JSONDecodeError) as e:
        return json.dumps({"error": str(e)})
