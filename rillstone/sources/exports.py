"""Exports: delimited tables in an import's layout, JSON by key, GPX routes, decimated series."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .binary import fit_file


def write_cycles(days: DataFrame, path: str) -> None:
    """Daily rows in the column layout that ``read_cycles`` reads."""
    out = days.select(
        F.date_format("day", "yyyy-MM-dd 00:00:00").alias("Cycle start time"), F.col("recovery").alias("Recovery score %"), F.col("resting_hr").alias("Resting heart rate (bpm)"), F.col("hrv").alias("Heart rate variability (ms)"),
        F.col("skin_temp_c").alias("Skin temp (celsius)"), (F.col("strain") * 21 / 100).alias("Day Strain"), (F.col("efficiency") * 100).alias("Sleep efficiency %"),
    )
    out.write.mode("overwrite").option("header", True).csv(path)


def metric_json(points: DataFrame) -> DataFrame:
    """key and a JSON array of its (day, value) in order."""
    g = points.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("day", "value"))).alias("points"))
    return g.select("key", F.to_json("points").alias("json"))


def route_gpx(points: DataFrame, key: str) -> DataFrame:
    """key and a GPX document of its route."""
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    point = F.format_string('<trkpt lat="%.7f" lon="%.7f"><ele>%.1f</ele><time>%s</time></trkpt>', F.col("lat"), F.col("lon"), F.coalesce("ele", F.lit(0.0)), at)
    g = points.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ts", point.alias("p")))).alias("a"))
    body = F.array_join(F.transform("a", lambda x: x["p"]), "")
    return g.select(key, F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1" creator="rillstone"><trk><trkseg>'), body, F.lit("</trkseg></trk></gpx>")).alias("gpx"))


def route_fit(points: DataFrame, key: str) -> DataFrame:
    """key and a FIT file of its route (ts, lat, lon, ele, hr); a route is held in one task, so keys should be sessions or days."""
    kind = points.schema[key].dataType.simpleString()

    def run(route: pd.DataFrame) -> pd.DataFrame:
        rows = route.sort_values("t").astype(object).where(route.notna(), None)
        named = rows[["t", "lat", "lon", "ele", "hr"]].itertuples(index=False, name=None)
        return pd.DataFrame({key: [route[key].iloc[0]], "fit": [fit_file([(int(t), lat, lon, ele, None if hr is None else int(hr)) for t, lat, lon, ele, hr in named])]})

    rows = points.select(key, F.unix_seconds("ts").alias("t"), "lat", "lon", "ele", F.col("hr").cast("int").alias("hr"))
    return rows.groupBy(key).applyInPandas(run, f"`{key}` {kind}, fit binary")


def decimated(rows: DataFrame, key: str, ts: str, value: str, seconds: int = 30, chunk: int = 3600) -> DataFrame:
    """One mean value per ``seconds``, gathered in arrays of at most ``chunk`` seconds."""
    bins = rows.groupBy(key, F.floor(F.col(ts) / seconds).alias("_bin")).agg(F.avg(value).alias("v"))
    g = bins.groupBy(key, F.floor(F.col("_bin") * seconds / chunk).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct((F.col("_bin") * seconds).alias("t"), "v"))).alias("series"))
    return g.select(key, (F.col("chunk") * chunk).alias("start"), "series")


def sensor_csv(streams: dict[str, DataFrame], path: str) -> None:
    """Several (device, t, value) streams as one long table."""
    out = None
    for name, df in streams.items():
        part = df.select(F.lit(name).alias("stream"), "device", "t", F.col("value").cast("double").alias("value"))
        out = part if out is None else out.unionByName(part)
    if out is not None:
        out.write.mode("overwrite").option("header", True).csv(path)


def _stamp(ts: str, offset: str):
    """Wall time of epoch seconds at an offset of minutes."""
    return F.date_format(F.timestamp_seconds(F.col(ts) + F.col(offset) * 60), "yyyy-MM-dd HH:mm:ss")


def _zone(offset: str):
    minutes = F.abs(F.col(offset))
    return F.format_string("UTC%s%02d:%02d", F.when(F.col(offset) < 0, "-").otherwise("+"), F.floor(minutes / 60), minutes % 60)


def _table(out: DataFrame, path: str) -> None:
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_sleeps(sleeps: DataFrame, path: str) -> None:
    """Sleeps (start_ts, end_ts, offset in minutes, is_nap, asleep_min, efficiency as a fraction) as ``read_sleeps`` reads them."""
    _table(sleeps.select(_stamp("start_ts", "offset").alias("Cycle start time"), _zone("offset").alias("Cycle timezone"), _stamp("start_ts", "offset").alias("Sleep onset"), _stamp("end_ts", "offset").alias("Wake onset"), F.col("is_nap").cast("string").alias("Nap"), F.col("asleep_min").alias("Asleep duration (min)"), (F.col("efficiency") * 100).alias("Sleep efficiency %")), path)


def write_workouts(workouts: DataFrame, path: str) -> None:
    """Workouts (start_ts, end_ts, offset, sport, strain of 100, energy_kcal, avg_hr, max_hr, distance_m, zones) as ``read_workouts`` reads them."""
    zones = [F.get("zones", F.lit(k)).alias(f"HR Zone {k + 1} %") for k in range(5)]
    _table(workouts.select(_stamp("start_ts", "offset").alias("Cycle start time"), _zone("offset").alias("Cycle timezone"), _stamp("start_ts", "offset").alias("Workout start time"), _stamp("end_ts", "offset").alias("Workout end time"), F.col("sport").alias("Activity name"), (F.col("strain") * 21 / 100).alias("Activity Strain"), F.col("energy_kcal").alias("Energy burned (cal)"), F.col("avg_hr").alias("Average HR (bpm)"), F.col("max_hr").alias("Max HR (bpm)"), F.col("distance_m").alias("Distance (meters)"), *zones), path)


def write_journal(answers: DataFrame, path: str) -> None:
    """Answers (cycle_start, offset, question, answer, notes) as ``read_journal`` reads them."""
    _table(answers.select(_stamp("cycle_start", "offset").alias("Cycle start time"), _zone("offset").alias("Cycle timezone"), F.col("question").alias("Question text"), F.when(F.col("answer"), "true").when(~F.col("answer"), "false").alias("Answered yes"), F.col("notes").alias("Notes")), path)
