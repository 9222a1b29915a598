"""Staging again of sessions whose bounds were edited: only these are read, decoded, and swapped in one replacement.

The stored stages and the raw rows are tables partitioned by day. The dirty set is the edited sessions; the raw rows are
met by (key, day), so only partitions of days with an edited session are read. A session is decoded again if its raw rows
between its bounds are dense enough; else its stages stay as they are. All healed sessions replace theirs by one
overwrite of the days that they touch, in which the other sessions of those days are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored as kept


def dense_rows(edited: DataFrame, raw: DataFrame, least: int = 20, every: int = 120) -> DataFrame:
    """Raw rows (with the session's id and bounds) of edited sessions with a row each ``every`` seconds, ``least`` at least.

    ``edited``: key, id, start_t, end_t; ``raw``: key, day (t in days), t and more.
    """
    days = F.sequence(F.floor(F.col("start_t") / 86400), F.floor(F.col("end_t") / 86400))
    spans = edited.filter("end_t >= start_t").select("key", "id", "start_t", "end_t", F.explode(days).alias("day"))
    rows = raw.join(spans, ["key", "day"]).filter(F.col("t").between(F.col("start_t"), F.col("end_t")))
    found = rows.groupBy("key", "id").agg(F.count("*").alias("_n"), F.first("start_t").alias("_s"), F.first("end_t").alias("_e"))
    enough = found.filter(F.col("_n") >= F.greatest(F.lit(least), F.floor(F.greatest(F.col("_e") - F.col("_s"), F.lit(1)) / every))).select("key", "id")
    return rows.join(enough, ["key", "id"])


def heal(edited: DataFrame, raw: DataFrame, stages: str, decode: Callable[[DataFrame], DataFrame], least: int = 20, every: int = 120) -> DataFrame:
    """Decode the dense edited sessions again and put them into the table of stages at the path ``stages``.

    ``decode`` makes (key, id, day, t, label) rows of dense rows. Returned are the healed (key, id). The table is
    partitioned by day; days that no healed session touches, before or after, are neither read nor written.
    """
    spark = edited.sparkSession
    new = kept(decode(dense_rows(edited, raw, least, every)).select("key", "id", "day", "t", "label"))
    healed = kept(new.select("key", "id").distinct())
    before = spark.read.parquet(stages)
    old = edited.join(healed, ["key", "id"]).select("key", "id", F.explode(F.sequence(F.floor(F.col("old_start") / 86400), F.floor(F.col("old_end") / 86400))).alias("day"))
    touched = old.select("day").union(new.select("day")).distinct()
    rest = before.join(touched, "day").join(healed, ["key", "id"], "left_anti").select("key", "id", "day", "t", "label")
    whole = kept(rest.unionByName(new))  # the read ends before the write begins
    empty = touched.join(whole.select("day").distinct(), "day", "left_anti")
    # A day that loses its only session is written as one empty partition's worth of nothing: by a null row that readers drop.
    gone = empty.select(F.lit(None).cast(before.schema["key"].dataType).alias("key"), F.lit(None).cast(before.schema["id"].dataType).alias("id"), "day", F.lit(None).cast("long").alias("t"), F.lit(None).cast("string").alias("label"))
    whole.unionByName(gone).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(stages)
    return healed


def read_stages(spark, path: str) -> DataFrame:
    """The rows of a table of stages."""
    return spark.read.parquet(path).filter("id IS NOT NULL")
