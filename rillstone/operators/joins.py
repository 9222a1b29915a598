"""Joins that Spark lacks as such: nearest in time, ranges by buckets, bands of days, priority merges.

Range joins become equi-joins on buckets as wide as the longest range allowed, with an exact condition behind, so they
never fall back to a nested loop and a pair meets in one bucket only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: How many times the tolerance a bucket of a nearest-in-time join is wide.
BUCKETS = 64


def nearest(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, tolerance: float) -> DataFrame:
    """Each row of ``left`` with the ``value`` of the nearest row of ``right`` within ``tolerance``; the later wins a tie.

    Time is cut in buckets many times as wide as the tolerance; a right row also goes to a neighbouring bucket if it is
    within reach of it. In a bucket of a key one union sorted by time gives the last right row so far and, read backwards,
    the next one: the only candidates. Work is in proportion to the rows, and a key's history is not one task.
    """
    width = BUCKETS * max(1.0, float(tolerance))
    bucket = lambda t: F.floor(t / F.lit(width))
    mine = left.withColumn("_right", F.lit(None).cast("struct<ts:double,value:double>")).withColumn("_side", F.lit(1)).withColumn("_bucket", bucket(F.col(ts)))
    theirs = right.groupBy(key, ts).agg(F.max(value).alias("_v")).select(key, ts, F.struct(F.col(ts).cast("double").alias("ts"), F.col("_v").cast("double").alias("value")).alias("_right"), F.lit(0).alias("_side"))
    theirs = theirs.withColumn("_bucket", F.explode(F.sequence(bucket(F.col(ts) - tolerance), bucket(F.col(ts) + tolerance))))
    both = mine.unionByName(theirs, allowMissingColumns=True)
    w = W.partitionBy(key, "_bucket")
    so_far = lambda order: F.last("_right", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    both = both.withColumn("_back", so_far(w.orderBy(ts, "_side"))).withColumn("_ahead", so_far(w.orderBy(F.desc(ts), "_side"))).filter("_side = 1")
    gap_back, gap_ahead = F.col(ts) - F.col("_back.ts"), F.col("_ahead.ts") - F.col(ts)
    pick = F.when(F.col("_back").isNull() | (gap_ahead <= gap_back), F.struct(gap_ahead.alias("gap"), F.col("_ahead.value").alias("value"))).otherwise(F.struct(gap_back.alias("gap"), F.col("_back.value").alias("value")))
    pick = F.when(F.col("_ahead").isNull(), F.struct(gap_back.alias("gap"), F.col("_back.value").alias("value"))).otherwise(pick)
    both = both.withColumn("_pick", pick)
    return both.withColumn("nearest", F.when(F.col("_pick.gap") <= tolerance, F.col("_pick.value"))).drop("_right", "_side", "_bucket", "_back", "_ahead", "_pick")


def last_before(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, name: str = "as_of") -> DataFrame:
    """Each row of ``left`` with the value of the last row of ``right`` at or before it."""
    mine = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_side", F.lit(1))
    theirs = right.select(key, ts, F.col(value).alias("_v"), F.lit(0).alias("_side"))
    w = W.partitionBy(key).orderBy(ts, "_side", "_v").rowsBetween(W.unboundedPreceding, 0)
    both = mine.unionByName(theirs, allowMissingColumns=True).withColumn(name, F.last("_v", ignorenulls=True).over(w))
    return both.filter("_side = 1").drop("_v", "_side")


def contained(points: DataFrame, spans: DataFrame, key: str, ts: str, start: str, end: str, bucket: int) -> DataFrame:
    """Points inside spans [start, end]: spans are cut in buckets of time, so both sides meet by equality."""
    cut = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
    placed = points.withColumn("_bucket", F.floor(F.col(ts) / bucket))
    return placed.join(cut, [key, "_bucket"]).filter(F.col(ts).between(F.col(start), F.col(end))).drop("_bucket")


def overlapping(left: DataFrame, right: DataFrame, key: str, bucket: int) -> DataFrame:
    """Pairs of spans (a_start, a_end) and (b_start, b_end) that overlap; a pair is made in the first bucket it shares."""
    spread = lambda df, a, b: df.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.col(b) / bucket))))
    pairs = spread(left, "a_start", "a_end").join(spread(right, "b_start", "b_end"), [key, "_bucket"])
    pairs = pairs.filter((F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end")))
    return pairs.filter(F.col("_bucket") == F.floor(F.greatest("a_start", "b_start") / bucket)).drop("_bucket")


def lagged_days(x: DataFrame, y: DataFrame, key: str, lag: int) -> DataFrame:
    """x of a day with y of ``lag`` days later."""
    return x.join(y.withColumn("day", F.date_sub("day", lag)), [key, "day"])


def band_days(marks: DataFrame, values: DataFrame, key: str, value: str, first: int, last: int) -> DataFrame:
    """Mean of the values ``first`` to ``last`` days before each mark: each value day is sent to the marks it can serve."""
    served = values.select(key, value, F.explode(F.sequence(F.date_add("day", first), F.date_add("day", last))).alias("day"))
    return marks.join(served, [key, "day"], "left").groupBy(*marks.columns).agg(F.avg(value).alias(f"mean_{value}"), F.count(value).alias("n_days"))


def prioritised(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    w = W.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def day_spine(rows: DataFrame, key: str, day: str = "day") -> DataFrame:
    """Every day from a key's first to its last."""
    return rows.groupBy(key).agg(F.min(day).alias("_a"), F.max(day).alias("_b")).select(key, F.explode(F.sequence("_a", "_b")).alias(day))
