"""Windows of days that slide over a stored stream: a slide reads the days that it adds, and merges them with what is kept.

Kept are partial sums of each key and day (count, sum, centred squares, extremes), a folder a day. A window inside what is
kept is served from it; one that goes on to the right is extended by the days that are missing; anything else (a gap, an
earlier window) is read whole, and what was kept before is dropped, as are days that lie before the window. Days without
rows are known by the kept range, so they are not read again. The result equals that of a full read: sums of days are merged
as the statistics of groups are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SERVE, EXTEND, FULL = "serve", "extend", "full"


def planned(kept: tuple[int, int] | None, first: int, last: int) -> tuple[str, int, int]:
    """What has to be done for the days first to last, and the days that have to be read."""
    if kept is None or first < kept[0] or first > kept[1] + 1:
        return FULL, first, last
    if last <= kept[1]:
        return SERVE, 0, -1
    return EXTEND, kept[1] + 1, last


class SlidingReader:
    """Statistics of a value by key over windows of days. ``source`` gives (key, day, value) rows partitioned by day."""

    def __init__(self, spark: SparkSession, source: Callable[[], DataFrame], folder: str, key: str, day: str, value: str):
        self.spark, self.source, self.folder = spark, source, folder
        self.key, self.day, self.value = key, day, value
        self.kept: tuple[int, int] | None = None
        self.last_read: DataFrame | None = None  # what the last slide read, for its plan

    def _days(self, first: int, last: int) -> DataFrame:
        return self.source().filter(F.col(self.day).between(first, last))

    def _partials(self, rows: DataFrame) -> DataFrame:
        v = F.col(self.value)
        return rows.groupBy(self.key, self.day).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("square"), F.min(v).alias("low"), F.max(v).alias("high"))

    def _forget(self, first: int, last: int) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        files = path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for k in range(first, last + 1):
            files.delete(path(f"{self.folder}/{self.day}={k}"), True)

    def window(self, first: int, last: int) -> DataFrame:
        """key, n, mean, sd (of the sample), low and high over the days first to last, both included."""
        kind, a, b = planned(self.kept, first, last)
        self.last_read = None
        if kind == FULL and self.kept:
            self._forget(*self.kept)
        if kind != SERVE:
            self._forget(a, b)  # days of a slide that failed half-way
            self.last_read = self._days(a, b)
            self._partials(self.last_read).write.mode("append").partitionBy(self.day).parquet(self.folder)
            low = first if kind == FULL else self.kept[0]
            if low < first:
                self._forget(low, first - 1)
            self.kept = (first, last)
        schema = f"{self.key} {self.source().schema[self.key].dataType.simpleString()}, n long, mean double, square double, low double, high double, {self.day} long"
        p = self.spark.read.schema(schema).parquet(self.folder).filter(F.col(self.day).between(first, last))
        n, mean = F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.nullif(F.sum("n"), F.lit(0))
        total = p.groupBy(self.key).agg(n.alias("n"), mean.alias("mean"), F.sum("square").alias("within"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("squares"), F.min("low").alias("low"), F.max("high").alias("high"))
        spread = F.greatest(F.col("within") + F.col("squares") - F.col("n") * F.col("mean") * F.col("mean"), F.lit(0.0))
        return total.select(self.key, "n", "mean", F.when(F.col("n") > 1, F.sqrt(spread / (F.col("n") - 1))).alias("sd"), "low", "high")
