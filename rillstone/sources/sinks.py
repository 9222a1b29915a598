"""Writes expressed as the table that results: upserts, replacements, idempotent appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_wins(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key. Keys are unique on each side."""
    rest = [c for c in old.columns if c not in key]
    a = old.select(*key, F.struct(*rest).alias("_old"))
    b = new.select(*key, F.struct(*rest).alias("_new"))
    return a.join(b, key, "full").select(*key, F.coalesce("_new", "_old").alias("_row")).select(*key, "_row.*")


def preserve_columns(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Only ``columns`` change, and only where ``new`` has a value."""
    fresh = new.select(*key, *(F.col(c).alias(f"_{c}") for c in columns))
    out = old.join(fresh, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"_{c}", c))
    return out.select(*old.columns)


def range_replaced(old: DataFrame, new: DataFrame, inside: Column) -> DataFrame:
    """Rows of ``old`` in the range give way to ``new``."""
    return old.filter(~inside | inside.isNull()).unionByName(new)


def append_new(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not there yet are added; a key that comes twice is added once."""
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti").select(*old.columns))


def write_days(df: DataFrame, path: str, day: str = "day") -> None:
    """Replace the days that ``df`` holds in a table partitioned by day; other days stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
