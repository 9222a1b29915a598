"""What a database does by triggers, as one join of two versions: images before and after, touched versions, kept columns,
and the days whose derived tables are no longer valid.

``captured`` compares a table with incoming rows (an ``op`` column says upsert or delete) and gives every key that changes
with both images. ``applied`` makes the next table of them. Rules:

* of repeated incoming keys the last by ``order`` counts; equal orders are settled by all columns, so the result is fixed;
* a key with a null in it equals only itself (null-safe), a null value equals a null value;
* ``kept`` columns keep the value before, where the row before says so (``guard``): a person's correction outlives a sync;
* a row that would not change is no change: no new version, no new time, no day to recompute;
* a delete of a key that is not there is nothing; an upsert after a delete in the same batch is what its order says.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_of_each(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key: the last by ``order``, ties by the other columns. As a maximum, so it is combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    best = rows.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("_r"))
    return best.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in [order, *rest]))


def captured(before: DataFrame, incoming: DataFrame, keys: list[str], values: list[str], order: str, kept: list[str] = (), guard: str | None = None, op: str = "op") -> DataFrame:
    """keys, change (insert, update or delete), before and after: images of ``values``, null where there is no row.

    ``before`` has keys and values; ``incoming`` has those, ``order`` and ``op`` ("upsert" or "delete").
    """
    image = lambda *names: F.struct(*names)
    old = before.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), image(*values).alias("before"))
    new = last_of_each(incoming.select(*keys, *values, order, op), keys, order).select(*keys, image(*values).alias("sent"), op)
    match = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)))
    rows = new.join(old, match, "left")
    held = F.coalesce(F.col(f"before.{guard}"), F.lit(False)) if guard else F.lit(True)
    field = lambda c: F.when(F.col("before").isNotNull() & held, F.col(f"before.{c}")).otherwise(F.col(f"sent.{c}")) if c in kept else F.col(f"sent.{c}")
    after = F.when(F.col(op) == "upsert", image(*(field(c).alias(c) for c in values)))
    rows = rows.withColumn("after", after)
    change = F.when(F.col("before").isNull() & F.col("after").isNotNull(), "insert").when(F.col("after").isNull() & F.col("before").isNotNull(), "delete")
    change = change.when(~F.col("before").eqNullSafe(F.col("after")), "update")
    return rows.withColumn("change", change).filter(F.col("change").isNotNull()).select(*keys, "change", "before", "after")


def applied(table: DataFrame, changes: DataFrame, keys: list[str], values: list[str], now: Column, version: str = "version", touched: str = "updated_at") -> DataFrame:
    """The next version of ``table`` (keys, values, version, touched): only changed rows get a new version and time."""
    c = changes.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "change", "after", F.lit(True).alias("_met"))
    match = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)))
    rows = table.join(c, match, "full").filter(F.col("change").isNull() | (F.col("change") != "delete"))
    met = F.coalesce("_met", F.lit(False))
    return rows.select(
        *(F.when(met, F.col(f"_k{i}")).otherwise(F.col(k)).alias(k) for i, k in enumerate(keys)),
        *(F.when(met, F.col(f"after.{v}")).otherwise(F.col(v)).alias(v) for v in values),
        F.when(met, F.coalesce(version, F.lit(0)) + 1).otherwise(F.col(version)).alias(version),
        F.when(met, now).otherwise(F.col(touched)).alias(touched),
    )


def invalidated(changes: DataFrame, owner: str, day: str, kind: str) -> DataFrame:
    """(owner, day, kind): the days of either image of a change, once each; a row that moves to another day makes both stale."""
    days = F.array_distinct(F.filter(F.array(f"before.{day}", f"after.{day}"), lambda d: d.isNotNull()))
    return changes.select(owner, F.explode(days).alias("day")).distinct().withColumn("kind", F.lit(kind))
