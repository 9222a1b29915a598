"""Order-dependent folds: they are not associative, so each runs over one key's ordered history.

A history of days is bounded by a key's lifetime, so it is gathered per key as one array of structs and folded by a
native ``aggregate``: no Python, one row a key. ``states`` keeps the state after every row. Past states are gathered in
blocks, so a step copies one block at most and a fold takes time in proportion to the history.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: States of a block.
BLOCK = 128


def states(df: DataFrame, key: str, order: str, columns: list[str], start: Column, step: Callable[[Column, Column], Column], out: str = "state") -> DataFrame:
    """key, order, columns and the state after each row. ``step(state, row)`` gives the next state, of the type of start."""
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("_rows"))
    first = F.struct(F.array(start).alias("block"), F.array().cast(f"array<array<{_type(df, start)}>>").alias("blocks"))

    def next_(acc: Column, row: Column) -> Column:
        # The last of the block is the state; nothing binds a whole accumulator, which would copy it.
        block, full = acc["block"], F.size(acc["block"]) >= BLOCK
        new = F.array(step(F.element_at(block, -1), row))
        return F.struct(F.when(full, new).otherwise(F.concat(block, new)).alias("block"), F.when(full, F.concat(acc["blocks"], F.array(block))).otherwise(acc["blocks"]).alias("blocks"))

    def past(a: Column) -> Column:
        """All states but the first, which is the start."""
        return F.slice(F.flatten(F.concat(a["blocks"], F.array(a["block"]))), 2, 1 << 30)

    folded = rows.select(key, "_rows", F.aggregate("_rows", first, next_, past).alias("_past"))
    return folded.select(key, F.explode(F.arrays_zip("_rows", "_past")).alias("_z")).select(key, f"_z._rows.{order}", *(f"_z._rows.{c}" for c in columns), F.col("_z._past").alias(out))


def _type(df: DataFrame, start: Column) -> str:
    return df.select(start.alias("s")).schema["s"].dataType.simpleString()
