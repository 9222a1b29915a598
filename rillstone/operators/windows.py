"""Sequence operators: differences, frames by rows and by range, islands, streaks, ranks.

Everything is a window over one key and an order with a tiebreak; rows of different keys never meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by(key: str | list[str], order: list[str]):
    return W.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order)


def islands(df: DataFrame, key: str, order: list[str], ts: str, gap: float, name: str = "island") -> DataFrame:
    """Number the runs of rows whose distance to the row before is at most ``gap``."""
    w = by(key, order)
    cut = F.when(F.col(ts) - F.lag(ts).over(w) <= gap, 0).otherwise(1)
    return df.withColumn("_cut", cut).withColumn(name, F.sum("_cut").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_cut")


def runs(df: DataFrame, key: str, order: list[str], label: str, name: str = "run") -> DataFrame:
    """Number the runs of consecutive equal labels; a null label is a label of its own."""
    w = by(key, order)
    before = F.lag(label).over(w)
    cut = F.when(F.col(label).eqNullSafe(before) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_cut", cut).withColumn(name, F.sum("_cut").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_cut")


def day_streaks(days: DataFrame, key: str, day: str) -> DataFrame:
    """key, first_day, last_day, length of each run of consecutive days. Days may repeat."""
    rows = days.select(key, day).distinct()
    anchor = F.date_sub(F.col(day), F.row_number().over(by(key, [day])))
    return rows.withColumn("_anchor", anchor).groupBy(key, "_anchor").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("length")).drop("_anchor")


def capped_durations(ts: str, w, cap: float, fallback: float) -> Column:
    """Seconds to the next row, at most ``cap``; the last row takes the gap before it, a lone row ``fallback``."""
    ahead = F.lead(ts).over(w) - F.col(ts)
    behind = F.col(ts) - F.lag(ts).over(w)
    return F.least(F.lit(float(cap)), F.coalesce(ahead, behind, F.lit(fallback)).cast("double"))


def ranged(df: DataFrame, key: str, ts: str, before: int, after: int, **values: Column) -> DataFrame:
    """df with statistics of the rows of its key whose whole ``ts`` lies from ``before`` before a row's own to ``after`` after it.

    For each of ``values`` there are a count ``_n``, a sum ``_sum``, a mean ``_mean`` and a deviation ``_sd`` (of the population)
    of what is not null, behind its name. Time is cut in blocks as long as the range, so a range is the end of one block and
    the beginning of the next. Both are running statistics, without differences: work is in proportion to the rows however
    many a range holds, and a task holds a key's two blocks. Rows without a ``ts`` have each other as range.
    """
    width = before + after
    t = F.col(ts).cast("long")
    start = lambda x: x - F.pmod(x, F.lit(width + 1))
    place = lambda block, at, role, asks: F.struct(block.alias("block"), at.alias("at"), F.lit(role).alias("role"), F.lit(asks).alias("asks"))
    places = [place(start(t), t, "new", not after), place(start(t) + width + 1, t, "old", False)] + ([place(start(t + after), t + after, "none", True)] if after else [])
    dealt = df.withColumns({f"_v_{name}": v for name, v in values.items()}).withColumn("_p", F.explode(F.array(*places))).filter("_p.at IS NOT NULL OR _p.role <> 'old'")
    dealt = dealt.withColumns({"_block": F.col("_p.block"), "_at": F.col("_p.at"), "_role": F.col("_p.role"), "_asks": F.col("_p.asks")}).drop("_p")
    group = W.partitionBy(key, "_block")
    new = group.orderBy("_at").rangeBetween(W.unboundedPreceding, 0)
    old = group.orderBy(F.desc("_at")).rangeBetween(W.unboundedPreceding, width)
    parts = {}
    for name in values:
        for role, w in (("new", new), ("old", old)):
            v = F.when(F.col("_role") == role, F.col(f"_v_{name}"))
            parts |= {f"_{role}_n_{name}": F.count(v).over(w), f"_{role}_sum_{name}": F.sum(v).over(w), f"_{role}_mean_{name}": F.avg(v).over(w), f"_{role}_var_{name}": F.var_pop(v).over(w)}
    found = dealt.withColumns(parts).filter("_asks")
    out = {}
    for name in values:
        (n, s, m, q), (n2, s2, m2, q2) = ([F.col(f"_{role}_{k}_{name}") for k in ("n", "sum", "mean", "var")] for role in ("new", "old"))
        both = n + n2
        apart = F.when((n > 0) & (n2 > 0), (m - m2) * (m - m2) * n * n2 / both).otherwise(0.0)
        spread = (F.coalesce(q * n, F.lit(0.0)) + F.coalesce(q2 * n2, F.lit(0.0)) + apart) / F.nullif(both, F.lit(0))
        total = F.coalesce(s + s2, s, s2)
        out |= {f"{name}_n": both, f"{name}_sum": total, f"{name}_mean": total / F.nullif(both, F.lit(0)), f"{name}_sd": F.sqrt(spread)}
    return found.select(*df.columns, *(c.alias(name) for name, c in out.items()))


def trailing_rows(key: str, order: list[str], n: int, current: bool = True):
    return by(key, order).rowsBetween(-n + 1 if current else -n, 0 if current else -1)


def modulo_deltas(counter: str, w, modulus: int = 65536) -> Column:
    """Increase of a counter that wraps around."""
    return F.pmod(F.col(counter) - F.lag(counter).over(w), F.lit(modulus))


def quantile(df: DataFrame, key: str, value: str, q: float, name: str) -> DataFrame:
    """key and the exact, linearly interpolated quantile of its values.

    Equal values are counted first, and the ranks run over the counts: no task holds a key's values, only sorts them.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    w = W.partitionBy(key)
    ranked = counts.withColumn("_upto", F.sum("_n").over(w.orderBy("_v").rowsBetween(W.unboundedPreceding, 0))).withColumn("_at", (F.sum("_n").over(w) - 1) * F.lit(q))
    low, high = F.floor("_at"), F.ceil("_at")
    holds = lambda rank: F.when((F.col("_upto") > rank) & (F.col("_upto") - F.col("_n") <= rank), F.col("_v"))
    found = ranked.groupBy(key).agg(F.max(holds(low)).alias("_a"), F.max(holds(high)).alias("_b"), F.max("_at").alias("_at"))
    return found.select(key, (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - F.floor("_at"))).alias(name))
