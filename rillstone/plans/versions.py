"""Two versions of the orders: captured changes, the table that they lead to, and the days that they make stale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import query
from ..operators.changes import applied, captured, invalidated
from .bindings import table

KEYS, VALUES = ["id"], ["owner", "day", "price", "locked"]
#: What comes in for an order, by its number modulo eleven: (remainder, order, op, key, day, price), in words of both engines.
SENT = (
    (0, 1, "delete", "id", "day", "price"), (1, 1, "upsert", "id", "day", "price"), (2, 1, "upsert", "id", "day", "price + 1"), (3, 1, "upsert", "id", "day + 1", "price"),
    (4, 1, "upsert", "id", "day", "price + 5"), (4, 2, "upsert", "id", "day", "price + 7"), (5, 1, "upsert", "id + 1000000000", "day", "price"), (6, 1, "delete", "id", "day", "price"),
    (6, 2, "upsert", "id", "day", "price"), (7, 1, "upsert", "id", "day", "price"), (7, 2, "delete", "id", "day", "price"), (8, 1, "delete", "id + 1000000000", "day", "price"),
)


def before(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), F.datediff("o_orderdate", F.lit("1970-01-01")).cast("long").alias("day"), F.round("o_totalprice", 2).alias("price"), (F.col("o_orderkey") % 5 == 0).alias("locked"))


def incoming(spark, sf) -> DataFrame:
    sent = [F.struct(F.lit(r).alias("r"), F.lit(n).alias("sent"), F.lit(op).alias("op"), F.expr(k).alias("id"), F.expr(d).cast("long").alias("day"), F.expr(p).alias("price")) for r, n, op, k, d, p in SENT]
    rows = before(spark, sf).select("owner", "locked", F.col("id").alias("_id"), F.explode(F.array(*sent)).alias("x")).filter("x.r = _id % 11")
    return rows.select("x.id", "owner", "x.day", "x.price", F.lit(False).alias("locked"), "x.sent", "x.op")


def changes(spark, sf) -> DataFrame:
    return captured(before(spark, sf), incoming(spark, sf), KEYS, VALUES, "sent", ["day", "locked"], "locked")


CHANGES = f"""b AS (SELECT o_orderkey AS id, o_custkey AS owner, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day, round(o_totalprice, 2) AS price, o_orderkey % 5 = 0 AS locked FROM orders),
i AS ({" UNION ALL ".join(f"SELECT {k} AS id, owner, {d} AS day, {p} AS price, false AS locked, {n} AS sent, '{op}' AS op FROM b WHERE id % 11 = {r}" for r, n, op, k, d, p in SENT)}),
l AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY id ORDER BY sent DESC) = 1),
m AS (SELECT l.id, l.op, b.id IS NOT NULL AS old, b.owner AS owner0, b.day AS day0, b.price AS price0, b.locked AS locked0, l.owner AS owner1, CASE WHEN b.locked THEN b.day ELSE l.day END AS day1, l.price AS price1, coalesce(b.locked, l.locked) AS locked1 FROM l LEFT JOIN b USING (id)),
c AS (SELECT *, CASE WHEN NOT old AND op = 'upsert' THEN 'insert' WHEN old AND op = 'delete' THEN 'delete' WHEN old AND (owner0 <> owner1 OR day0 <> day1 OR price0 <> price1) THEN 'update' END AS change FROM m),
ch AS (SELECT id, change, CASE WHEN change <> 'insert' THEN owner0 END AS owner0, CASE WHEN change <> 'insert' THEN day0 END AS day0, CASE WHEN change <> 'insert' THEN price0 END AS price0,
  CASE WHEN change <> 'delete' THEN owner1 END AS owner1, CASE WHEN change <> 'delete' THEN day1 END AS day1, CASE WHEN change <> 'delete' THEN price1 END AS price1, locked1 FROM c WHERE change IS NOT NULL)"""


@query(f"WITH {CHANGES} SELECT id, change, round(price0, 2)::VARCHAR AS price_before, round(price1, 2)::VARCHAR AS price_after, day0::VARCHAR AS day_before, day1::VARCHAR AS day_after FROM ch")
def change_capture(spark, sf):
    """Images before and after of what really changes: inserts, updates, deletes; repeats, deletes of nothing and equal rows are none."""
    money = lambda c: F.col(c).cast("decimal(18,2)").cast("double").cast("string")
    return changes(spark, sf).select("id", "change", money("before.price").alias("price_before"), money("after.price").alias("price_after"), F.col("before.day").cast("string").alias("day_before"), F.col("after.day").cast("string").alias("day_after"))


@query(f"""WITH {CHANGES} SELECT coalesce(ch.id, b.id) AS id, coalesce(owner1, owner) AS owner, coalesce(day1, day) AS day, round(coalesce(price1, price), 2) AS price, coalesce(ch.locked1, b.locked) AS locked,
CASE WHEN change IS NULL THEN 1 WHEN change = 'insert' THEN 1 ELSE 2 END AS version, CASE WHEN change IS NULL THEN 100 ELSE 200 END AS updated_at FROM b FULL JOIN ch ON ch.id = b.id WHERE coalesce(change, '') <> 'delete'""")
def change_applied(spark, sf):
    """The next version: only rows that change get a new number and time; a locked day stays."""
    t = before(spark, sf).withColumn("version", F.lit(1)).withColumn("updated_at", F.lit(100))
    return applied(t, changes(spark, sf), KEYS, VALUES, F.lit(200)).withColumn("price", F.round("price", 2))


@query(f"WITH {CHANGES}, o AS (SELECT coalesce(owner1, owner0) AS owner, unnest([day0, day1]) AS day FROM ch) SELECT DISTINCT owner, day, 'metrics_updated' AS kind FROM o WHERE day IS NOT NULL")
def change_days(spark, sf):
    """The owners' days whose derived rows are stale."""
    c = changes(spark, sf).withColumn("owner", F.coalesce("after.owner", "before.owner"))
    return invalidated(c, "owner", "day", "metrics_updated")
