"""Joins of every form, over days, times, spans and priorities."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..catalog import query
from ..functions.stats import correlation
from ..operators.joins import band_days, contained, day_spine, lagged_days, last_before, nearest, overlapping, prioritised
from ..operators.windows import by
from .bindings import DAILY, SESSIONS, SHIPPED, STREAM, daily, sessions, shipped, stream, table


@query(f"WITH {DAILY}, {SHIPPED} SELECT device, day, round(price, 6) AS x, round(quantity, 6) AS y FROM d JOIN sh USING (device, day)", days="day")
def join_by_day(spark, sf):
    return daily(spark, sf).join(shipped(spark, sf), ["device", "day"]).select("device", "day", F.round("price", 6).alias("x"), F.round("quantity", 6).alias("y"))


@query(f"WITH {DAILY}, {SHIPPED} SELECT d.device, count(*) AS n, round(corr(quantity, price), 6) AS r FROM d JOIN sh ON d.device = sh.device AND sh.day = d.day + 2 GROUP BY d.device")
def join_lagged_days(spark, sf):
    pairs = lagged_days(daily(spark, sf), shipped(spark, sf), "device", 2)
    return pairs.groupBy("device").agg(F.count("*").alias("n"), F.round(F.corr("price", "quantity"), 6).alias("r"))


@query(f"""WITH {DAILY}, {SHIPPED}, l(lag) AS (VALUES (0), (1), (2)), c AS (SELECT d.device, lag, count(*) AS n, corr(quantity, price) AS r FROM d, l JOIN sh ON d.device = sh.device AND sh.day = d.day + CAST(lag AS INTEGER) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY abs(r) DESC, lag) AS k FROM c) SELECT device, lag, n, round(r, 6) AS r FROM k WHERE k = 1""".replace("FROM d, l JOIN sh ON d.device = sh.device AND sh.day = d.day + CAST(lag AS INTEGER)", "FROM d JOIN l ON true JOIN sh ON d.device = sh.device AND sh.day = d.day + CAST(lag AS INTEGER)"))
def join_best_lag(spark, sf):
    """Each day of y serves three lags; the strongest correlation stays."""
    y = shipped(spark, sf).withColumn("lag", F.explode(F.array(*map(F.lit, range(3))))).withColumn("day", F.expr("date_sub(day, lag)"))
    found = daily(spark, sf).join(y, ["device", "day"]).groupBy("device", "lag").agg(F.count("*").alias("n"), F.corr("price", "quantity").alias("r"))
    return prioritised(found, ["device"], [F.desc(F.abs("r")), "lag"]).withColumn("r", F.round("r", 6))


@query(f"""WITH {DAILY}, {SHIPPED}, m AS (SELECT device, day, urgent FROM d WHERE urgent >= 2) SELECT m.device, m.day, m.urgent, round(avg(quantity), 6) AS mean_quantity, count(quantity) AS n_days
FROM m LEFT JOIN sh ON sh.device = m.device AND sh.day BETWEEN m.day - 13 AND m.day GROUP BY ALL""", days="day")
def join_trailing_band(spark, sf):
    marks = daily(spark, sf).filter("urgent >= 2").select("device", "day", "urgent")
    return band_days(marks, shipped(spark, sf), "device", "quantity", 0, 13).withColumn("mean_quantity", F.round("mean_quantity", 6))


@query(f"""WITH {DAILY}, b AS (SELECT device, avg(price) AS base FROM d GROUP BY device), tag AS (SELECT device, day FROM d WHERE urgent >= 3),
f AS (SELECT tag.device, tag.day, min(CASE WHEN abs(d.price - base) <= 60 THEN d.day - tag.day END) AS days_to_base, count(d.price) AS n FROM tag JOIN b USING (device) LEFT JOIN d ON d.device = tag.device AND d.day BETWEEN tag.day + 1 AND tag.day + 7 GROUP BY ALL)
SELECT device, day, CAST(coalesce(days_to_base, -1) AS BIGINT) AS days_to_base, n FROM f""", days="day")
def join_forward_window(spark, sf):
    """Days until a value is back near its mean, looking one to seven days ahead of each tagged day; -1 if it is not."""
    d = daily(spark, sf)
    base = d.groupBy("device").agg(F.avg("price").alias("base"))
    tagged = d.filter("urgent >= 3").select("device", "day")
    ahead = d.select("device", "price", F.explode(F.sequence(F.date_sub("day", 7), F.date_sub("day", 1))).alias("tag_day"), F.col("day").alias("seen"))
    pairs = tagged.join(F.broadcast(base), "device").join(ahead.withColumnRenamed("tag_day", "day"), ["device", "day"], "left")  # base: a row per device
    back = F.min(F.when(F.abs(F.col("price") - F.col("base")) <= 60, F.datediff("seen", "day")))
    return pairs.groupBy("device", "day").agg(F.coalesce(back, F.lit(-1)).cast("long").alias("days_to_base"), F.count("price").alias("n"))


NEAR = """c AS (SELECT a.device, a.seq, a.t, b.t AS bt, b.bpm, row_number() OVER (PARTITION BY a.seq ORDER BY abs(b.t - a.t), b.t DESC, b.bpm DESC) AS k
FROM (SELECT * FROM s WHERE kind = 'click') a JOIN (SELECT * FROM s WHERE kind = 'view') b ON a.device = b.device AND b.t BETWEEN a.t - 3600 AND a.t + 3600)"""


@query(f"WITH {STREAM}, {NEAR} SELECT s.device, s.seq, round(c.bpm, 6) AS nearest FROM s LEFT JOIN (SELECT * FROM c WHERE k = 1) c ON s.seq = c.seq WHERE s.kind = 'click'")
def join_nearest_in_time(spark, sf):
    s = stream(spark, sf)
    out = nearest(s.filter("kind = 'click'").select("device", "seq", "t"), s.filter("kind = 'view'").select("device", "t", "bpm"), "device", "t", "bpm", 3600)
    return out.select("device", "seq", F.round("nearest", 6).alias("nearest"))


@query(f"""WITH {STREAM}, k AS (SELECT device, t, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS shift FROM s WHERE kind = 'signup' GROUP BY ALL)
SELECT p.device, p.seq, p.t + coalesce(k.shift, 0) AS corrected FROM (SELECT * FROM s WHERE kind = 'purchase') p ASOF LEFT JOIN k ON p.device = k.device AND p.t >= k.t""")
def join_clock_correction(spark, sf):
    """Times shifted by the last offset known at that time."""
    s = stream(spark, sf)
    offsets = s.filter("kind = 'signup'").select("device", "t", F.get_json_object("props", "$.k").cast("long").alias("shift"))
    out = last_before(s.filter("kind = 'purchase'").select("device", "seq", "t"), offsets, "device", "t", "shift")
    return out.select("device", "seq", (F.col("t") + F.coalesce("as_of", F.lit(0))).alias("corrected"))


@query(f"WITH {SESSIONS} SELECT ss.device, ss.start_t, count(*) AS n, round(sum(s.value), 4) AS total FROM ss JOIN s ON s.device = ss.device AND s.t BETWEEN ss.start_t AND ss.end_t WHERE s.kind = 'purchase' GROUP BY ALL")
def join_contained(spark, sf):
    inside = contained(stream(spark, sf).filter("kind = 'purchase'"), sessions(spark, sf).drop("n"), "device", "t", "start_t", "end_t", 86400)
    return inside.groupBy("device", "start_t").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


PAIRS = """a AS (SELECT device, start_t AS a_start, end_t + 21600 AS a_end FROM ss), p AS (SELECT a.device, a_start, a_end, b.start_t AS b_start, b.end_t AS b_end FROM a JOIN ss b ON a.device = b.device AND a_start < b.end_t AND b.start_t < a_end AND b.start_t > a_start)"""


@query(f"""WITH {SESSIONS}, {PAIRS} SELECT device, a_start, b_start, least(a_end, b_end) - greatest(a_start, b_start) AS shared,
  (least(a_end, b_end) - greatest(a_start, b_start) >= 1800 OR 2 * (least(a_end, b_end) - greatest(a_start, b_start)) >= least(a_end - a_start, b_end - b_start)) AS duplicate FROM p""")
def join_overlapping_spans(spark, sf):
    """Pairs of spans that overlap, and whether by half an hour or half of the shorter."""
    s = sessions(spark, sf)
    a = s.select("device", F.col("start_t").alias("a_start"), (F.col("end_t") + 21600).alias("a_end"))
    b = s.select("device", F.col("start_t").alias("b_start"), F.col("end_t").alias("b_end"))
    pairs = overlapping(a, b, "device", 6 * 3600).filter("b_start > a_start")
    shared = F.least("a_end", "b_end") - F.greatest("a_start", "b_start")
    shorter = F.least(F.col("a_end") - F.col("a_start"), F.col("b_end") - F.col("b_start"))
    return pairs.select("device", "a_start", "b_start", shared.alias("shared"), ((shared >= 1800) | (2 * shared >= shorter)).alias("duplicate"))


@query(f"WITH {DAILY}, {SHIPPED} SELECT d.device, d.day, d.n, round(coalesce(sh.quantity, 0), 6) AS quantity FROM d LEFT JOIN sh ON d.device = sh.device AND d.day = sh.day", days="day")
def join_left_days(spark, sf):
    return daily(spark, sf).join(shipped(spark, sf), ["device", "day"], "left").select("device", "day", "n", F.round(F.coalesce("quantity", F.lit(0.0)), 6).alias("quantity"))


@query(f"""WITH {STREAM}, {SESSIONS.replace(STREAM + ', ', '')}, dd AS (SELECT DISTINCT device, t // 86400 AS day FROM s), x AS (SELECT device, t // 86400 AS day, sum(value) AS steps FROM s WHERE kind = 'view' GROUP BY ALL),
y AS (SELECT device, end_t // 86400 AS day, max(end_t - start_t) AS longest FROM ss GROUP BY ALL)
SELECT dd.device, dd.day, round(coalesce(steps, 0), 4) AS steps, coalesce(longest, -1) AS longest FROM dd LEFT JOIN x USING (device, day) LEFT JOIN y USING (device, day)""")
def join_lateral_aggregates(spark, sf):
    """For each day of a device: the sum of its samples and the longest session that ends in it; days without either stay."""
    s = stream(spark, sf).withColumn("day", F.expr("t DIV 86400"))
    steps = s.filter("kind = 'view'").groupBy("device", "day").agg(F.sum("value").alias("steps"))
    longest = sessions(spark, sf).groupBy("device", F.expr("end_t DIV 86400").alias("day")).agg(F.max(F.col("end_t") - F.col("start_t")).alias("longest"))
    out = s.select("device", "day").distinct().join(steps, ["device", "day"], "left").join(longest, ["device", "day"], "left")
    return out.select("device", "day", F.round(F.coalesce("steps", F.lit(0.0)), 4).alias("steps"), F.coalesce("longest", F.lit(-1)).alias("longest"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def join_anti(spark, sf):
    urgent = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(urgent, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 49)")
def join_semi(spark, sf):
    big = table(spark, sf, "lineitem").filter("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").join(big, "o_orderkey", "left_semi").select("o_orderkey", "o_totalprice")


@query(f"""WITH {DAILY}, {SHIPPED}, b AS (SELECT DISTINCT device, day FROM d WHERE urgent > 0) SELECT sh.device, (b.day IS NOT NULL) AS behaviour, count(*) AS n, round(avg(quantity), 6) AS mean
FROM sh LEFT JOIN b ON sh.device = b.device AND sh.day = b.day GROUP BY ALL""")
def join_membership_split(spark, sf):
    days = daily(spark, sf).filter("urgent > 0").select("device", "day", F.lit(True).alias("behaviour"))
    return shipped(spark, sf).join(days, ["device", "day"], "left").groupBy("device", F.coalesce("behaviour", F.lit(False)).alias("behaviour")).agg(F.count("*").alias("n"), F.round(F.avg("quantity"), 6).alias("mean"))


@query(f"""WITH {DAILY}, {SHIPPED}, u AS (SELECT device, day, price AS value, 0 AS source FROM d WHERE urgent > 0 UNION ALL SELECT device, day, quantity, 1 FROM sh UNION ALL SELECT device, day, price, 2 FROM d),
k AS (SELECT *, row_number() OVER (PARTITION BY device, day ORDER BY source) AS k FROM u) SELECT device, day, round(value, 6) AS value, source FROM k WHERE k = 1""", days="day")
def join_source_priority(spark, sf):
    """Sources in order fill each other's gaps day by day."""
    d = daily(spark, sf)
    of = lambda df, c, k: df.select("device", "day", F.col(c).alias("value"), F.lit(k).alias("source"))
    rows = of(d.filter("urgent > 0"), "price", 0).unionByName(of(shipped(spark, sf), "quantity", 1)).unionByName(of(d, "price", 2))
    return prioritised(rows, ["device", "day"], ["source"]).withColumn("value", F.round("value", 6))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, CASE WHEN l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'N' THEN 1 ELSE 2 END AS tier FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY tier, l_discount DESC, l_linenumber, l_quantity) AS k FROM r), w AS (SELECT l_orderkey, l_linenumber AS winner, l_quantity AS value, tier FROM k WHERE k = 1)
SELECT w.l_orderkey, winner, value, w.tier, count(*) AS contributors, CASE WHEN count(*) = 1 THEN 'single' WHEN max(abs(r.l_quantity - value)) <= 5 THEN 'agree' WHEN max(abs(r.l_quantity - value)) <= 15 THEN 'minor' ELSE 'differ' END AS agreement
FROM w JOIN r USING (l_orderkey) GROUP BY ALL""")
def fuse_sources(spark, sf):
    """The winning source of each key by tier, priority and arrival, and how well the others agree with it."""
    flag = F.col("l_returnflag")
    r = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2).alias("tier"))
    first = F.min_by(F.struct("l_linenumber", "l_quantity", "tier"), F.struct("tier", -F.col("l_discount"), "l_linenumber", "l_quantity"))
    g = r.groupBy("l_orderkey").agg(first.alias("w"), F.count("*").alias("contributors"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))
    apart = F.greatest(F.col("high") - F.col("w.l_quantity"), F.col("w.l_quantity") - F.col("low"))
    verdict = F.when(F.col("contributors") == 1, "single").when(apart <= 5, "agree").when(apart <= 15, "minor").otherwise("differ")
    return g.select("l_orderkey", F.col("w.l_linenumber").alias("winner"), F.col("w.l_quantity").alias("value"), F.col("w.tier").alias("tier"), "contributors", verdict.alias("agreement"))


@query(f"""WITH {DAILY}, k AS (SELECT day, device, row_number() OVER (PARTITION BY day ORDER BY (urgent > 2) DESC, n DESC, device) AS k, urgent > 2 AS locked FROM d) SELECT day, device AS owner, locked FROM k WHERE k = 1""", days="day")
def day_owner(spark, sf):
    """A locked owner of a day, else the candidate with most rows."""
    d = daily(spark, sf).withColumn("locked", F.col("urgent") > 2)
    return prioritised(d, ["day"], [F.desc("locked"), F.desc("n"), "device"]).select("day", F.col("device").alias("owner"), "locked")


@query(f"""WITH {SESSIONS}, p AS (SELECT start_t AS t FROM ss UNION SELECT end_t FROM ss), seam AS (SELECT t AS a, lead(t) OVER (ORDER BY t) AS b FROM p),
o AS (SELECT a, b, min(ss.device) AS owner FROM seam JOIN ss ON ss.start_t <= a AND ss.end_t >= b WHERE b IS NOT NULL GROUP BY ALL),
m AS (SELECT *, CASE WHEN lag(owner) OVER (ORDER BY a) = owner AND lag(b) OVER (ORDER BY a) = a THEN 0 ELSE 1 END AS cut FROM o), z AS (SELECT *, sum(cut) OVER (ORDER BY a ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT min(a) AS start_t, max(b) AS end_t, min(owner) AS owner FROM z GROUP BY k""")
def owner_segments(spark, sf):
    """Time cut at all starts and ends, each piece given to the best device that covers it, equal neighbours merged.

    A sweep over starts and ends: which devices are open at each seam follows from running sums per device.
    """
    from .bindings import DEVICES

    s = sessions(spark, sf)
    edges = s.select(F.col("start_t").alias("t"), "device", F.lit(1).alias("step")).unionByName(s.select(F.col("end_t").alias("t"), "device", F.lit(-1).alias("step")))
    seams = edges.groupBy("t").agg(*(F.sum(F.when(F.col("device") == k, F.col("step")).otherwise(0)).alias(f"d{k}") for k in range(DEVICES)))
    # Coarse parts keep the sweep parallel: running sums within a part start from the sums of the parts before it.
    part = F.expr("t DIV 604800")
    seams = seams.withColumn("part", part)
    totals = seams.groupBy("part").agg(*(F.sum(f"d{k}").alias(f"s{k}") for k in range(DEVICES)), F.min("t").alias("first_t"))
    whole = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row a week
    totals = totals.select("part", F.lead("first_t").over(W.orderBy("part")).alias("next_t"), *(F.coalesce(F.sum(f"s{k}").over(whole), F.lit(0)).alias(f"b{k}") for k in range(DEVICES)))
    w = W.partitionBy("part").orderBy("t")
    run = w.rowsBetween(W.unboundedPreceding, 0)
    opened = seams.join(totals, "part").select("part", "t", F.coalesce(F.lead("t").over(w), F.col("next_t")).alias("b"), *((F.sum(f"d{k}").over(run) + F.col(f"b{k}")).alias(f"n{k}") for k in range(DEVICES)))
    owner = F.coalesce(*(F.when(F.col(f"n{k}") > 0, k) for k in range(DEVICES)))
    pieces = opened.select("part", F.col("t").alias("a"), "b", owner.alias("owner")).filter("owner IS NOT NULL AND b IS NOT NULL")
    # Merging needs the piece before, which may lie in the part before: a second sweep over the owner's own pieces.
    w = W.partitionBy("owner").orderBy("a")
    cut = F.when(F.lag("b").over(w) == F.col("a"), 0).otherwise(1)
    pieces = pieces.withColumn("cut", cut).withColumn("k", F.sum("cut").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return pieces.groupBy("owner", "k").agg(F.min("a").alias("start_t"), F.max("b").alias("end_t")).select("start_t", "end_t", F.col("owner").cast("long").alias("owner"))


@query(f"""WITH {DAILY}, {SHIPPED}, u AS (SELECT 'price' AS metric, device, avg(price) AS a FROM d GROUP BY device UNION ALL SELECT 'n', device, avg(n) FROM d GROUP BY device), v AS (SELECT 'price' AS metric, device, avg(quantity) AS b FROM sh WHERE device <> 2 GROUP BY device UNION ALL SELECT 'discount', device, avg(discount) FROM sh GROUP BY device)
SELECT coalesce(u.metric, v.metric) AS metric, coalesce(u.device, v.device) AS device, round(a, 6) AS a, round(b, 6) AS b, CASE WHEN a IS NULL OR b IS NULL THEN 'missing' WHEN abs(a - b) <= 0.1 * greatest(abs(a), abs(b)) THEN 'agree' ELSE 'differ' END AS verdict FROM u FULL JOIN v ON u.metric = v.metric AND u.device = v.device""")
def compare_sources(spark, sf):
    d, sh = daily(spark, sf), shipped(spark, sf)
    of = lambda df, name, c, out: df.groupBy("device").agg(F.avg(c).alias(out)).select(F.lit(name).alias("metric"), "device", out)
    a = of(d, "price", "price", "a").unionByName(of(d, "n", "n", "a"))
    b = of(sh.filter("device <> 2"), "price", "quantity", "b").unionByName(of(sh, "discount", "discount", "b"))
    verdict = F.when(F.col("a").isNull() | F.col("b").isNull(), "missing").when(F.abs(F.col("a") - F.col("b")) <= 0.1 * F.greatest(F.abs("a"), F.abs("b")), "agree").otherwise("differ")
    return a.join(b, ["metric", "device"], "full").select("metric", "device", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), verdict.alias("verdict"))


@query(f"WITH {DAILY}, r AS (SELECT device, min(day) AS a, max(day) AS b FROM d GROUP BY device), p AS (SELECT device, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM r) SELECT p.device, p.day, round(d.price, 6) AS price FROM p LEFT JOIN d USING (device, day)", days="day")
def calendar_spine(spark, sf):
    d = daily(spark, sf)
    return day_spine(d, "device").join(d, ["device", "day"], "left").select("device", "day", F.round("price", 6).alias("price"))


@query(f"""WITH {SESSIONS}, k AS (SELECT *, row_number() OVER (PARTITION BY device, end_t // 86400 ORDER BY n DESC, end_t - start_t DESC, start_t) AS k FROM ss) SELECT device, end_t // 86400 AS day, start_t, end_t, n FROM k WHERE k = 1""")
def merge_by_end_day(spark, sf):
    """Of the sessions that end on a day the richest one stays, then the longest."""
    s = sessions(spark, sf).withColumn("day", F.expr("end_t DIV 86400"))
    return prioritised(s, ["device", "day"], [F.desc("n"), F.desc(F.col("end_t") - F.col("start_t")), "start_t"]).select("device", "day", "start_t", "end_t", "n")


@query(f"""WITH {STREAM}, {NEAR.replace('3600', '600')} SELECT s.device, count(*) AS n, count(c.bpm) AS matched, round(avg(abs(s.bpm - c.bpm)), 6) AS mae FROM s LEFT JOIN (SELECT * FROM c WHERE k = 1) c ON s.seq = c.seq WHERE s.kind = 'click' GROUP BY s.device""")
def ground_truth_score(spark, sf):
    """How far values are from the nearest true point within ten minutes."""
    s = stream(spark, sf)
    out = nearest(s.filter("kind = 'click'").select("device", "seq", "t", F.col("bpm").alias("own")), s.filter("kind = 'view'").select("device", "t", "bpm"), "device", "t", "bpm", 600)
    return out.groupBy("device").agg(F.count("*").alias("n"), F.count("nearest").alias("matched"), F.round(F.avg(F.abs(F.col("own") - F.col("nearest"))), 6).alias("mae"))
