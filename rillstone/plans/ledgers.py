"""Bookkeeping of ingest: revisions, window hashes, staged parts, quotas, gaps, owed work, links, patches, logs."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text
from ..operators.joins import prioritised
from ..operators.windows import by, ranged
from .aggregates import R
from .bindings import DAILY, SESSIONS, STREAM, daily, sessions, stream, table


@query(f"WITH {STREAM}, r AS (SELECT device, t // 86400 AS day, count(*) || ':' || max(seq) AS revision, count(*) FILTER (kind <> 'error') || ':' || max(seq) FILTER (kind <> 'error') AS scored FROM s GROUP BY ALL) SELECT device, day, revision, revision <> scored OR scored IS NULL AS due FROM r")
def rescore_due(spark, sf):
    """Days whose revision differs from the one that was scored."""
    s, ok = stream(spark, sf), F.col("kind") != "error"
    r = s.groupBy("device", F.expr("t DIV 86400").alias("day")).agg(F.concat_ws(":", F.count("*"), F.max("seq")).alias("revision"), F.concat(F.count_if(ok), F.lit(":"), F.max(F.when(ok, F.col("seq")))).alias("scored"))
    return r.select("device", "day", "revision", ((F.col("revision") != F.col("scored")) | F.col("scored").isNull()).alias("due"))


@query(f"WITH {STREAM} SELECT device, t // 86400 AS day, count(*) AS n, md5(string_agg(seq || '=' || kind, ';' ORDER BY seq)) AS digest FROM s GROUP BY ALL")
def window_hash(spark, sf):
    """A digest of a day's rows in order: equal digests need no push."""
    g = stream(spark, sf).groupBy("device", F.expr("t DIV 86400").alias("day")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("seq", "kind"))).alias("a"))
    return g.select("device", "day", "n", F.md5(F.array_join(F.transform("a", lambda x: F.concat_ws("=", x["seq"], x["kind"])), ";")).alias("digest"))


@query("""WITH p AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS parts, max(l_linenumber) AS wanted, round(sum(l_quantity), 4) AS quantity FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, parts, wanted, CASE WHEN parts = wanted THEN quantity END AS swapped FROM p""")
def staged_replacement(spark, sf):
    """Parts wait until all are there; only then does the replacement take effect."""
    p = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_linenumber").alias("parts"), F.max("l_linenumber").alias("wanted"), R(F.sum("l_quantity"), 4).alias("quantity"))
    return p.select("l_orderkey", "parts", "wanted", F.when(F.col("parts") == F.col("wanted"), F.col("quantity")).alias("swapped"))


@query(f"WITH {STREAM}, q AS (SELECT *, count(*) OVER (PARTITION BY device ORDER BY t RANGE BETWEEN 14400 PRECEDING AND CURRENT ROW) AS batches, sum(length(props) * 100) OVER (PARTITION BY device ORDER BY t RANGE BETWEEN 14400 PRECEDING AND CURRENT ROW) AS bytes FROM s) SELECT device, count(*) AS n, count(*) FILTER (batches > 10) AS over_batches, count(*) FILTER (bytes > 8000) AS over_bytes FROM q GROUP BY device")
def ingest_quota(spark, sf):
    q = ranged(stream(spark, sf).select("device", "t", (F.length("props") * 100).alias("bytes")), "device", "t", 14400, 0, row=F.lit(1), size=F.col("bytes"))
    q = q.select("device", F.col("row_n").alias("batches"), F.col("size_sum").alias("bytes"))
    return q.groupBy("device").agg(F.count("*").alias("n"), F.count_if(F.col("batches") > 10).alias("over_batches"), F.count_if(F.col("bytes") > 8000).alias("over_bytes"))


@query(f"WITH {STREAM}, g AS (SELECT device, kind, t AS opened, lead(t) OVER (PARTITION BY device, kind ORDER BY t, seq) AS resolved FROM s) SELECT device, kind, opened, resolved, resolved - opened AS seconds FROM g WHERE resolved - opened > 43200")
def ingest_gaps(spark, sf):
    w = W.partitionBy("device", "kind").orderBy("t", "seq")
    g = stream(spark, sf).select("device", "kind", F.col("t").alias("opened"), F.lead("t").over(w).alias("resolved"))
    return g.withColumn("seconds", F.col("resolved") - F.col("opened")).filter("seconds > 43200")


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus, CAST(o_orderdate AS DATE) AS day, CASE o_orderstatus WHEN 'F' THEN 30 WHEN 'O' THEN 365 ELSE 90 END AS keep FROM orders) SELECT o_orderstatus, count(*) AS n, count(*) FILTER (day + CAST(keep AS INTEGER) < DATE '2001-01-01') AS expired FROM o GROUP BY 1""")
def retention_sweep(spark, sf):
    """What each class's time to live lets go on a day."""
    s = F.col("o_orderstatus")
    o = table(spark, sf, "orders").select(s, F.to_date("o_orderdate").alias("day"), F.when(s == "F", 30).when(s == "O", 365).otherwise(90).alias("keep"))
    return o.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if(F.expr("date_add(day, keep)") < F.lit("2001-01-01").cast("date")).alias("expired"))


@query("""SELECT coalesce(c_custkey, o_custkey) AS key, c_custkey IS NOT NULL AS listed, o_custkey IS NOT NULL AS stored FROM customer FULL JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '2-HIGH') o ON c_custkey = o_custkey WHERE c_custkey IS NULL OR o_custkey IS NULL""")
def reconcile_manifest(spark, sf):
    """Listed but not stored, or stored but not listed."""
    listed = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.lit(True).alias("listed"))
    stored = table(spark, sf, "orders").filter("o_orderpriority = '2-HIGH'").select(F.col("o_custkey").alias("key"), F.lit(True).alias("stored")).distinct()
    return listed.join(stored, "key", "full").filter("listed IS NULL OR stored IS NULL").select("key", F.coalesce("listed", F.lit(False)).alias("listed"), F.coalesce("stored", F.lit(False)).alias("stored"))


@query(f"""WITH {STREAM}, j AS (SELECT device, t // 21600 AS job, count(*) AS tries, max(CASE WHEN kind = 'purchase' THEN 1 ELSE 0 END) AS done, max(t) AS last_try FROM s WHERE kind IN ('error', 'purchase') GROUP BY ALL) SELECT device, job, tries, done = 0 AND tries < 3 AS owed, last_try + CAST(60 * power(2, least(tries, 6)) AS BIGINT) AS next_try FROM j""")
def owed_jobs(spark, sf):
    """Work that is not done is owed until three tries, each later than the one before."""
    s = stream(spark, sf).filter(F.col("kind").isin("error", "purchase"))
    j = s.groupBy("device", F.expr("t DIV 21600").alias("job")).agg(F.count("*").alias("tries"), F.max(F.when(F.col("kind") == "purchase", 1).otherwise(0)).alias("done"), F.max("t").alias("last_try"))
    return j.select("device", "job", "tries", ((F.col("done") == 0) & (F.col("tries") < 3)).alias("owed"), (F.col("last_try") + (60 * F.pow(F.lit(2), F.least("tries", F.lit(6)))).cast("long")).alias("next_try"))


@query("""WITH r AS (SELECT l_orderkey AS own, l_partkey % 500 AS external, row_number() OVER (PARTITION BY l_partkey % 500 ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity) AS k FROM lineitem) SELECT external, own FROM r WHERE k = 1""")
def external_links(spark, sf):
    """The first owner of an outside id keeps it; later claims are conflicts and change nothing."""
    rows = table(spark, sf, "lineitem").withColumn("external", F.col("l_partkey") % 500)
    return prioritised(rows, ["external"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"]).select("external", F.col("l_orderkey").alias("own"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, event_type AS extra FROM events WHERE event_type <> 'error'")
def merge_patch(spark, sf):
    """A JSON document with a patch laid over it: new keys are added, nulls remove."""
    e = table(spark, sf, "events").filter("event_type <> 'error'")
    old = F.from_json("props", "map<string,string>")
    new = F.create_map(F.lit("extra"), F.col("event_type"), F.lit("gone"), F.lit(None).cast("string"))
    keep = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k))
    merged = F.map_filter(F.map_concat(keep, new), lambda k, v: v.isNotNull())
    m = e.select("event_id", F.to_json(merged).alias("doc"))
    return m.select("event_id", F.get_json_object("doc", "$.k").cast("long").alias("k"), F.get_json_object("doc", "$.extra").alias("extra"))


@query(f"WITH {STREAM}, l AS (SELECT device, t // 86400 AS day, kind FROM s) SELECT device, count(DISTINCT day) AS days, count(*) AS lines, count(*) FILTER (kind = 'error') AS errors, count(DISTINCT kind) AS tokens FROM l GROUP BY device")
def log_accounting(spark, sf):
    """Distinct days and tokens named in report lines, read back out of their text."""
    line = F.concat(F.lit("report day="), F.expr("t DIV 86400"), F.lit(" token="), F.col("kind"))
    rows = stream(spark, sf).select("device", line.alias("line")).select("device", text.field_of(F.col("line"), "day").alias("day"), text.field_of(F.col("line"), "token").alias("token"))
    return rows.groupBy("device").agg(F.count_distinct("day").alias("days"), F.count("*").alias("lines"), F.count_if(F.col("token") == "error").alias("errors"), F.count_distinct("token").alias("tokens"))


@query("SELECT p_partkey, k AS cycle, p_size * k * 2 AS inhale_at, p_size * k * 2 + p_size AS exhale_at FROM part, (SELECT unnest(range(3)) AS k)")
def breath_schedule(spark, sf):
    """Stages of a protocol as timed cues."""
    p = table(spark, sf, "part").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("cycle"))
    start = F.col("p_size") * F.col("cycle") * 2
    return p.select("p_partkey", "cycle", start.alias("inhale_at"), (start + F.col("p_size")).alias("exhale_at"))


@query(f"WITH {STREAM}, d AS (SELECT device, seq, CAST(round(value) AS BIGINT) - 50 AS drift FROM s) SELECT device, seq, drift, CASE WHEN abs(drift) <= 2 THEN 'in step' WHEN abs(drift) <= 120 THEN 'drifting' ELSE 'wrong' END AS verdict FROM d")
def clock_verdicts(spark, sf):
    drift = F.round("value").cast("long") - 50
    return stream(spark, sf).select("device", "seq", drift.alias("drift"), F.when(F.abs(drift) <= 2, "in step").when(F.abs(drift) <= 120, "drifting").otherwise("wrong").alias("verdict"))


@query(f"WITH {DAILY}, w AS (SELECT device, day, least(5000, sum(n) OVER (PARTITION BY device ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) * 250) AS week_ml FROM d) SELECT device, day, CAST(week_ml AS BIGINT) AS week_ml FROM w", days="day")
def intake_totals(spark, sf):
    d = daily(spark, sf).withColumn("k", F.datediff("day", F.lit("1995-01-01").cast("date")))
    w = W.partitionBy("device").orderBy("k").rangeBetween(-6, 0)
    return d.select("device", "day", F.least(F.lit(5000), F.sum("n").over(w) * 250).cast("long").alias("week_ml"))


@query(f"WITH {SESSIONS}, e AS (SELECT *, start_t + 600 AS a, end_t + 90000 AS b FROM ss) SELECT device, start_t, a AS new_start, least(b, a + 86400) AS new_end, greatest(0, least(end_t, least(b, a + 86400)) - greatest(start_t, a)) AS kept FROM e")
def clipped_edit(spark, sf):
    """An edited window is held to a day, and what lay in the old one is clipped to it."""
    a, b = F.col("start_t") + 600, F.least(F.col("end_t") + 90000, F.col("start_t") + 600 + 86400)
    return sessions(spark, sf).select("device", "start_t", a.alias("new_start"), b.alias("new_end"), F.greatest(F.lit(0), F.least(F.col("end_t"), b) - F.greatest(F.col("start_t"), a)).alias("kept"))


@query(f"WITH {STREAM}, p AS (SELECT device, kind, t // 86400 AS phase, count(*) AS n, avg(value) AS m, stddev_samp(value) AS sd FROM s GROUP BY ALL) SELECT device, kind, phase, n, round(m, 6) AS mean, round(sd / nullif(m, 0), 6) AS variation, string_split(kind, 'i')[1] AS channel FROM p")
def phase_summaries(spark, sf):
    p = stream(spark, sf).groupBy("device", "kind", F.expr("t DIV 86400").alias("phase")).agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"))
    return p.select("device", "kind", "phase", "n", R("m").alias("mean"), R(F.col("sd") / F.nullif("m", F.lit(0.0))).alias("variation"), F.split("kind", "i")[0].alias("channel"))
