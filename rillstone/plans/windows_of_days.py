"""Windows of days over a stored stream, and nights that are staged again after an edit of their bounds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import query
from ..operators.healing import heal, read_stages
from ..operators.sliding import SlidingReader
from ..operators.windows import islands
from ..session import shared_folder, stored
from .aggregates import R
from .bindings import GAP, SESSIONS, STREAM, stream

#: First and last days of the windows, from the stream's first day on: two slides, one inside, a gap.
SLIDES = ((0, 6), (2, 8), (3, 7), (3, 9), (20, 26))


@query(f"""WITH {STREAM}, z AS (SELECT min(t) // 86400 AS d0 FROM s), w AS (SELECT unnest({[list(x) for x in SLIDES]}) AS w)
SELECT w[1] AS first, w[2] AS last, device, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, min(value) AS low, max(value) AS high FROM s, z, w WHERE t // 86400 - d0 BETWEEN w[1] AND w[2] GROUP BY ALL""")
def sliding_reader(spark, sf):
    """Statistics by device of windows that slide; each slide reads only the days that it adds."""
    path, kept = shared_folder(spark, "stream_days"), shared_folder(spark, "kept")
    s = stream(spark, sf).select("device", "value", F.expr("t DIV 86400").alias("day"))
    s.write.partitionBy("day").parquet(path)
    begin = s.agg(F.min("day")).first()[0] or 0
    reader = SlidingReader(spark, lambda: spark.read.schema("device long, value double, day long").parquet(path), kept, "device", "day", "value")
    out = []
    for a, b in SLIDES:
        window = reader.window(begin + a, begin + b).select(F.lit(a).cast("long").alias("first"), F.lit(b).cast("long").alias("last"), "device", "n", R("mean").alias("mean"), R("sd").alias("sd"), "low", "high")
        out.append(stored(window))  # later slides drop days that this one has read
    return reduce(DataFrame.unionByName, out)


def _staged(rows: DataFrame) -> DataFrame:
    """A row is awake where its rate is above the mean of its session."""
    mean = rows.groupBy("key", "id").agg(F.avg("bpm").alias("mean"))
    return rows.join(mean, ["key", "id"]).withColumn("label", F.when(F.col("bpm") > F.col("mean") + 1e-9, "awake").otherwise("asleep"))


@query(f"""WITH {SESSIONS}, o AS (SELECT i.device, i.t, i.seq, i.bpm, ss.start_t, ss.end_t FROM i JOIN ss ON ss.device = i.device AND i.t BETWEEN ss.start_t AND ss.end_t),
e AS (SELECT device, start_t, end_t, start_t + 1800 AS s1, end_t + 7200 AS e1 FROM ss WHERE start_t % 3 = 0),
r AS (SELECT e.*, s.t, s.bpm FROM s JOIN e ON e.device = s.device AND s.t BETWEEN s1 AND e1),
d AS (SELECT device, start_t, avg(bpm) AS mean FROM r GROUP BY ALL HAVING count(*) >= greatest(5, (max(e1) - max(s1)) // 7200))
SELECT device, start_t AS id, t, 'old' AS label FROM o ANTI JOIN d USING (device, start_t) UNION ALL
SELECT r.device, r.start_t, r.t, CASE WHEN bpm > mean + 1e-9 THEN 'awake' ELSE 'asleep' END FROM r JOIN d USING (device, start_t)""")
def healed_stages(spark, sf):
    """Every third session has new bounds; those with enough rows between them are staged again, the others stay."""
    path, stages = shared_folder(spark, "raw"), shared_folder(spark, "stages")
    s = stream(spark, sf)
    day = F.expr("t DIV 86400").alias("day")
    s.select(F.col("device").alias("key"), "t", "bpm", day).write.partitionBy("day").parquet(path)
    runs = islands(s, "device", ["t", "seq"], "t", GAP)
    ends = runs.groupBy("device", "island").agg(F.min("t").alias("id"), F.max("t").alias("end_t"))
    runs.join(ends, ["device", "island"]).select(F.col("device").alias("key"), "id", "t", F.lit("old").alias("label"), day).write.partitionBy("day").parquet(stages)
    edited = ends.filter("id % 3 = 0").select(F.col("device").alias("key"), "id", F.col("id").alias("old_start"), F.col("end_t").alias("old_end"), (F.col("id") + 1800).alias("start_t"), (F.col("end_t") + 7200).alias("end_t"))
    heal(edited, spark.read.schema("key long, t long, bpm double, day long").parquet(path), stages, _staged, 5, 7200)
    return read_stages(spark, stages).select(F.col("key").alias("device"), "id", "t", "label")
