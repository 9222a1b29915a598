import random

import pytest
from pyspark.sql import functions as F

from rillstone.operators.healing import dense_rows, heal, read_stages
from rillstone.operators.sliding import EXTEND, FULL, SERVE, SlidingReader, planned
from rillstone.session import shared_folder


def test_plans():
    assert planned(None, 1, 7) == (FULL, 1, 7)
    assert planned((1, 7), 3, 9) == (EXTEND, 8, 9)
    assert planned((1, 7), 8, 9) == (EXTEND, 8, 9)
    assert planned((1, 7), 2, 6)[0] == SERVE
    assert planned((1, 7), 9, 12) == (FULL, 9, 12) and planned((1, 7), 0, 5) == (FULL, 0, 5)


def test_slides_equal_full_reads_and_read_new_days_only(spark):
    draw, path = random.Random(1), shared_folder(spark, "days")
    rows = [(draw.randint(0, 2), None if draw.random() < 0.1 else draw.random() * 9, d) for d in range(20) if d != 6 for _ in range(draw.randint(1, 9))]
    df = spark.createDataFrame(rows, "k long, v double, day long")
    df.write.partitionBy("day").parquet(path)
    reader = SlidingReader(spark, lambda: spark.read.schema("k long, v double, day long").parquet(path), shared_folder(spark, "kept"), "k", "day", "v")
    for a, b in ((0, 4), (2, 6), (3, 7), (3, 5), (4, 8), (12, 15), (1, 3)):
        kind, first, last = planned(reader.kept, a, b)
        got = {r["k"]: tuple(r)[1:] for r in reader.window(a, b).collect()}
        want = {r["k"]: tuple(r)[1:] for r in df.filter(F.col("day").between(a, b)).groupBy("k").agg(F.count("v"), F.avg("v"), F.stddev_samp("v"), F.min("v"), F.max("v")).collect()}
        assert got.keys() == want.keys()
        for k in want:
            near = [(a, b) for a, b in zip(got[k], want[k], strict=True) if (a, b) != (None, None)]
            assert [a for a, _ in near] == pytest.approx([b for _, b in near], rel=1e-9, abs=1e-9)
        if kind == SERVE:
            assert reader.last_read is None
        else:
            days = {int(f.split("day=")[1].split("/")[0]) for f in reader.last_read.inputFiles()}
            plan = reader.last_read._jdf.queryExecution().executedPlan().toString()
            assert "PartitionFilters: [isnotnull(day" in plan
            assert {r["day"] for r in reader.last_read.select("day").distinct().collect()} <= set(range(first, last + 1)) <= days | set(range(first, last + 1))


def decode(rows):
    return rows.withColumn("label", F.lit("new"))


def test_only_dense_edited_nights_are_read_and_replaced(spark):
    path, stages = shared_folder(spark, "raw"), shared_folder(spark, "stages")
    day = F.floor(F.col("t") / 86400).alias("day")
    raw = [(1, d * 86400 + m * 60, d) for d in range(10) for m in range(0, 600, 2)]
    spark.createDataFrame(raw, "key long, t long, day long").write.partitionBy("day").parquet(path)
    old = [(1, d, d * 86400 + m * 60, "old") for d in range(10) for m in range(0, 300, 10)]
    spark.createDataFrame(old, "key long, id long, t long, label string").select("*", day).write.partitionBy("day").parquet(stages)
    span = lambda d, a, b: (1, d, d * 86400, d * 86400 + 18_000, a, b)
    edited = spark.createDataFrame([span(3, 3 * 86400 + 600, 3 * 86400 + 12_600), span(5, 5 * 86400 + 70_000, 5 * 86400 + 80_000), span(7, 7 * 86400, 7 * 86400 - 5), span(8, 9 * 86400, 9 * 86400 + 9000)], "key long, id long, old_start long, old_end long, start_t long, end_t long")
    source = spark.read.schema("key long, t long, day long").parquet(path)
    plan = dense_rows(edited, source)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    before = {f: m for f, m in files_of(spark, stages).items()}
    assert sorted(map(tuple, heal(edited, source, stages, decode).collect())) == [(1, 3), (1, 8)]
    after = files_of(spark, stages)
    assert all(after[f] == m for f, m in before.items() if not any(f"day={d}/" in f for d in (3, 8, 9)))
    got = {(r["id"], r["label"]) for r in read_stages(spark, stages).collect()}
    assert got == {(d, "old") for d in range(10) if d not in (3, 8)} | {(3, "new"), (8, "new")}
    kept = read_stages(spark, stages)
    assert kept.filter("id = 3").count() == 101 and kept.filter("day = 9 AND label = 'old'").count() == 30
    assert kept.filter("day = 8").count() == 0


def files_of(spark, path):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {f: files.getFileStatus(hadoop(f)).getModificationTime() for f in spark.read.parquet(path).inputFiles()}
