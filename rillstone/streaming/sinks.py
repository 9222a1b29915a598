"""Running a stream over what is available, with file sinks in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import shared_folder


def _started(writer, spark, settings: dict[str, str]):
    """Start a stream under settings of its own; it keeps those that it started with."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        return writer.start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def available(rows: DataFrame, mode: str = "append", settings: dict[str, str] | None = None) -> DataFrame:
    """What the stream gives for all input that is there now, as files in the shared folder.

    ``settings`` hold while the stream starts. Appended rows are written exactly once; in other modes each batch replaces
    the table. Nothing goes to the driver.
    """
    spark = rows.sparkSession
    folder = shared_folder(spark, "stream")
    path = f"{folder}/rows"
    writer = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    fs = lambda place: place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    if mode == "append":
        _started(writer.format("parquet").option("path", path), spark, settings or {}).awaitTermination()
        written = [path] if fs(hadoop(path)).exists(hadoop(path)) else []
    else:
        # Each batch is a folder of its own, so a crash leaves the batch before it whole; the last that is complete counts.
        _started(writer.foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(f"{path}/{k}")), spark, settings or {}).awaitTermination()
        there = fs(hadoop(path)).listStatus(hadoop(path)) if fs(hadoop(path)).exists(hadoop(path)) else []
        done = [s.getPath() for s in there if fs(s.getPath()).exists(hadoop(s.getPath(), "_SUCCESS"))]
        written = [max(done, key=lambda p: int(p.getName())).toString()] if done else []
    if not written:
        return spark.createDataFrame([], rows.schema)  # there was no input
    return spark.read.schema(rows.schema).parquet(*written)
