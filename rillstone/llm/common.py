"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import shared_folder

#: Bytes of text that a Python worker holds decoded at once; one longer text is held alone.
CHUNK_BYTES = 1 << 20
#: The six ASCII white-space characters between words; ``bytes.split()`` splits at exactly these.
WHITE = b" \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Whether the shuffle files of a query go as soon as it ends; nothing reads them once its table is written.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(df: DataFrame, tidy: bool = False) -> DataFrame:
    """Cut the lineage by writing a Parquet table to the shared folder: smaller than a checkpoint of many rows.

    With ``tidy`` the shuffle files of the write are deleted when it has ended.
    """
    spark = df.sparkSession
    path = shared_folder(spark, "table")
    before = spark.conf.get(TIDY, None)
    if tidy:
        spark.conf.set(TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        if tidy:
            spark.conf.unset(TIDY) if before is None else spark.conf.set(TIDY, before)
    return spark.read.schema(df.schema).parquet(path)


def deleted(df: DataFrame) -> None:
    """Delete the files of a table that ``table`` has written and that nothing will read again."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the folder that the session names.

    ``spark.checkpoint.dir`` is read from the session. Where it is unset a temporary folder serves a local session only.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or shared_folder(spark, "checkpoints"))
    return df.checkpoint()


def merged(df: DataFrame) -> DataFrame:
    """The rows, hinted to be joined by shuffle and merge, so that neither side of their next join is broadcast.

    Spark sizes a side by what it is made of: it counts neither the rows that an explode adds nor what Parquet's encodings
    save, so that it would gather many times its broadcast threshold in the driver.
    """
    return df.hint("merge")


def bounded(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, those with the smallest hashes of ``key``; about as many come from each partition as are needed."""
    n = df.count()
    drawn = F.xxhash64(key).bitwiseAND(F.lit((1 << 30) - 1))
    if n > most:
        df = df.filter(drawn < int((1 << 30) * min(1.0, 1.2 * most / n)))
    return df.orderBy(drawn, *df.columns).limit(most)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text each; every row is in one slice."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes + 64)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


#: Rows and bytes of whole texts that go to a Python worker at once, on both sides outside the heap; one longer text goes alone.
BATCH, BATCH_BYTES = 1000, 2 << 20


@contextmanager
def short_batches(spark: SparkSession):
    """Within it, Arrow batches have BATCH rows at most and end with the row that fills BATCH_BYTES.

    That holds for work that is done inside, not for what a query leaves to do.
    """
    rows, size = (f"spark.sql.execution.arrow.{name}" for name in ("maxRecordsPerBatch", "maxBytesPerBatch"))
    before = {name: spark.conf.get(name) for name in (rows, size)}
    spark.conf.set(rows, str(min(int(before[rows]), BATCH) if int(before[rows]) > 0 else BATCH))
    spark.conf.set(size, str(BATCH_BYTES))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def texts_of(batch: pa.RecordBatch, text: str = "text") -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    column = batch.column(text)
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return [b or b"" for b in column.to_pylist()]


def extended(schema: StructType, ddl: str) -> StructType:
    """The schema and the fields of a schema string."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])
