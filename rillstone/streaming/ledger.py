"""Batches accepted exactly once, by one atomic rename that several drivers may race for.

A writer puts a batch in an attempt folder of its own, with the rows' digest beside them, and then renames the folder to
the batch's place. The rename is the claim and the commit at once: readers see the rows whole or not at all, and nothing
else marks a batch. Whoever finds the place taken compares digests: equal content is ``repeated``, other content under the
same number a ``conflict``. A rename that meets a taken place may put the folder inside it instead of failing; its name
begins with an underscore, so readers pass over it, and the writer, who sees another's attempt in the digest file, removes
it. A crash before the rename leaves only an attempt folder, for ``sweep``; a crash after it leaves a batch that is there.

The file system must rename folders atomically (a distributed file system or a local disk; an object store does not).
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "_digest.json"


class Ledger:
    """Accepts each batch once: equal content again is a no-op, other content under the same number is a conflict."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.files = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _place(self, batch_id: int) -> str:
        return f"{self.folder}/rows/batch_id={batch_id}"

    def _read(self, folder: str) -> dict | None:
        """The digest file of a folder; None if the folder is not there."""
        path = self._path(f"{folder}/{MARK}")
        if not self.files.exists(path):
            return None
        stream = self.files.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _write(self, folder: str, mark: dict) -> None:
        out = self.files.create(self._path(f"{folder}/{MARK}"), True)
        out.write(bytearray(json.dumps(mark).encode()))
        out.close()

    def accept(self, batch: DataFrame, batch_id: int) -> str:
        """``accepted``, ``repeated`` or ``conflict``."""
        attempt = f"_attempt-{uuid.uuid4().hex}"
        staged = f"{self.folder}/staging/{attempt}"
        batch.write.parquet(staged)
        rows = self.spark.read.schema(batch.schema).parquet(staged)
        digest = rows.select(F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).alias("h"), F.count("*").alias("n")).first()
        mark = {"digest": f"{digest['n']}:{digest['h']}", "attempt": attempt}
        self._write(staged, mark)
        place = self._place(batch_id)
        if self._read(place) is None:
            self._commit(staged, place)
        there = self._read(place)
        if there is None:
            raise OSError(f"batch {batch_id} could not be put in its place")
        if there["attempt"] == attempt:
            return "accepted"
        for left in (staged, f"{place}/{attempt}"):
            self.files.delete(self._path(left), True)
        return "repeated" if there["digest"] == mark["digest"] else "conflict"

    def _commit(self, staged: str, place: str) -> None:
        self.files.mkdirs(self._path(f"{self.folder}/rows"))
        self.files.rename(self._path(staged), self._path(place))

    def sink(self, told: Callable[[int, str], None] | None = None) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``; ``told`` hears the outcome of each batch, and a conflict raises."""

        def take(batch: DataFrame, batch_id: int) -> None:
            outcome = self.accept(batch, batch_id)
            if told:
                told(batch_id, outcome)
            if outcome == "conflict":
                raise ValueError(f"batch {batch_id} was accepted before with other content")

        return take

    def rows(self, schema) -> DataFrame:
        """The rows of all accepted batches, with batch_id."""
        if not self.files.exists(self._path(f"{self.folder}/rows")):
            return self.spark.createDataFrame([], schema).withColumn("batch_id", F.lit(None).cast("long"))
        return self.spark.read.schema(self.spark.createDataFrame([], schema).withColumn("batch_id", F.lit(0).cast("long")).schema).parquet(f"{self.folder}/rows")

    def sweep(self, older: float = 86_400.0) -> int:
        """Remove attempts that nobody has finished for ``older`` seconds; how many."""
        staging = self._path(f"{self.folder}/staging")
        if not self.files.exists(staging):
            return 0
        old = [s for s in self.files.listStatus(staging) if s.getModificationTime() / 1000 <= time.time() - older]
        return sum(bool(self.files.delete(s.getPath(), True)) for s in old)
