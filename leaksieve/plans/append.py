"""Append leaks to a table folder once, with ids that no other run has.

A run stages its rows, reserves a block of ids for them and publishes them by renaming its
folder to ``run=<run id>``, which readers see whole or not at all. A run that is already
there changes nothing, so a failed or repeated job may be started again.
"""

from __future__ import annotations

import re
import time
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leaksieve.schema import LEAK_COLUMNS

SCHEMA = "id long, " + ", ".join(
    f"{c} {'int' if c == 'line_number' else 'string'}" for c in LEAK_COLUMNS
)
_RUN_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


class _Folder:
    """A folder in any file system that Spark can write to."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self.path = path.rstrip("/")
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path(f"{self.path}/{name}")

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def names(self, name: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._at(name))] if self.exists(name) else []

    def create(self, name: str, text: str) -> bool:
        """Make a file; False if there is one already. Of two writers one succeeds."""
        try:
            out = self._fs.create(self._at(name), False)
        except Exception as e:  # a Java exception: the file exists, or the error is real
            if self.exists(name):
                return False
            raise e
        out.write(text.encode())
        out.close()
        return True

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, staged: str, name: str) -> bool:
        """Rename a folder; False if the name is taken."""
        return not self.exists(name) and bool(self._fs.rename(self._at(staged), self._at(name)))

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


def _reserve(folder: _Folder, n: int, run_id: str) -> int:
    """First of ``n`` ids for this run. Reservations are numbered files ``first:n:run``; the
    next one begins where the last one ends, and two writers cannot make the same file."""
    while True:
        taken = sorted(int(k) for k in folder.names("_ids") if k.isdigit())
        first = 1
        if taken:
            while not (line := folder.read(f"_ids/{taken[-1]:012}")):  # made, not yet written
                time.sleep(0.05)
            last, size, _ = line.split(":", 2)
            first = int(last) + int(size)
        if folder.create(f"_ids/{taken[-1] + 1 if taken else 0:012}", f"{first}:{n}:{run_id}"):
            return first


def append_once(leaks: DataFrame, path: str, run_id: str) -> bool:
    """Append ``leaks`` under ``run_id``; False if that run is already there.

    Jobs of different runs may write at the same time; of one run id, one job at a time. Ids of a run are consecutive. Those of a run that failed after its reservation are
    not used again. Rows are numbered by the places of the staged parts, not in one task.
    """
    if not _RUN_ID.fullmatch(run_id):
        raise ValueError(f"run id {run_id!r}: letters, digits, dots, dashes and underscores only")
    spark = leaks.sparkSession
    folder = _Folder(spark, path)
    if folder.exists(f"run={run_id}"):
        return False
    mine = f"_staging/{run_id}-{uuid4().hex}"
    try:
        rows = f"{folder.path}/{mine}/rows"
        numbered = leaks.select(
            *LEAK_COLUMNS, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")
        )
        numbered.write.parquet(rows)
        staged = spark.read.schema(numbered.schema).parquet(rows)
        # Within a partition ids rise one by one from its number times 2 ** 33.
        parts = staged.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        starts = parts.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
        first = _reserve(folder, staged.count(), run_id)
        inside = F.col("_at").bitwiseAND((1 << 33) - 1)
        staged.join(starts, "_part").select(
            (F.col("start") + inside + first).cast("long").alias("id"), *LEAK_COLUMNS
        ).write.parquet(f"{folder.path}/{mine}/table")
        return folder.publish(f"{mine}/table", f"run={run_id}")
    finally:
        folder.remove(mine)


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    """(id, the leak columns, run) of all published runs."""
    return spark.read.schema(f"{SCHEMA}, run string").option("basePath", path).parquet(path)
