"""Scan of files as they arrive. It keeps no state: each file is looked at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from leaksieve.functions.text import lossy_utf8
from leaksieve.operators.detect import DEFAULT, DetectOptions
from leaksieve.plans.scan import scan_files
from leaksieve.sources.catalog import RuleSet

_BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def arriving_files(spark: SparkSession, folder: str, files_per_batch: int = 10_000) -> DataFrame:
    """A stream of (path, content) for the files that turn up in ``folder``."""
    return (
        spark.readStream.format("binaryFile")
        .schema(_BINARY_FILE)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
        .select("path", lossy_utf8("content").alias("content"))
    )


def scan_stream(
    files: DataFrame, rules: RuleSet, options: DetectOptions = DEFAULT
) -> DataFrame:
    """Leaks of a stream of (path, content)."""
    return scan_files(files, rules, options)


def write_stream(
    leaks: DataFrame, path: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Append leaks to a parquet folder, exactly once per file."""
    writer = (
        leaks.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()
