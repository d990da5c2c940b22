"""D1-D7, D11 on files that are larger than a task: in chunks that end at line breaks.

A file is its chunks (path, seq, content) one after the other, in the order of ``seq``; all
but the last end with a line break. A chunk is searched where it was read. What a file decides as a whole is put together
from narrow rows: the rules that it calls are those that any of its chunks calls, and the
number of a line is its number in the chunk plus the lines of all chunks before it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaksieve.functions.text import lossy_utf8
from leaksieve.operators.detect import (
    DEFAULT,
    DetectOptions,
    bounded_batches,
    drop_allowed_files,
    keep_rule_paths,
    match_candidates,
    rules_called_by,
)
from leaksieve.operators.layout import join_on_skewed_key, running_totals, stored
from leaksieve.plans.scan import leaks_of_files
from leaksieve.sources.catalog import RuleSet

CHUNK_BYTES = 1 << 20


def read_chunks(spark: SparkSession, paths: str | list[str], chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(path, seq, content) of text files of any size; a file is read by many tasks.

    Lines are read split by split, and those of a split are put into chunks of about
    ``chunk_bytes``. ``seq`` is (place of the split in the file, chunk within it). A chunk
    holds one line at least, so only a line that is longer than that makes a longer chunk.
    Bytes that are not UTF-8 become U+FFFD. An empty file has no chunks. Each chunk gets a
    line break at its end: a CR that is the very last byte of a file counts as part of one.
    """
    lines = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"),
    )

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        of, seq, held, size = None, 0, [], 0

        def chunk():
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([of[0]]), pa.array([of[1]], pa.int64()), pa.array([seq], pa.int64()),
                    pa.array([b"\n".join(held) + b"\n"], pa.binary()),
                ],
                names=["path", "block", "part", "content"],
            )

        for batch in batches:
            for path, block, value in zip(*(c.to_pylist() for c in batch.columns)):
                if of != (path, block) or size >= chunk_bytes:
                    if held:
                        yield chunk()
                    seq = seq + 1 if of == (path, block) else 0
                    of, held, size = (path, block), [], 0
                held.append(value)
                size += len(value) + 1
        if held:
            yield chunk()

    cut = lines.mapInArrow(run, "path string, block long, part long, content binary")
    return cut.select("path", F.struct("block", "part").alias("seq"), lossy_utf8("content").alias("content"))


def chunk_table(
    chunks: DataFrame, rules: RuleSet, options: DetectOptions = DEFAULT
) -> DataFrame:
    """(path, seq, before, rules_called) of each chunk, stored: the number of lines before
    it in its file, and the rules that it calls."""
    if any("\n" in k for r in rules.rules for k in r.keywords):
        raise ValueError("a keyword with a line break may lie across two chunks")
    breaks = F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit("")))
    bounded_batches(chunks.sparkSession)
    called = rules_called_by(F.col("content"), rules, options)
    rows = chunks.filter("content IS NOT NULL").select(
        "path", "seq", breaks.cast("long").alias("breaks"), called.alias("rules_called")
    )
    return stored(running_totals(rows, "path", ["seq"], "breaks", "before").drop("breaks"))


def scan_chunks(
    chunks: DataFrame, rules: RuleSet, options: DetectOptions = DEFAULT
) -> DataFrame:
    """D11 on (path, seq, content): the leaks that a scan of the whole files would give.

    ``chunks`` is read twice, for keywords and line breaks and then for matches. Texts move
    only if the files that call a rule are too many to be sent to the tasks; a file that
    holds most chunks is then split. Matches meet their chunk's place by (path, ``seq``),
    which must be the same in both readings: a chunk without a place fails the query.
    Chunks without content count for nothing.
    """
    known = chunk_table(chunks, rules, options)
    of_file = known.select("path", F.explode("rules_called").alias("rule")).distinct()
    of_file = stored(
        of_file.groupBy("path").agg(F.array_sort(F.collect_set("rule")).alias("rules_called"))
    )
    texts = chunks.filter("content IS NOT NULL").select("path", "seq", "content")
    called = join_on_skewed_key(texts, of_file, "path", ("seq",))
    found = match_candidates(called, rules, "content", options)
    missing = F.raise_error(F.concat(F.lit("another chunk in the second reading: "), F.col("path")))
    found = found.join(known.select("path", "seq", "before"), ["path", "seq"], "left").withColumn(
        "line_number", F.coalesce("before", missing.cast("long")) + F.col("line_number")
    )
    if options.rule_paths:
        found = keep_rule_paths(found, rules, F.col("path"))
    found = drop_allowed_files(found, rules, F.col("path"), F.lit(""))
    return leaks_of_files(found, rules, options)


def scan_large_files(
    spark: SparkSession,
    paths: str | list[str],
    rules: RuleSet,
    options: DetectOptions = DEFAULT,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """D11 on text files of any size; ``file`` in the leaks is the file's full path."""
    return scan_chunks(read_chunks(spark, paths, chunk_bytes), rules, options)
