"""Corpora: files, commits, tree entries and blobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaksieve.errors import EmptyCatalog
from leaksieve.functions.dates import commit_date_text
from leaksieve.functions.text import lossy_utf8
from leaksieve.operators.layout import join_on_skewed_key
from leaksieve.sources import worktree
from leaksieve.sources.catalog import RuleSet, parse_catalog


def snapshot_files(entries: DataFrame, blobs: DataFrame) -> DataFrame:
    """L1: (repo, commit, path, content) of every blob in every tree.

    A scan does not need this: it reads each blob once and joins the matches
    back (``plans.scan.scan_history``).
    """
    return join_on_skewed_key(
        entries.select("repo", "commit", "path", "blob_id"),
        blobs.select("blob_id", "content"),
        "blob_id",
    ).select("repo", "commit", "path", "content")


def commit_metadata(commits: DataFrame, fix_offset: bool = False) -> DataFrame:
    """L2: id, author, email, message (missing ones empty), date text and repo."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return commits.select(
        "repo",
        "commit",
        text("author"),
        text("email"),
        text("commit_message"),
        commit_date_text("commit_ts", "offset_minutes", fix_offset).alias("date"),
    )


def decoded_blobs(blobs: DataFrame) -> DataFrame:
    """L3: blobs with binary content, decoded; bad bytes become U+FFFD."""
    return blobs.select("blob_id", lossy_utf8("content").alias("content"))


def blobs_from_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files with blob_id, distinct blobs) for a corpus without a blob table."""
    keyed = files.withColumn("blob_id", F.sha2(F.col("content"), 256))
    blobs = keyed.groupBy("blob_id").agg(F.any_value("content").alias("content"))
    return keyed.drop("content"), blobs


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """L4: (path, content) of all files below ``folder``, as bytes; paths are relative.

    Folders of version-control metadata are not files of the tree.
    """
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    prefix = fs.makeQualified(root).toString().rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    relative = F.substring(F.col("path"), F.lit(len(prefix) + 1), F.length("path"))
    return raw.select(F.regexp_replace(relative, "^/+", "").alias("path"), "content").filter(
        ~F.rlike("path", F.lit(r"(^|/)\.git(/|\z)"))
    )


def decode_files(files: DataFrame, on_invalid: str = "fail") -> DataFrame:
    """L4: (path, content) with text for bytes.

    ``on_invalid``: a file that is not UTF-8 fails the scan (``fail``), is decoded with
    U+FFFD (``replace``) or is decoded so and marked in ``valid`` (``flag``).
    """
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    text = lossy_utf8("content")
    if on_invalid == "fail":
        text = F.when(valid, text).otherwise(
            F.raise_error(F.concat(F.lit("not UTF-8: "), F.col("path")))
        )
    out = files.select("path", text.alias("content"), valid.alias("valid"))
    return out if on_invalid == "flag" else out.drop("valid")


def working_tree(
    spark: SparkSession,
    folder: str,
    on_invalid: str = "fail",
    head: DataFrame | None = None,
    staged: DataFrame | None = None,
    on_deleted: str = "fail",
) -> DataFrame:
    """L4: (path, content) of the files below ``folder``, ready for a scan.

    With ``head``, the entries (path, blob_id) of HEAD's tree, only of those that were
    changed since or are not tracked; see ``worktree.uncommitted``.
    """
    files = list_files(spark, folder)
    if head is not None:
        files = worktree.uncommitted(head, files, staged, on_deleted)
    return decode_files(files, on_invalid)


def config_from_corpus(
    commits: DataFrame, entries: DataFrame, blobs: DataFrame, names: Sequence[str]
) -> DataFrame:
    """For each repository that has one, the catalogue nearest to its HEAD:
    (repo, commit, path, content).

    ``names`` are the file names that count as a catalogue in a root folder. ``pos`` is
    a commit's place in its own repository; of files at one place the first path counts.
    """
    roots = entries.filter(F.col("path").isin([f"/{n}" for n in names]))
    first = (
        roots.join(commits.select("repo", "commit", "pos"), ["repo", "commit"])
        .groupBy("repo")
        .agg(
            F.min_by(F.struct("commit", "path", "blob_id"), F.struct("pos", "path", "commit")).alias("at")
        )
        .select("repo", "at.*")
    )
    return first.join(blobs, "blob_id").select("repo", "commit", "path", "content")


def rules_from_corpus(
    commits: DataFrame,
    entries: DataFrame,
    blobs: DataFrame,
    names: Sequence[str],
    repo: str | None = None,
) -> RuleSet:
    """L7 followed by L5, for ``repo``; without it there must be one repository only."""
    if repo is not None:
        commits = commits.filter(F.col("repo") == repo)
    rows = config_from_corpus(commits, entries, blobs, names).take(2)
    if not rows:
        raise EmptyCatalog("no catalogue in the corpus")
    if len(rows) > 1:
        raise ValueError("several repositories have a catalogue: name one")
    return parse_catalog(rows[0]["content"])


def commit_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a file, in the column ``value``."""
    return spark.read.option("lineSep", "\n").text(path)


def object_ids(commits: DataFrame, entries: DataFrame, blobs: DataFrame) -> DataFrame:
    """Every object id of the store, once."""
    return (
        commits.select(F.col("commit").alias("object_id"))
        .unionByName(entries.select(F.col("blob_id").alias("object_id")))
        .unionByName(blobs.select(F.col("blob_id").alias("object_id")))
        .distinct()
    )
