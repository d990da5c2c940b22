"""L4: what of a working tree is not committed, by content.

A file's id in the store is a hash of its bytes, so a listing of files is compared with
HEAD's tree by ids alone, in one shuffle of (path, id); only files that differ are read
as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blob_object_id(content: Column | str) -> Column:
    """The id that a store of objects gives to a file: SHA-1 of a header and the bytes."""
    c = (F.col(content) if isinstance(content, str) else content).cast("binary")
    size = F.octet_length(c).cast("string")
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), size, F.lit("\0")), "UTF-8"), c))


def _tree(entries: DataFrame, name: str) -> DataFrame:
    """(path, name) of a tree's files; paths as in a listing, without the first slash."""
    if "kind" in entries.columns:
        entries = entries.filter("kind IS DISTINCT FROM 'commit'")
    return entries.select(F.regexp_replace("path", r"\A/", "").alias("path"), F.col("blob_id").alias(name))


def outside_submodules(files: DataFrame, entries: DataFrame) -> DataFrame:
    """The files that lie in no folder that ``entries`` has as a submodule.

    Entries of submodules have the ``kind`` ``commit``; a table without that column has
    none. A file's folders are looked up by equality.
    """
    if "kind" not in entries.columns:
        return files
    folders = entries.filter("kind = 'commit'").select(
        F.regexp_replace("path", r"\A/", "").alias("folder")
    ).distinct()
    parts = F.split("path", "/")
    above = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")
    )
    inside = files.select("path", F.explode(above).alias("folder")).join(folders, "folder", "left_semi")
    return files.join(inside.select("path").distinct(), "path", "left_anti").select(*files.columns)


def status(
    head: DataFrame, files: DataFrame, staged: DataFrame | None = None
) -> DataFrame:
    """(path, state, head_id, staged_id, work_id) of each path that is not as in HEAD.

    ``head`` and ``staged`` (the index; as HEAD if not given) have (path, blob_id) and may
    have ``kind``, ``files`` has (path, content). ``state`` is ``untracked`` for a file
    that neither has, ``deleted`` for one that is listed no more, ``modified`` if the
    bytes differ from the index, and ``staged`` if only the index differs from HEAD.
    Ignored files are untracked ones; submodules and what lies in them are left out. A
    path that is listed twice counts once, with either content.
    """
    none = F.lit(None).cast("string")
    sides = {"head_id": _tree(head, "head_id")}
    if staged is not None:
        sides["staged_id"] = _tree(staged, "staged_id")
    listed = outside_submodules(files.select("path", "content"), head)
    if staged is not None:
        listed = outside_submodules(listed, staged)
    sides["work_id"] = listed.select("path", blob_object_id("content").alias("work_id"))
    names = ("head_id", "staged_id", "work_id")
    rows = None
    for name, side in sides.items():
        part = side.select("path", *[F.col(n) if n == name else none.alias(n) for n in names])
        rows = part if rows is None else rows.unionByName(part)
    # One shuffle, combined before it, instead of full joins.
    paths = rows.groupBy("path").agg(*[F.max(n).alias(n) for n in names])
    if staged is None:
        paths = paths.withColumn("staged_id", F.col("head_id"))
    h, s, w = (F.col(n) for n in names)
    state = (
        F.when(w.isNull(), "deleted")
        .when(h.isNull() & s.isNull(), "untracked")
        .when(~s.eqNullSafe(w), "modified")
        .when(~h.eqNullSafe(s), "staged")
    )
    return paths.withColumn("state", state).filter("state IS NOT NULL").select("path", "state", *names)


def uncommitted(
    head: DataFrame,
    files: DataFrame,
    staged: DataFrame | None = None,
    on_deleted: str = "fail",
) -> DataFrame:
    """L4: (path, content) of the files that are not as in HEAD, as bytes.

    ``on_deleted``: a tracked file that is gone fails the query (``fail``), as reading it
    would, or is left out (``skip``).
    """
    if on_deleted not in {"fail", "skip"}:
        raise ValueError(f"on_deleted={on_deleted!r}")
    changed = status(head, files, staged).select("path", "state")
    gone = F.raise_error(F.concat(F.lit("cannot read deleted file: "), F.col("path"))).cast("boolean")
    if on_deleted == "skip":
        wanted = changed.filter("state <> 'deleted'")
        return files.join(wanted, "path", "left_semi").select("path", "content")
    found = changed.join(files.select("path", "content"), "path", "left")
    return found.filter(F.when(F.col("state") == "deleted", gone).otherwise(True)).select("path", "content")
