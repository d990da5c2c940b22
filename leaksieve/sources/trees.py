"""Tree entries (L1) from stored trees, pruned (F1-F3) on the way down."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaksieve.operators.layout import join_on_skewed_key, stored
from leaksieve.operators.paths import path_pruned
from leaksieve.sources.catalog import Allowlist

MAX_DEPTH = 1000


def _node(tree: Column, prefix: Column) -> Column:
    """One value for a tree at a path; ids hold no space."""
    return F.concat(tree, F.lit(" "), prefix)


def _kind() -> Column:
    known = F.col("kind").isin("tree", "blob", "commit")
    return F.when(known, F.col("kind")).otherwise(
        F.raise_error(F.concat(F.lit("unknown kind of tree entry: "), F.coalesce("kind", F.lit("null"))))
    )


def descend(roots: DataFrame, trees: DataFrame, allow: Allowlist) -> list[tuple[DataFrame, DataFrame]]:
    """(folders, files) of each level below the distinct ``roots`` (tree_id).

    Both have ``node``, the folder that holds the entry; a folder also has ``below``, its
    own node, and a file ``path`` and ``blob_id``. A tree that many roots hold at one path
    is one node, and is looked up once. What a folder's path prunes is not looked up.
    """
    frontier = roots.select("tree_id", F.lit("").alias("prefix")).filter("tree_id IS NOT NULL").distinct()
    listing = trees.select("tree_id", "name", "kind", "child")
    levels = []
    for _ in range(MAX_DEPTH):
        path = F.concat("prefix", F.lit("/"), "name")
        found = stored(
            frontier.join(listing, "tree_id")
            .filter(~F.startswith("name", F.lit(".")))
            .select(_node(F.col("tree_id"), F.col("prefix")).alias("node"), path.alias("path"),
                    _kind().alias("kind"), "child")
            .filter(~path_pruned("path", allow.paths))
            .distinct()
        )
        folders = found.filter("kind = 'tree'")
        files = found.filter("kind = 'blob'").select("node", "path", F.col("child").alias("blob_id"))
        below = _node(F.col("child"), F.col("path")).alias("below")
        levels.append((folders.select("node", below), files))
        if folders.isEmpty():
            return levels
        frontier = folders.select(F.col("child").alias("tree_id"), F.col("path").alias("prefix")).distinct()
    raise ValueError(f"trees are nested more than {MAX_DEPTH} deep")


def entries_from_trees(commits: DataFrame, trees: DataFrame, allow: Allowlist) -> DataFrame:
    """(repo, commit, path, blob_id) of commits (repo, commit, tree_id).

    ``trees`` has a row (tree_id, name, kind, child) per entry; ``kind`` is ``tree``,
    ``blob`` or ``commit`` (a submodule, which is skipped), any other is an error where it
    is reached. Names are decoded, paths start with a slash. Trees that are not in the
    table are empty, repeated rows count once, null ids and names have no files. The result equals
    ``prune_entries`` on the flat entries.

    Rounds grow with the depth of the folders. Each looks up the level's different
    (tree, path) pairs, however many commits hold them: first the trees are laid out by
    node, then each root goes down the nodes by narrow joins, then commits take the files
    of their root. Nodes that most roots share are hot keys, which the joins split.
    """
    wanted = commits
    if allow.commits:
        wanted = commits.filter(~F.col("commit").isin(list(allow.commits)))
    wanted = wanted.select("repo", "commit", "tree_id").distinct()
    roots = wanted.select("tree_id").distinct()
    member = roots.filter("tree_id IS NOT NULL").select(
        "tree_id", _node(F.col("tree_id"), F.lit("")).alias("node")
    )
    parts = []
    for folders, files in descend(roots, trees, allow):
        parts.append(join_on_skewed_key(member, files, "node", ["tree_id"]).select("tree_id", "path", "blob_id"))
        member = stored(
            join_on_skewed_key(member, folders, "node", ["tree_id"]).select(
                "tree_id", F.col("below").alias("node")
            )
        )
    found = reduce(DataFrame.unionByName, parts)
    return join_on_skewed_key(wanted, found, "tree_id", ["commit"]).select(
        "repo", "commit", "path", "blob_id"
    )
