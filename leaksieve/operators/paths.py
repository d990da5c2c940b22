"""File pruning (F1-F3): narrow filters on tree entries, before any content is read."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaksieve.functions.text import ancestor_pattern, java_pattern
from leaksieve.operators.layout import stored
from leaksieve.operators.ruletable import in_bit_set
from leaksieve.sources.catalog import Allowlist


def _entry_is_regex(entry: str) -> bool:
    return entry.startswith("(") and entry.endswith("$")


def ancestors(path: Column) -> Column:
    """``/a``, ``/a/b``, ... up to the path itself."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(2), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"),
    )


def path_pruned(path: Column | str, paths: Sequence[str]) -> Column:
    """the file or one of its folders is in the global path allowlist.

    A pattern entry is searched in each ancestor, any other entry equals it. Where the
    anchor at the end is the pattern's only one, one search of the full path with "end or
    slash" in its place tests all ancestors at once.
    """
    c = F.col(path) if isinstance(path, str) else path
    regexes = [e for e in paths if _entry_is_regex(e)]
    tests, parts = [], []
    for e in regexes:
        simple = ancestor_pattern(e)
        if simple:
            tests.append(F.rlike(c, F.lit(simple)))
        else:
            tests.append(F.exists(ancestors(c), lambda a: F.rlike(a, F.lit(java_pattern(e)))))
    if len(regexes) < len(paths):
        parts = [rf"\A{re.escape(e)}(?<!\A)(?=/|\z)" for e in paths]
        tests.append(F.rlike(c, F.lit("|".join(parts))))
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def has_dot_part(path: Column | str) -> Column:
    """some part of the path starts with a dot."""
    c = F.col(path) if isinstance(path, str) else path
    return F.startswith(c, F.lit(".")) | F.contains(c, F.lit("/."))


def prune_entries(entries: DataFrame, allow: Allowlist) -> DataFrame:
    """F1-F3 on tree entries."""
    kept = entries.filter(~has_dot_part("path") & ~path_pruned("path", allow.paths))
    if allow.commits:
        kept = kept.filter(~F.col("commit").isin(list(allow.commits)))
    return kept


def prune_listed(files: DataFrame, listed: DataFrame, path: str = "path") -> DataFrame:
    """F1 where the allowlist is a table (path) of any length; its entries are compared as
    they are, none is a pattern.

    A row goes if its path or one of its folders is listed. Each ancestor is looked up in a
    bit set of 128 KB first. Rows of which no ancestor is in it stay where they are; only
    those of the others, by different paths, meet the list in a join. Columns are
    unchanged. Null paths go, as in ``prune_entries``; null entries are no entries.
    """
    entry = listed.select(F.col(listed.columns[0]).alias("gram"))
    entry = stored(entry.filter("gram IS NOT NULL").distinct())
    in_set = in_bit_set(entry)
    maybe = F.filter(ancestors(F.col(f"`{path}`")), in_set)
    doubtful = files.filter(F.size(maybe) > 0)
    pairs = doubtful.select(F.col(f"`{path}`").alias("p")).distinct().select(
        "p", F.explode(F.filter(ancestors(F.col("p")), in_set)).alias("gram")
    )
    pruned = pairs.join(entry, "gram", "left_semi").select("p").distinct()
    left = doubtful.join(pruned, F.col(f"`{path}`") == pruned["p"], "left_anti")
    return files.filter(F.size(maybe) == 0).unionByName(left)
