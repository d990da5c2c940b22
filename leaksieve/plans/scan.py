"""Scans (C11, D10-D12): one lazy plan from tables to leak rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaksieve.functions.dates import commit_date_text
from leaksieve.operators import commits as C
from leaksieve.operators.detect import (
    DEFAULT,
    DetectOptions,
    drop_allowed_files,
    files_of_path_rules,
    keep_rule_paths,
    match_rules,
    rule_value,
)
from leaksieve.operators.layout import join_on_skewed_key, stored
from leaksieve.operators.paths import prune_entries
from leaksieve.schema import LEAK_COLUMNS
from leaksieve.sources.catalog import RuleSet


@dataclass(frozen=True)
class Selection:
    """Which commits to scan. The first selector that is set, in this order, wins.

    With ``user=None`` all selectors but ``uncommitted`` are ignored.
    """

    uncommitted: bool = False
    commit: str | None = None
    commits: str | Sequence[str] | None = None
    commits_file: str | None = None
    since: str | None = None
    until: str | None = None
    newer: str | None = None
    older: str | None = None
    branch: str | None = None
    user: str | None = ""

    def narrows(self) -> bool:
        return self.user is not None and bool(
            self.commit
            or self.commits
            or self.commits_file
            or (self.since and self.until)
            or (self.newer and self.older)
            or self.branch
            or self.user
        )


def select_commits(commits: DataFrame, refs: DataFrame | None, s: Selection) -> DataFrame:
    """C11: the selected commits as one DataFrame."""
    if s.uncommitted:
        return commits.limit(0)
    if s.user is None:
        return C.all_commits(commits)
    if s.commit is not None:
        return C.single(commits, s.commit, s.user)
    if s.commits is not None:
        return C.listed(commits, C.id_list(commits.sparkSession, s.commits), s.user)
    if s.commits_file is not None:
        return C.from_file(commits, s.commits_file, s.user)
    if s.since is not None and s.until is not None:
        return C.in_time_range(commits, s.since, s.until, s.user)
    if s.newer is not None and s.older is not None:
        return C.in_id_range(commits, s.newer, s.older, s.user)
    if s.branch is not None:
        if refs is None:
            raise ValueError("a branch selection needs the refs table")
        return C.branch_tips(commits, refs, s.branch)
    return C.all_commits(commits, s.user)


def _leak_columns(rules: RuleSet, commit_fields: dict[str, Column]) -> list[Column]:
    fields = {
        "line": F.col("line"),
        "line_number": F.col("line_number").cast("int"),
        "offender": F.col("match"),
        "rule": rule_value(rules, "description"),
        "file": F.col("path"),
        **commit_fields,
    }
    return [fields[c].alias(c) for c in LEAK_COLUMNS]


def scan_files(
    files: DataFrame, rules: RuleSet, options: DetectOptions = DEFAULT
) -> DataFrame:
    """Leaks in files that belong to no commit; all commit fields are empty.

    ``files`` has (path, content). Nothing is shuffled.
    """
    found = match_rules(files.select("path", "content"), rules, "content", options)
    if options.rule_paths:
        named = files_of_path_rules(files.select("path", "content"), rules)
        found = keep_rule_paths(found, rules, F.col("path")).unionByName(
            named, allowMissingColumns=True
        )
    return leaks_of_files(drop_allowed_files(found, rules, F.col("path"), F.lit("")), rules, options)


def leaks_of_files(found: DataFrame, rules: RuleSet, options: DetectOptions = DEFAULT) -> DataFrame:
    """The leak columns of matches in files, without a commit."""
    none = dict.fromkeys(
        ("commit", "repo", "commit_message", "author", "email", "date"), F.lit("")
    )
    extra = ["secret"] if options.secrets else []
    return found.select(*_leak_columns(rules, none), *extra)


def scan_history(
    commits: DataFrame,
    entries: DataFrame,
    blobs: DataFrame,
    rules: RuleSet,
    options: DetectOptions = DEFAULT,
    narrowed: bool = False,
    fix_offset: bool = False,
    unique_blobs: bool = True,
) -> DataFrame:
    """Leaks in the trees of ``commits``, with their commit fields.

    Each blob is scanned once, however many commits hold it, and where it was
    read; only its matches are joined to tree entries and commits. With
    ``narrowed`` (few commits selected) the ids of the blobs that selected trees hold are
    stored first and the texts are reduced to them before anything is searched. Where
    the ids are few, Spark broadcasts them by their true size and no text moves; a store
    of blobs that is clustered by ``blob_id`` is then also read in part only.
    Where ``blobs`` may hold a text more than once (``unique_blobs=False``), its
    matches are made unique, not the texts: that moves the matches only.
    """
    entries = prune_entries(entries, rules.allowlist)
    texts = blobs.select("blob_id", "content")
    if narrowed:
        entries = entries.join(
            commits.select("repo", "commit").distinct(), ["repo", "commit"], "left_semi"
        )
        wanted = stored(entries.select("blob_id").distinct())
        texts = texts.join(wanted, "blob_id", "left_semi")
    matches = match_rules(texts, rules, "content", options)
    if not unique_blobs:
        matches = matches.dropDuplicates(["blob_id", "rule_pos", "line_number"])
    found = join_on_skewed_key(
        entries.select("repo", "commit", "path", "blob_id"), matches, "blob_id"
    )
    if options.rule_paths:
        named = files_of_path_rules(entries.select("repo", "commit", "path", "blob_id"), rules)
        found = keep_rule_paths(found, rules, F.col("path")).unionByName(
            named, allowMissingColumns=True
        )
    found = drop_allowed_files(found, rules, F.col("path"), F.col("commit"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    fields = {
        "commit": F.col("commit"),
        "repo": F.col("repo"),
        "commit_message": text("commit_message"),
        "author": text("author"),
        "email": text("email"),
        "date": commit_date_text("commit_ts", "offset_minutes", fix_offset),
    }
    extra = ["secret"] if options.secrets else []
    return found.join(commits, ["repo", "commit"]).select(*_leak_columns(rules, fields), *extra)


def scan(
    selection: Selection,
    rules: RuleSet,
    commits: DataFrame,
    entries: DataFrame,
    blobs: DataFrame,
    refs: DataFrame | None = None,
    files: DataFrame | None = None,
    options: DetectOptions = DEFAULT,
    unique_blobs: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """The main route: (leaks, selected commits). ``files`` is the working tree."""
    chosen = select_commits(commits, refs, selection)
    if selection.uncommitted:
        if files is None:
            raise ValueError("an uncommitted scan needs the files table")
        return scan_files(files, rules, options), chosen
    leaks = scan_history(
        chosen, entries, blobs, rules, options, selection.narrows(), unique_blobs=unique_blobs
    )
    return leaks, chosen


def summary(leaks: DataFrame, commits: DataFrame) -> DataFrame:
    """leaks_number and commits_number (selected commits, before pruning)."""
    return leaks.agg(F.count(F.lit(1)).alias("leaks_number")).withColumn(
        "commits_number", commits.agg(F.count(F.lit(1))).scalar()
    )
