"""Commit selection.

Every selector returns rows of ``commits``. ``user`` keeps commits of one author
name (exact); the empty text means everyone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leaksieve.functions.dates import time_range
from leaksieve.operators.blocks import moved
from leaksieve.operators.ladder import closure, folded
from leaksieve.operators.layout import dense_positions, discard, freeing, reliable, settled, stored
from leaksieve.sources.corpus import commit_lines


def by_author(commits: DataFrame, user: str) -> DataFrame:
    """C10."""
    return commits.filter(F.col("author") == user) if user else commits


def all_commits(commits: DataFrame, user: str = "") -> DataFrame:
    """C8 on a table of commits that are all reachable from HEAD; see ``reachable``."""
    return by_author(commits, user)


def reachable(
    commits: DataFrame, parents: DataFrame, heads: DataFrame, user: str = ""
) -> DataFrame:
    """The commits that can be reached from the ``heads`` (repo, commit), HEAD
    included, in each repository.

    ``parents`` has (commit, parent) and may have ``nth``, the place among a commit's
    parents: the first ones are the lines that are jumped along. Commits that the table
    does not have (of a shallow clone, say) end a line. A repository without a head has
    no reachable commits.
    """
    as_commit = lambda c: F.col(c).cast(commits.schema["commit"].dataType).alias("commit")
    number = _numbers(
        [commits, parents.select(as_commit("parent")), heads.select(as_commit("commit"))], "commit"
    )
    known = commits.select(number("commit").alias("node")).distinct()
    ups = parents.select(
        number(as_commit("commit")).alias("node"),
        F.struct(*(["nth"] if "nth" in parents.columns else []), number(as_commit("parent")).alias("up")).alias("up"),
    )
    edges = stored(
        ups.join(known, "node", "left_semi").groupBy("node")
        .agg(F.array_sort(F.collect_set("up"))["up"].alias("ups"))
    )
    chain = edges.select("node", F.get("ups", F.lit(0)).alias("next"))
    others = edges.select("node", F.explode(F.slice("ups", 2, F.size("ups"))).alias("next"))
    starts = heads.select(F.col("repo").alias("root"), number(as_commit("commit")).alias("node"))
    seen = closure(chain, others, starts).withColumnRenamed("root", "repo")
    found = by_author(commits, user).withColumn("_node", number("commit")).join(
        seen.withColumnRenamed("node", "_node"), ["repo", "_node"], "left_semi"
    )
    return found.select(*commits.columns)


def single(commits: DataFrame, commit: str, user: str = "") -> DataFrame:
    """C1."""
    return by_author(commits.filter(F.col("commit") == commit), user)


def listed(commits: DataFrame, ids: DataFrame, user: str = "") -> DataFrame:
    """The commits of an id list. An id that is listed twice gives two rows, an
    unknown id fails the query."""
    found = ids.select(F.col("commit").alias("_id")).join(
        commits, F.col("_id") == F.col("commit"), "left"
    )
    known = F.when(
        F.col("commit").isNull(),
        F.raise_error(F.concat(F.lit("unknown commit: "), F.col("_id"))).cast("boolean"),
    ).otherwise(True)
    return by_author(found.filter(known).drop("_id"), user)


def id_list(spark: SparkSession, ids: str | Sequence[str]) -> DataFrame:
    """Ids as a DataFrame; a text is split at commas and not trimmed."""
    ids = ids.split(",") if isinstance(ids, str) else list(ids)
    return spark.range(1).select(F.explode(F.lit(ids)).alias("commit"))


def ids_of_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """L8 on a table of lines: each line is an id, kept as it is (a CR at its end goes)."""
    return lines.select(F.regexp_replace(line, r"\r\z", "").alias("commit"))


def from_file(commits: DataFrame, path: str, user: str = "") -> DataFrame:
    """C2 over a file with one id per line."""
    return listed(commits, ids_of_lines(commit_lines(commits.sparkSession, path)), user)


def in_time_range(
    commits: DataFrame,
    since: str,
    until: str,
    user: str = "",
    excluded: DataFrame | None = None,
) -> DataFrame:
    """C4: commits between two days or two RFC 3339 instants, both ends included.
    C5: without the ``excluded`` ids."""
    lo, hi = time_range(since, until)
    kept = commits.filter(F.col("commit_ts").between(_instant(lo), _instant(hi)))
    if excluded is not None:
        kept = without(kept, excluded)
    return by_author(kept, user)


def _instant(t: datetime) -> F.Column:
    return F.lit(t.isoformat()).cast("timestamp")


def without(commits: DataFrame, excluded: DataFrame) -> DataFrame:
    """Set difference by commit id."""
    return commits.join(excluded.select("commit"), "commit", "left_anti").select(*commits.columns)


def in_id_range(
    commits: DataFrame, newer: Column | str | None, older: Column | str | None, user: str = ""
) -> DataFrame:
    """The stretch from ``newer`` to ``older``, both included, of each repository
    that has both.

    HEAD has position 0. An id that is missing, or a pair in the wrong order, gives no
    rows. An id may be a scalar subquery.
    """
    if newer is None or older is None:
        return commits.limit(0)
    of = lambda c: F.max(F.when(F.col("commit") == c, F.col("pos")))
    bounds = (
        commits.filter((F.col("commit") == newer) | (F.col("commit") == older))
        .groupBy(F.col("repo").alias("_repo"))
        .agg(of(newer).alias("_from"), of(older).alias("_to"))
    )
    kept = commits.join(
        bounds, (F.col("repo") == F.col("_repo")) & F.col("pos").between(F.col("_from"), F.col("_to"))
    )
    return by_author(kept.select(*commits.columns), user)


def branch_tips(commits: DataFrame, refs: DataFrame, text: str) -> DataFrame:
    """Tips of the branches whose full name contains ``text``; a tip that two
    branches share is there twice."""
    tips = refs.filter(
        F.startswith("ref_name", F.lit("refs/heads/")) & F.contains("ref_name", F.lit(text))
    ).select("repo", "commit")
    return tips.join(commits, ["repo", "commit"]).select(*commits.columns)


# Rounds of single steps before the first pass of jumps; before each next one, twice as many.
ROUNDS_BEFORE_JUMPS = 2


def _at(time: Column, ahead: Column) -> Column:
    """A place; the later of two is the lesser struct: an earlier time, then further behind."""
    return F.struct(time.alias("time"), ahead.cast("long").alias("ahead"))


def _numbers(tables: Sequence[DataFrame], *key: str, first: int = 0) -> Callable[..., Column]:
    """A 64-bit number for a key, which no two keys of the ``tables`` share; they are told
    apart by another 64 bits. ``first`` is the first seed that is tried."""
    for seed in count(first):
        number = lambda *names, seed=seed: F.xxhash64(F.lit(seed), *names)
        other = F.xxhash64(F.lit(~seed), *reversed(key)).alias("other")
        each = [t.select(number(*key).alias("node"), other) for t in tables]
        both = reduce(DataFrame.unionByName, each)
        seen = both.groupBy("node").agg(F.min("other").alias("a"), F.max("other").alias("b"))
        with freeing(both.sparkSession):
            if seen.filter("a <> b").isEmpty():
                return number


def _lines(edges: DataFrame) -> DataFrame:
    """From each parent with one child to that child, with the steps between them."""
    only = edges.groupBy("up").agg(
        F.min("node").alias("next"), F.max("node").alias("last"), F.max("steps").alias("steps")
    )
    return stored(only.filter("next = last").select(F.col("up").alias("node"), "next", "steps"))


def _jumped(step: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Places handed up whole lines, and all that have changed since the last full round.

    A line is the only way from a commit ``steps`` ahead, so its place plus as many
    steps is one that the commit must come after.
    """
    to = folded(lines, step.select("node", "at")).withColumnRenamed("at", "to")
    later = F.coalesce(F.col("to") < F.col("at"), F.lit(False))
    step = reliable(
        step.join(to, "node", "left").select(
            "node", F.when(later, F.col("to")).otherwise(F.col("at")).alias("at"),
            (F.col("moved") | later).alias("moved"),
        )
    )
    return step.drop("moved"), stored(step.filter("moved").drop("moved"))


def _by_rounds(edges: DataFrame, placed: DataFrame) -> DataFrame:
    """The last places (node, at) by ``edges`` (node, up, steps), where ``placed`` are the first.

    A round handles all commits whose place has changed in the round before. Where two
    rounds do not suffice, places are also handed up whole lines (runs of commits with one
    child each) by jumps, so rounds grow with the logarithm of such a run.
    """
    changed = placed
    lines, rounds = None, 0
    wait = due = ROUNDS_BEFORE_JUMPS
    while True:
        pushed = (
            edges.join(changed, "node")
            .groupBy(F.col("up").alias("node"))
            .agg(F.min(_at(F.col("at.time"), F.col("at.ahead") - F.col("steps"))).alias("to"))
        )
        later = F.coalesce(F.col("to") < F.col("at"), F.lit(False))
        step = reliable(
            placed.join(pushed, "node", "left").select(
                "node", F.when(later, F.col("to")).otherwise(F.col("at")).alias("at"),
                later.alias("moved"),
            )
        )
        placed, changed = step.drop("moved"), stored(step.filter("moved").drop("moved"))
        rounds += 1
        if changed.isEmpty():
            return placed
        if rounds == due:
            lines = lines or _lines(edges)
            placed, changed = _jumped(step, lines)
            wait *= 2
            due += wait


# Stands for a time that is null, which comes before all others.
NO_TIME = -(1 << 63)


def _nodes(keyed: DataFrame, number: Callable[..., Column]) -> tuple[Callable[[], Column], DataFrame]:
    """(repository's number, stored (node, r, ts, last, n)): each commit of each repository
    once, with its number, its first and its last time and how many rows it has.

    Such a number is that of the commit, which ``number`` gives, mixed with the repository's
    by exclusive or, so that either one and the number give the other.
    """
    for seed in count():
        of = _numbers([keyed.select("repo")], "repo", first=seed)
        r = lambda of=of: of("repo")
        nodes = settled(
            keyed.select(number("commit").bitwiseXOR(r()).alias("node"), r().alias("r"), "ts")
            .repartition("node").groupBy("node")
            .agg(F.min("r").alias("r"), F.max("r").alias("other"), F.min("ts").alias("ts"),
                 F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))
        )
        if nodes.filter("r <> other").isEmpty():
            return r, nodes.drop("other")
        discard(nodes)


def _edges(nodes: DataFrame, ups: DataFrame) -> DataFrame:
    """(r, node, ts, up, up_ts), stored: from the commits to their parents, ``ups`` (c, p) by the
    commits' numbers, in each repository that has both."""
    child = nodes.select(F.col("node").bitwiseXOR(F.col("r")).alias("c"), "r", "ts")
    parent = nodes.select("r", F.col("node").alias("up"), F.col("ts").alias("up_ts"))
    with_child = ups.join(child, "c").select(
        "r", F.col("c").bitwiseXOR(F.col("r")).alias("node"), "ts", F.col("p").bitwiseXOR(F.col("r")).alias("up")
    )
    return settled(with_child.join(parent, ["up", "r"]).select("r", "node", "ts", "up", "up_ts"))


def _that_matter(edges: DataFrame) -> DataFrame:
    """The edges that can change a place.

    Where parents are newer than a child, places may go back in time, but no further than
    from the last such parent to the first such child of the repository. Elsewhere only
    parents of the same time as a child come to another place.
    """
    wrong = stored(
        edges.filter("up_ts > ts").groupBy("r").agg(F.min("ts").alias("low"), F.max("up_ts").alias("high"))
    )
    if wrong.isEmpty():
        return edges.filter("up_ts = ts")
    return edges.join(wrong, "r", "left").filter(
        "up_ts >= ts OR (up_ts >= low AND ts <= high)"
    ).select(*edges.columns)


def _found(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, time, ahead), stored, of the commits that come to another place than their own."""
    needed = _that_matter(edges)
    if needed.isEmpty():
        return settled(edges.limit(0).select("node", F.col("ts").alias("time"), F.col("ts").alias("ahead")))
    return moved(needed, nodes, _by_rounds)


def _for_rows(found: DataFrame, edges: DataFrame, several: DataFrame) -> DataFrame:
    """``found``, but for commits of ``several`` times the place that the children give them,
    which each of their rows compares with its own time."""
    child = F.coalesce("time", "ts"), F.coalesce("ahead", F.lit(0)) - 1
    given = (
        edges.join(several.withColumnRenamed("node", "up"), "up", "left_semi")
        .join(found, "node", "left").groupBy(F.col("up").alias("node")).agg(F.min(_at(*child)).alias("to"))
    )
    both = found.join(several, "node", "left_anti").unionByName(given.select("node", "to.time", "to.ahead"))
    out = settled(both)
    discard(found)
    return out


def topological_positions(commits: DataFrame, parents: DataFrame) -> DataFrame:
    """(repo, commit, pos), children before parents, HEAD at 0, in each repository.

    ``commits`` needs (repo, commit, commit_ts), ``parents`` (commit, parent); a commit
    that several repositories share is placed in each. The order is by time, newest
    first, which is nearly topological: only where a clock was wrong is a parent not
    older than its child. Such a parent takes the time of its child and comes one step
    after it (``behind``), and so on upwards. Commits that are near in time are handled
    together (``operators.blocks``); where time keeps no neighbours together, round by
    round and along lines. Ties go to the newer commit, then by id. Two commits that are
    each other's ancestors are refused or do not end.
    """
    ts = F.coalesce(F.unix_micros("commit_ts"), F.lit(NO_TIME)).alias("ts")
    keyed = commits.select("repo", "commit", ts)
    kind = keyed.schema["commit"].dataType
    ups = parents.filter("commit IS NOT NULL").select(
        F.col("commit").cast(kind).alias("commit"), F.col("parent").cast(kind).alias("parent")
    )
    number = _numbers(
        [keyed.select("commit"), ups.select("commit"), ups.select(F.col("parent").alias("commit"))], "commit"
    )
    repo, nodes = _nodes(keyed, number)
    edges = _edges(nodes, ups.select(number("commit").alias("c"), number("parent").alias("p")))
    again = stored(nodes.filter("n > 1"))
    found = _found(edges, nodes)
    discard(nodes)
    rows = keyed.withColumn("node", number("commit").bitwiseXOR(repo())).withColumn("own", F.col("ts"))
    if not again.isEmpty():
        found = _for_rows(found, edges, again.filter("last > ts").select("node"))
        times = rows.join(again, "node", "left_semi").groupBy("node").agg(F.collect_list("ts").alias("times"))
        rows = rows.join(times, "node", "left").withColumn(
            "own", F.explode(F.coalesce("times", F.array("ts")))
        )
    own, to = _at(F.col("own"), F.lit(0)), _at(F.col("time"), F.col("ahead"))
    at = F.when(F.col("time").isNotNull() & (to < own), to).otherwise(own)
    placed = settled(
        rows.join(found, "node", "left").withColumn("at", at)
        .select("repo", "commit", "ts", "at.time", (-F.col("at.ahead")).alias("behind"))
    )
    discard(edges, found)
    order = [F.desc("time"), F.col("behind"), F.desc("ts"), F.col("commit")]
    positions = dense_positions(placed, "repo", order, keep=["repo", "commit"])
    discard(placed)
    return positions.select("repo", "commit", "pos")
