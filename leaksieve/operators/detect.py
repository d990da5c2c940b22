"""Detection (D1-D9, F4, F5): keyword prefilter, lines, first match, allowlists.

The whole chain is narrow: every text is looked at where it was read, and only
(text, rule) pairs whose keyword is present, then only lines that match, go on.
Nothing is shuffled or broadcast; the rules are literals of the plan, and so are the
patterns that are tried on many rows, which are compiled once per task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import reduce
from importlib import util

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leaksieve.functions.secrets import secret_of, shannon_entropy
from leaksieve.functions.text import (
    contains_any,
    group_of_match,
    implied_by_line_match,
    java_pattern,
    java_pattern_multiline,
    lines_of_unix_text,
    screen_patterns,
    unix_newlines,
)
from leaksieve.sources.catalog import Allowlist, Rule, RuleSet

# From here on one automaton pass beats one search per keyword.
AUTOMATON_FROM = 12

# Text that a worker is sent at once, and that it searches at once. One text may be longer.
BATCH_BYTES = 4 << 20
SEARCH_BYTES = 1 << 20

_LITERAL = (
    "array<struct<regex:string,secret_group:int,entropy:double,path:string>>"
)


@dataclass(frozen=True)
class DetectOptions:
    """Behaviour beyond the default; everything is off."""

    secrets: bool = False  # X1: add a ``secret`` column
    entropy: bool = False  # X2: keep matches whose secret reaches the rule's entropy
    rule_paths: bool = False  # X3: a rule with ``path`` runs on such files only
    target_secret: bool = False  # X6: allowlists without a target look at the secret
    ignore_keyword_case: bool = False  # X7
    prefilter: str = "auto"  # "automaton", "search", or chosen by keyword count


DEFAULT = DetectOptions()


# --------------------------------------------------------------------------- D1


def bounded_batches(spark: SparkSession) -> None:
    """Send texts to Python workers by their bytes, not by ten thousand rows: what a worker
    holds is then the same for small and large tables. Results do not depend on it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def _keyword_table(rules: RuleSet, ignore_case: bool) -> tuple[dict[str, list[int]], list[int]]:
    """keyword -> rule numbers, and the rules that the empty keyword always calls."""
    table: dict[str, list[int]] = {}
    always: list[int] = []
    for i, rule in enumerate(rules.rules):
        words = {k.lower() if ignore_case else k for k in rule.keywords}
        if "" in words:
            always.append(i)
            continue
        for w in words:
            table.setdefault(w, []).append(i)
    return table, always


def _search(content: Column, table: dict[str, list[int]]) -> Column:
    """One substring search per keyword, inside the JVM."""
    rows = json.dumps([{"w": w, "r": r} for w, r in table.items()])
    words = F.from_json(F.lit(rows), "array<struct<w:string,r:array<int>>>")
    found = F.filter(words, lambda k: F.contains(content, k["w"]))
    return F.array_distinct(F.flatten(F.transform(found, lambda k: k["r"])))


def _automaton(
    content: Column,
    table: dict[str, list[int]],
    screen: dict[int, tuple[str | None, str | None]],
) -> Column:
    """One pass over the text for all keywords (Aho-Corasick on Arrow batches).

    A first look for any keyword, linear-time on whole Arrow arrays, leaves most texts
    alone; only the others become Python texts. ``screen`` has two linear-time patterns
    per rule, for ASCII and for any text. Rules whose pattern is not found in a text are
    left out at once, where the text is at hand. The functions are nested so that they
    travel by value and workers need not have this package.
    """
    special = set("\\.+*?()|[]{}^$")
    quoted = ["".join("\\" + c if c in special else c for c in w) for w in table]
    any_word = "|".join(quoted)

    def leave_out(texts: list[str], called: list[set[int]]) -> None:
        import pyarrow as pa
        import pyarrow.compute as pc

        at = [i for i, c in enumerate(called) if not c.isdisjoint(screen)]
        plain = [texts[i].isascii() for i in at]
        unix = pa.array([texts[i].replace("\r\n", "\n") for i in at], pa.large_string())
        jobs: dict[tuple[int, str], list[int]] = {}
        for place, i in enumerate(at):
            for rule in called[i] & screen.keys():
                pattern = screen[rule][0 if plain[place] else 1]
                if pattern is not None:
                    jobs.setdefault((rule, pattern), []).append(place)
        for (rule, pattern), places in jobs.items():
            try:
                hits = pc.match_substring_regex(unix.take(pa.array(places)), pattern).to_pylist()
            except pa.ArrowInvalid:  # a pattern this engine refuses is left to the JVM
                continue
            for place, hit in zip(places, hits):
                if not hit:
                    called[at[place]].discard(rule)

    limit = SEARCH_BYTES

    def portions(batch: pa.Array) -> Iterator[pa.Array]:
        import numpy as np
        import pyarrow.compute as pc

        upto = np.cumsum(pc.fill_null(pc.binary_length(batch), 0).to_numpy().astype("int64"))
        cuts = (np.flatnonzero(np.diff(upto // limit)) + 1).tolist()
        for start, end in zip([0, *cuts], [*cuts, len(batch)]):
            yield batch.slice(start, end - start)

    def search(batch: pa.Array, words) -> list[list[int]]:
        import pyarrow as pa
        import pyarrow.compute as pc

        try:
            hit = pc.fill_null(pc.match_substring_regex(batch, any_word), False)
        except pa.ArrowInvalid:  # too many words for one pattern: look at all texts
            hit = pc.is_valid(batch)
        some = pc.indices_nonzero(hit)
        texts = batch.take(some).to_pylist()
        called = [{i for w in {w for _, w in words.iter(t)} for i in table[w]} for t in texts]
        if screen:
            leave_out(texts, called)
        out = [[] for _ in range(len(batch))]
        for i, c in zip(some.to_pylist(), called):
            out[i] = sorted(c)
        return out

    @F.arrow_udf("array<int>")
    def rules_called(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick
        import pyarrow

        words = ahocorasick.Automaton()
        for w in table:
            words.add_word(w, w)
        words.make_automaton()
        for batch in batches:
            out = []
            for part in portions(batch):
                out += search(part, words)
            yield pyarrow.array(out, pyarrow.list_(pyarrow.int32()))
            del batch, out
            pyarrow.default_memory_pool().release_unused()

    return rules_called(content)


def rules_called_by(
    content: Column, rules: RuleSet, options: DetectOptions = DEFAULT, screen: bool = False
) -> Column:
    """Array of the numbers of the rules that run on this text.

    A rule runs iff the text holds one of its keywords, case-sensitively. Without
    keywords it never runs; the empty keyword is in every text. With ``screen`` rules
    that run but cannot match may be missing.
    """
    table, always = _keyword_table(rules, options.ignore_keyword_case)
    if options.ignore_keyword_case:
        content = F.lower(content)
        screen = False
    how = options.prefilter
    if how == "auto":
        big = len(table) >= AUTOMATON_FROM and util.find_spec("ahocorasick") is not None
        how = "automaton" if big else "search"
    if not table:
        called = F.lit([]).cast("array<int>")
    elif how == "automaton":
        patterns = {
            i: screen_patterns(r.regex) for i, r in enumerate(rules.rules) if r.regex is not None
        }
        called = _automaton(content, table, patterns if screen else {})
    else:
        called = _search(content, table)
    if always:
        called = F.array_union(called, F.lit(always).cast("array<int>"))
    return called


def candidates(
    texts: DataFrame,
    rules: RuleSet,
    content: str = "content",
    options: DetectOptions = DEFAULT,
    screen: bool = True,
) -> DataFrame:
    """D1 as a filter: the texts that call a rule, with ``rules_called``.

    An array of no or one array is exploded instead of testing its size, for the
    optimizer would compute the array once for the test and once for the column.
    """
    bounded_batches(texts.sparkSession)
    called = F.array(rules_called_by(F.col(content), rules, options, screen))
    some = F.filter(called, lambda c: F.size(c) > 0)
    return texts.withColumn("rules_called", F.explode_outer(some)).filter(
        F.col("rules_called").isNotNull()
    )


def keyword_pairs(
    texts: DataFrame, rules: RuleSet, content: str = "content", options: DetectOptions = DEFAULT
) -> DataFrame:
    """D1 as a relation: one row per (text, rule that runs)."""
    called = candidates(texts, rules, content, options, screen=False)
    return _each(called, "rules_called", "rule_pos")


def _each(df: DataFrame, array: str, name: str) -> DataFrame:
    """One row per element. The outer form keeps the optimizer from testing the
    size of the array first, which would compute the array twice."""
    return df.withColumn(name, F.explode_outer(array)).drop(array).filter(F.col(name).isNotNull())


# ------------------------------------------------------------------ allowlists


def _rule_literal(rules: RuleSet) -> Column:
    def row(r: Rule) -> dict:
        return {
            "regex": None if r.regex is None else java_pattern(r.regex),
            "secret_group": r.secret_group,
            "entropy": r.entropy,
            "path": java_pattern(r.path) if r.path else None,
        }

    return F.from_json(F.lit(json.dumps([row(r) for r in rules.rules])), _LITERAL)


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def _listed(allow: Allowlist, target: Column) -> Column:
    """The allowlist test. Two non-empty lists switch each other off."""
    if allow.regexes and allow.stopwords:
        return F.lit(False)
    tests = [F.rlike(target, F.lit(java_pattern(p))) for p in allow.regexes]
    if allow.stopwords:
        tests.append(contains_any(target, allow.stopwords))
    return _any(tests)


def globally_allowed(allow: Allowlist, line: Column, match: Column) -> Column:
    """The global allowlist drops this match."""
    return _listed(allow, line if allow.regex_target == "line" else match)


def _of_rule(pos: int, test: Column) -> Column:
    return (F.col("rule_pos") == pos) & test


def allowed_by_rule(rules: RuleSet, line: Column, match: Column) -> Column:
    """The allowlist of the match's own rule drops it."""
    return _any(
        [
            _of_rule(i, _listed(a, line if a.regex_target == "line" else match))
            for i, a in enumerate(r.allowlist for r in rules.rules)
            if a and (a.regexes or a.stopwords)
        ]
    )


def path_listed(path: Column, paths: tuple[str, ...]) -> Column:
    """the full path is in an allowlist (patterns searched; equality counts where
    some entry is no pattern)."""
    patterns = [p for p in paths if p.startswith("(") and p.endswith("$")]
    tests = [F.rlike(path, F.lit(java_pattern(p))) for p in patterns]
    if len(patterns) < len(paths):
        tests.append(path.isin(list(paths)))
    return _any(tests)


def drop_allowed_files(
    matches: DataFrame, rules: RuleSet, path: Column, commit: Column
) -> DataFrame:
    """a rule yields nothing in files and commits of its own allowlist."""
    tests = []
    for i, allow in enumerate(r.allowlist for r in rules.rules):
        if allow and allow.paths:
            tests.append(_of_rule(i, path_listed(path, allow.paths)))
        if allow and allow.commits:
            tests.append(_of_rule(i, commit.isin(list(allow.commits))))
    return matches.filter(~F.coalesce(_any(tests), F.lit(False))) if tests else matches


def files_of_path_rules(files: DataFrame, rules: RuleSet) -> DataFrame:
    """(all columns but the content, rule_pos, line_number 0, empty line, match) for
    each file whose path a rule without a pattern of its own names; ``match`` is the path."""
    named = [
        F.when(F.rlike("path", F.lit(java_pattern(r.path))), F.lit(i))
        for i, r in enumerate(rules.rules)
        if r.regex is None and r.path
    ]
    found = F.array_compact(F.array(*named)) if named else F.array().cast("array<int>")
    return files.drop("content").withColumn("rule_pos", F.explode(found)).select(
        "*", F.lit(0).alias("line_number"), F.lit("").alias("line"), F.col("path").alias("match")
    )


def keep_rule_paths(matches: DataFrame, rules: RuleSet, path: Column) -> DataFrame:
    """A rule with a ``path`` pattern yields matches in such files only."""
    wanted = F.element_at(_rule_literal(rules), F.col("rule_pos") + 1)["path"]
    return matches.filter(wanted.isNull() | F.rlike(path, wanted))


def anti_set(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``left`` that are not in ``right``; duplicates stay, NULLs are equal."""
    l, r = left.alias("l"), right.select(*columns).alias("r")
    same = reduce(
        lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in columns]
    )
    return l.join(r, same, "left_anti")


# ------------------------------------------------------------------------ D2-D7


def _whole_test(rules: RuleSet, content: str) -> Column:
    """The called rules whose pattern is somewhere in the whole text, or might be. Each
    pattern is a literal, so it is compiled once, and tried only where it is called."""
    tests = []
    for i, r in enumerate(rules.rules):
        if r.regex is None:
            continue
        test = F.array_contains("rules_called", i)
        if implied_by_line_match(r.regex):
            test = test & F.rlike(content, F.lit(java_pattern_multiline(r.regex)))
        tests.append(F.when(test, F.lit(i)))
    return F.array_compact(F.array(*tests)) if tests else F.array().cast("array<int>")


def match_candidates(
    called: DataFrame, rules: RuleSet, content: str = "content", options: DetectOptions = DEFAULT
) -> DataFrame:
    """D2-D7 on the output of ``candidates``.

    Adds ``rule_pos``, ``line_number``, ``line`` and ``match`` (and ``secret`` where
    asked for), and drops the text. One multi-line test of the whole text decides
    whether its lines are needed at all; the lines of one text and rule follow each
    other, so their pattern is compiled once for them.
    """
    unix = called.withColumn(content, unix_newlines(content))
    text = _each(
        unix.withColumn("rules_called", _whole_test(rules, content)), "rules_called", "rule_pos"
    )
    rule = F.element_at(_rule_literal(rules), F.col("rule_pos") + 1)
    kept = [c for c in text.columns if c != content]
    hits = (
        text.select(
            *kept,
            rule["regex"].alias("_regex"),
            F.posexplode_outer(lines_of_unix_text(content)).alias("_at", "line"),
        )
        .filter(F.rlike(F.col("line"), F.col("_regex")))
        .withColumn("match", group_of_match(F.col("line"), F.col("_regex"), F.lit(0)))
        .withColumn("line_number", (F.col("_at") + 1).cast("int"))
    )
    target = F.col("match")
    if options.secrets or options.entropy or options.target_secret:
        hits = hits.withColumn(
            "secret",
            secret_of(F.col("line"), F.col("_regex"), rule["secret_group"], F.col("match")),
        )
        if options.target_secret:
            target = F.col("secret")
    if options.entropy:
        hits = hits.filter(
            rule["entropy"].isNull() | (shannon_entropy(F.col("secret")) >= rule["entropy"])
        )
    allowed = globally_allowed(rules.allowlist, F.col("line"), target) | allowed_by_rule(
        rules, F.col("line"), target
    )
    extra = ["secret"] if options.secrets else []
    return hits.filter(~allowed).select(*kept, "line_number", "line", "match", *extra)


def match_rules(
    texts: DataFrame, rules: RuleSet, content: str = "content", options: DetectOptions = DEFAULT
) -> DataFrame:
    """All matches of all rules in all texts, in one pass; other columns are kept."""
    return match_candidates(candidates(texts, rules, content, options), rules, content, options)


def rule_value(rules: RuleSet, name: str, pos: Column | str = "rule_pos") -> Column:
    """A scalar attribute of the rule at ``pos`` (``id``, ``description``, ...)."""
    values = json.dumps([asdict(r)[name] for r in rules.rules])
    pos = F.col(pos) if isinstance(pos, str) else pos
    return F.element_at(F.from_json(F.lit(values), "array<string>"), pos + 1)


def rule_tags(rules: RuleSet, pos: Column | str = "rule_pos") -> Column:
    """The tags of the rule at ``pos``."""
    values = json.dumps([list(r.tags) for r in rules.rules])
    pos = F.col(pos) if isinstance(pos, str) else pos
    return F.element_at(F.from_json(F.lit(values), "array<array<string>>"), pos + 1)
