"""The scan in SQL, generated from a rule set, for the side-by-side check."""

from __future__ import annotations

from leaksieve.sources.catalog import Allowlist, RuleSet


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


def lines_cte(source: str, keys: str, content: str = "content", name: str = "lines") -> str:
    return f"""
{name} AS (SELECT {keys}, CAST(n AS INTEGER) AS line_number, line FROM (
    SELECT {keys}, unnest(ls) AS line, generate_subscripts(ls, 1) AS n, len(ls) AS total FROM (
      SELECT {keys}, string_split(replace({content}, chr(13) || chr(10), chr(10)), chr(10)) AS ls
      FROM {source}))
  WHERE NOT (n = total AND line = ''))"""


def rules_cte(rules: RuleSet) -> str:
    rows = ",\n  ".join(
        f"({i}, {quote(r.id)}, {quote(r.description)}, {quote(r.regex)})"
        for i, r in enumerate(rules.rules)
    )
    words = ",\n  ".join(
        f"({i}, {quote(k)})" for i, r in enumerate(rules.rules) for k in r.keywords
    )
    return f"""
rule(rule_pos, id, description, regex) AS (VALUES
  {rows}),
word(rule_pos, keyword) AS (VALUES
  {words})"""


def _listed(allow: Allowlist, target: str) -> str:
    if allow.regexes and allow.stopwords:
        return "false"
    tests = [f"regexp_matches({target}, {quote(p)})" for p in allow.regexes]
    tests += [f"contains({target}, {quote(w)})" for w in allow.stopwords]
    return "(" + " OR ".join(tests or ["false"]) + ")"


def _stopwords_cte(rules: RuleSet, match_target: str) -> tuple[str, str]:
    """(CTE, test) for stopword lists that are too long for one test per word."""
    rows, tests = [], []
    for i, r in enumerate(rules.rules):
        a = r.allowlist
        if a and len(a.stopwords) > LONG_LIST and not a.regexes:
            rows += [f"({i}, {quote(w)})" for w in a.stopwords]
            target = "line" if a.regex_target == "line" else match_target
            tests.append(
                f"(m.rule_pos = {i} AND EXISTS (SELECT 1 FROM stop s"
                f" WHERE s.rule_pos = m.rule_pos AND contains(m.{target}, s.word)))"
            )
    if not rows:
        return "", "false"
    values = ",\n  ".join(rows)
    return f"stop(rule_pos, word) AS (VALUES\n  {values}),\n", " OR ".join(tests)


LONG_LIST = 50


def matches_ctes(
    rules: RuleSet, source: str = "files", key: str = "path", fold: bool = False,
    match_target: str = "match",
) -> str:
    """CTEs up to ``matches(key, rule_pos, line_number, line, match)``: D1-D7."""
    text = "lower(f.content)" if fold else "f.content"
    a = rules.allowlist
    drops = [_listed(a, "line" if a.regex_target == "line" else match_target)]
    stop_cte, stopped = _stopwords_cte(rules, match_target)
    for i, r in enumerate(rules.rules):
        if r.allowlist and (r.allowlist.regexes or len(r.allowlist.stopwords) <= LONG_LIST):
            t = "line" if r.allowlist.regex_target == "line" else match_target
            drops.append(f"(rule_pos = {i} AND {_listed(r.allowlist, t)})")
    secret = "CASE " + "".join(
        f"WHEN rule_pos = {i} THEN regexp_extract(line, {quote(r.regex)}, {r.secret_group}) "
        for i, r in enumerate(rules.rules)
        if r.secret_group
    ) + "ELSE match END" if any(r.secret_group for r in rules.rules) else "match"
    return (
        rules_cte(rules)
        + f""",
called AS (SELECT DISTINCT f.{key}, w.rule_pos FROM {source} f JOIN word w
  ON contains({text}, w.keyword)),"""
        + lines_cte(source, key)
        + f""",
found AS (SELECT l.{key}, c.rule_pos, l.line_number, l.line,
    regexp_extract(l.line, r.regex) AS match
  FROM lines l JOIN called c ON l.{key} = c.{key} JOIN rule r ON r.rule_pos = c.rule_pos
  WHERE regexp_matches(l.line, r.regex)),
secrets AS (SELECT *, {secret} AS secret FROM found),
{stop_cte}matches AS (SELECT * FROM secrets m WHERE NOT ({' OR '.join(drops)}) AND NOT ({stopped}))"""
    )


def file_leaks(source: str = "matches") -> str:
    """The eleven report columns for files without a commit."""
    return f"""SELECT m.line, m.line_number, m.match AS offender, '' AS commit, '' AS repo,
  r.description AS rule, '' AS commit_message, '' AS author, '' AS email, m.path AS file,
  '' AS date FROM {source} m JOIN rule r ON m.rule_pos = r.rule_pos"""


DATE_TEXT = """strftime(commit_ts - to_minutes(offset_minutes), '%Y-%m-%d %H:%M:%S') || ' ' ||
  CASE WHEN offset_minutes > 0 THEN '-' ELSE '+' END ||
  lpad(CAST(abs(offset_minutes) // 60 AS VARCHAR), 2, '0') || ':' ||
  lpad(CAST(abs(offset_minutes) % 60 AS VARCHAR), 2, '0')"""


def history_leaks(entries: str = "kept", commits: str = "commits") -> str:
    return f"""SELECT m.line, m.line_number, m.match AS offender, c.commit, c.repo,
  r.description AS rule, coalesce(c.commit_message, '') AS commit_message,
  c.author, c.email, e.path AS file, {DATE_TEXT} AS date
FROM matches m JOIN {entries} e ON e.blob_id = m.blob_id
JOIN {commits} c ON c.repo = e.repo AND c.commit = e.commit JOIN rule r ON r.rule_pos = m.rule_pos"""
