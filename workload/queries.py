"""All registered queries, each next to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaksieve.functions import dates, secrets, text
from leaksieve.operators import commits as C
from leaksieve.operators import detect as D
from leaksieve.operators import paths as P
from leaksieve.operators import rules as R
from leaksieve.operators.ruletable import keyword_pairs as keyword_pairs_of_table
from leaksieve.operators.layout import shared_folder
from leaksieve.plans import report
from leaksieve.plans.append import append_once, read_appended
from leaksieve.plans.large import scan_chunks
from leaksieve.plans.scan import Selection, scan, scan_files, scan_history, select_commits, summary
from leaksieve.schema import LEAK_COLUMNS
from leaksieve.sources import corpus, trees, worktree
from leaksieve.sources.catalog import Allowlist, Rule, RuleSet, stock_rules, stock_stopwords
from workload import model as M
from workload.sql import DATE_TEXT, file_leaks, history_leaks, lines_cte, matches_ctes, quote
from workload.sql import rules_cte, with_

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn

    return register


# ------------------------------------------------------------------- rule sets

# Patterns keep to classes that mean the same in every dialect.
EMAIL = Rule(
    "email", "E-mail address", r"([A-Za-z0-9._%+-]+)@([A-Za-z0-9.-]+\.[A-Za-z]{2,})", ("@",),
    secret_group=1, tags=("person",),
)
IPV4 = Rule(
    "ipv4", "IPv4 address", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", (".",),
    tags=("network",),
)
CARD = Rule(
    "card", "Card number", r"[0-9]{13,16}", tuple("0123456789"), tags=("person", "payment")
)
LICENCE = Rule("licence", "Licence line", r"[Ll]icen[cs]e", ("icense", "icence"))
TOKEN = Rule(
    "token", "Token", r"""token = "([0-9a-f]{40})\"""", ("token",), secret_group=1, entropy=3.7
)
USER = RuleSet((EMAIL, IPV4, CARD, LICENCE, TOKEN))
STOCK = stock_rules(stock_stopwords())
STOCK_OPEN = STOCK.without_rule_allowlists()
STOCK_OWN_STOPWORDS = STOCK.with_stopwords("generic-api-key", ["ff", "00"])
HISTORY_ALLOW = Allowlist(
    paths=STOCK.allowlist.paths + ("/src3/de", "/src5"),
)
HISTORY = replace(USER, allowlist=HISTORY_ALLOW)


def _with_global(**kw) -> RuleSet:
    return replace(USER, allowlist=Allowlist(**kw))


def _with_rule(rule: Rule, **kw) -> RuleSet:
    return RuleSet(
        tuple(replace(r, allowlist=Allowlist(**kw)) if r is rule else r for r in USER.rules)
    )


def _file_scan_sql(rules: RuleSet) -> str:
    return with_(M.FILES, matches_ctes(rules)) + file_leaks()


def _file_scan(rules: RuleSet) -> Query:
    return lambda spark, sf: scan_files(M.files(spark, sf), rules)


# ---------------------------------------------------- scans of files

GLOBAL_LINE = _with_global(regex_target="line", regexes=(r"^Released under", r"token = "))
GLOBAL_MATCH = _with_global(regexes=(r"\.example\.com$", r"^[0-9]{13}$", r"^4"))
RULE_LINE = _with_rule(CARD, regex_target="line", stopwords=("token", "Osb"))
RULE_MATCH = _with_rule(EMAIL, regex_target="match", stopwords=("mail5", ".net"))
BOTH_LISTS = _with_global(regexes=(r"[0-9]",), stopwords=("icense",))

for _name, _rules in {
    "scan_user_rules": USER,
    "scan_stock_catalog": STOCK_OPEN,
    "scan_stock_with_allowlists": STOCK,
    "scan_stock_own_stopwords": STOCK_OWN_STOPWORDS,
    "allow_global_line": GLOBAL_LINE,
    "allow_global_match": GLOBAL_MATCH,
    "allow_rule_line": RULE_LINE,
    "allow_rule_match": RULE_MATCH,
    "allow_both_lists_cancel": BOTH_LISTS,
}.items():
    query(_file_scan_sql(_rules), _name)(_file_scan(_rules))


# Each text gets an assignment that the generic rule finds; in every other one the value
# holds a stopword.
_WORDS = ("sample", "Sample", "changeme", "example", "dummi", "wxyz")
_ASSIGNED = """
files AS (SELECT concat('/', doc_id) AS path, concat(text, chr(10), 'api_key = "',
  (%s)[1 + doc_id %% %d], substr(md5(CAST(doc_id AS VARCHAR)), 1, 20), '"') AS content
  FROM documents)""" % ("[" + ", ".join(map(quote, _WORDS)) + "]", len(_WORDS))


@query(with_(_ASSIGNED, matches_ctes(STOCK)) + file_leaks())
def scan_stock_stopwords(spark, sf):
    word = F.get(F.array(*map(F.lit, _WORDS)), (F.col("doc_id") % len(_WORDS)).cast("int"))
    value = F.concat(word, F.left(F.md5(F.col("doc_id").cast("string")), F.lit(20)))
    files = M.table(spark, sf, "documents").select(
        F.concat(F.lit("/"), "doc_id").alias("path"),
        F.concat("text", F.lit('\napi_key = "'), value, F.lit('"')).alias("content"),
    )
    return scan_files(files, STOCK)


# The stock allowlists in a history: path patterns prune pictures and documents, stopwords
# drop every other value, and what is left is reported.
_ASSIGNED_BLOBS = """
blobs AS (SELECT DISTINCT blob_id, concat(content, chr(10), 'api_key = "',
  (%s)[1 + strlen(content) %% %d], substr(blob_id, 1, 20), '"') AS content FROM files)""" % (
    "[" + ", ".join(map(quote, _WORDS)) + "]", len(_WORDS),
)
_STOCK_PATHS = " OR ".join(
    f"regexp_matches(p, {quote(e)})" if e.startswith("(") and e.endswith("$") else f"p = {quote(e)}"
    for e in STOCK.allowlist.paths
)
_STOCK_KEPT = f"""
pruned AS (SELECT DISTINCT path FROM (
    SELECT path, array_to_string(parts[1:i], '/') AS p FROM (
      SELECT path, parts, unnest(range(2, len(parts) + 1)) AS i
      FROM (SELECT DISTINCT path, string_split(path, '/') AS parts FROM files)))
  WHERE {_STOCK_PATHS} OR regexp_matches(path, '(^|/)\\.')),
kept AS (SELECT * FROM entries WHERE path NOT IN (SELECT path FROM pruned))"""


@query(
    with_(
        M.FILES, M.COMMITS, M.ENTRIES, _ASSIGNED_BLOBS, _STOCK_KEPT,
        matches_ctes(STOCK, "blobs", "blob_id"),
    )
    + history_leaks()
)
def scan_stock_allowlists_history(spark, sf):
    word = F.get(F.array(*map(F.lit, _WORDS)), (F.octet_length("content") % len(_WORDS)).cast("int"))
    value = F.concat(word, F.left("blob_id", F.lit(20)))
    blobs = M.texts(spark, sf).withColumn(
        "content", F.concat("content", F.lit('\napi_key = "'), value, F.lit('"'))
    )
    return scan_history(
        M.commits(spark, sf), M.entries(spark, sf), blobs, STOCK, unique_blobs=False
    )


_SOURCE_FILES = """
files AS (SELECT concat('/', source) AS path, string_agg(concat(text, chr(10)), '' ORDER BY doc_id) AS content
  FROM documents GROUP BY source)"""


@query(with_(_SOURCE_FILES, matches_ctes(USER)) + file_leaks())
def scan_chunked_files(spark, sf):
    """All texts of a source as one file, read in chunks: one of the files is most of all."""
    docs = M.spread(M.table(spark, sf, "documents").select("doc_id", "source", "text"), "doc_id")
    chunks = docs.select(
        F.concat(F.lit("/"), "source").alias("path"), F.col("doc_id").alias("seq"),
        F.concat("text", F.lit("\n")).alias("content"),
    )
    return scan_chunks(chunks, USER)


@query(with_(_SOURCE_FILES, matches_ctes(STOCK_OPEN)) + file_leaks())
def scan_chunked_files_stock(spark, sf):
    """The same with 149 rules: one that any chunk of a file calls runs on all of them."""
    docs = M.spread(M.table(spark, sf, "documents").select("doc_id", "source", "text"), "doc_id")
    chunks = docs.select(
        F.concat(F.lit("/"), "source").alias("path"), F.col("doc_id").alias("seq"),
        F.concat("text", F.lit("\n")).alias("content"),
    )
    return scan_chunks(chunks, STOCK_OPEN)


# Twelve keywords call the automaton, one searches; both must give these rows. The
# separators are those on which engines differ; RE2 classes name them all here.
_SPACED = Rule("spaced", "Spaced", r"(?i)marks[\s|']{0,2}=[0-9]{3}", ("marks", "mark\u017f", "MARKS", "mar"))
SPACED = RuleSet((_SPACED, *(Rule(f"r{i}", f"R{i}", f"zq{i}x", (f"zq{i}",)) for i in range(12))))
_SEPARATORS = (" ", "\t", "\x0b", "\x0c", "\u00a0", "\u2003", "x", "'")
_MARKS = ("marks", "MARKS", "mar\u212as", "mark\u017f", "mar\u0131ks")
_SPACED_FILES = """
spaced AS (SELECT concat('/', doc_id) AS path, concat(text, chr(10),
  (%s)[1 + doc_id %% %d], (%s)[1 + doc_id // 5 %% %d], '=', 100 + doc_id %% 900, chr(10)) AS content
  FROM documents)""" % (
    "[" + ", ".join(map(quote, _MARKS)) + "]", len(_MARKS),
    "[" + ", ".join(map(quote, _SEPARATORS)) + "]", len(_SEPARATORS),
)
_SPACED_MATCH = r"(?i)marks[\t\n\x0b\f\r \x{85}\x{a0}\x{2003}|']{0,2}=[0-9]{3}"


@query(
    with_(_SPACED_FILES)
    + f"""SELECT mode, path, regexp_extract(content, {quote(_SPACED_MATCH)}) AS match
FROM spaced, (VALUES ('automaton'), ('search')) m(mode)
WHERE regexp_matches(content, {quote(_SPACED_MATCH)})
  AND regexp_matches(content, 'mar|MARKS|mark\u017f')"""
)
def prefilter_modes_agree(spark, sf):
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    doc = F.col("doc_id")
    content = F.concat(
        "text", F.lit("\n"), pick(_MARKS, doc % len(_MARKS)),
        pick(_SEPARATORS, F.floor(doc / 5) % len(_SEPARATORS)), F.lit("="),
        (doc % 900 + 100).cast("string"), F.lit("\n"),
    )
    files = M.table(spark, sf, "documents").select(
        F.concat(F.lit("/"), "doc_id").alias("path"), content.alias("content")
    )
    found = [
        D.match_rules(files, SPACED, options=D.DetectOptions(prefilter=mode))
        .filter("rule_pos = 0")
        .select(F.lit(mode).alias("mode"), "path", "match")
        for mode in ("automaton", "search")
    ]
    return found[0].unionByName(found[1])


@query(
    with_(
        """
files AS (SELECT concat('/', conv_id, '/', turn) AS path, text AS content FROM conversations
  UNION ALL SELECT concat('/page/', page_id), html FROM pages
  UNION ALL SELECT concat('/item/', item_id), text FROM benchmark)""",
        matches_ctes(USER),
    )
    + file_leaks()
)
def scan_other_corpora(spark, sf):
    t = lambda n: M.table(spark, sf, n)
    files = (
        t("conversations")
        .select(
            F.concat(F.lit("/"), "conv_id", F.lit("/"), "turn").alias("path"),
            F.col("text").alias("content"),
        )
        .unionByName(
            t("pages").select(
                F.concat(F.lit("/page/"), "page_id").alias("path"), F.col("html").alias("content")
            )
        )
        .unionByName(
            t("benchmark").select(
                F.concat(F.lit("/item/"), "item_id").alias("path"), F.col("text").alias("content")
            )
        )
    )
    return scan_files(files, USER)


@query(
    with_(M.FILES, rules_cte(STOCK))
    + """SELECT DISTINCT f.path, r.id AS rule_id FROM files f JOIN word w
  ON contains(f.content, w.keyword) JOIN rule r ON r.rule_pos = w.rule_pos"""
)
def keyword_prefilter(spark, sf):
    pairs = D.keyword_pairs(M.files(spark, sf), STOCK)
    return pairs.select("path", D.rule_value(STOCK, "id").alias("rule_id"))


@query(
    with_(M.FILES)
    + """SELECT f.path, CAST(c_custkey AS INTEGER) AS pos FROM files f JOIN customer c
  ON contains(f.content, lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0')) OR contains(f.content, c_mktsegment)"""
)
def keyword_prefilter_table(spark, sf):
    """A rule per customer: keywords of four digits and the segment's name."""
    key = F.col("c_custkey")
    rules = M.table(spark, sf, "customer").select(
        key.cast("int").alias("pos"),
        F.array(F.lpad((key % 10000).cast("string"), 4, "0"), F.col("c_mktsegment")).alias("keywords"),
    )
    return keyword_pairs_of_table(M.files(spark, sf), rules)


@query(
    with_(M.FILES, rules_cte(STOCK))
    + """SELECT DISTINCT f.path, r.id AS rule_id FROM files f JOIN word w
  ON contains(lower(f.content), w.keyword) JOIN rule r ON r.rule_pos = w.rule_pos"""
)
def keyword_ci(spark, sf):
    pairs = D.keyword_pairs(
        M.files(spark, sf), STOCK, options=D.DetectOptions(ignore_keyword_case=True)
    )
    return pairs.select("path", D.rule_value(STOCK, "id").alias("rule_id"))


@query(
    with_(
        """
texts AS (SELECT concat('d', doc_id) AS id, text AS content FROM documents
  UNION ALL SELECT concat('p', page_id), html FROM pages
  UNION ALL SELECT concat('w', doc_id), replace(text, chr(10), chr(13) || chr(10)) FROM documents)""",
        lines_cte("texts", "id"),
    )
    + "SELECT id, line_number, line FROM lines"
)
def line_split(spark, sf):
    docs, pages = M.table(spark, sf, "documents"), M.table(spark, sf, "pages")
    texts = (
        docs.select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("text").alias("content"))
        .unionByName(
            pages.select(F.concat(F.lit("p"), "page_id").alias("id"), F.col("html").alias("content"))
        )
        .unionByName(
            docs.select(
                F.concat(F.lit("w"), "doc_id").alias("id"),
                F.replace("text", F.lit("\n"), F.lit("\r\n")).alias("content"),
            )
        )
    )
    return texts.select("id", F.posexplode_outer(text.lines("content")).alias("at", "line")).filter(
        "line IS NOT NULL"
    ).select("id", (F.col("at") + 1).cast("int").alias("line_number"), "line")


@query(
    with_(M.FILES, lines_cte("files", "path"))
    + """SELECT path, line_number, regexp_extract(line, '[A-Z][a-z]*') AS match FROM lines
WHERE regexp_matches(line, '[A-Z][a-z]*')"""
)
def first_match_per_line(spark, sf):
    return (
        M.files(spark, sf)
        .select("path", F.posexplode_outer(text.lines("content")).alias("at", "line"))
        .select(
            "path",
            (F.col("at") + 1).cast("int").alias("line_number"),
            text.first_match("line", text.java_pattern("[A-Z][a-z]*")).alias("match"),
        )
        .filter("match IS NOT NULL")
    )


ANY = ("^The ", "[0-9]{16}", "(?i)licen[cs]e")


@query(
    f"""SELECT doc_id, ({' OR '.join(f"regexp_matches(text, {quote(p)})" for p in ANY)}) AS matched
FROM documents"""
)
def any_regex_match(spark, sf):
    return M.table(spark, sf, "documents").select(
        "doc_id", text.matches_any(F.col("text"), ANY).alias("matched")
    )


@query(
    with_(M.FILES, matches_ctes(USER))
    + """SELECT path, line_number, line, match FROM matches a WHERE NOT EXISTS (
  SELECT 1 FROM matches b WHERE contains(b.line, 'License') AND b.path = a.path
  AND b.line_number = a.line_number AND b.line = a.line AND b.match = a.match)"""
)
def anti_set(spark, sf):
    found = D.match_rules(M.files(spark, sf), USER)
    listed = found.filter(F.contains("line", F.lit("License")))
    columns = ["path", "line_number", "line", "match"]
    return D.anti_set(found.select(*columns), listed, columns)


# ----------------------------------------------------- rule allowlists on files

RULE_PATH = _with_rule(LICENCE, paths=("(.*)(pdf|jpg)$", "/src0/en/0.jpg"))
_ONE_COMMIT_SQL = (
    "(SELECT commit FROM commits WHERE repo = 'view' AND pos ="
    " (SELECT min(pos) FROM commits WHERE repo = 'view'))"
)


@query(
    with_(M.FILES, matches_ctes(RULE_PATH))
    + file_leaks()
    + " WHERE NOT (m.rule_pos = 3 AND (regexp_matches(m.path, '(.*)(pdf|jpg)$')"
    " OR m.path = '/src0/en/0.jpg'))"
)
def allow_rule_path(spark, sf):
    return scan_files(M.files(spark, sf), RULE_PATH)


# Patterns with a top-level branch, a named group and a bracketed class.
PATTERNS = ("(/src1)|(jpg)$", "(?P<part>/src2/[[:alpha:]]{2})$", "(/src[[:digit:]])$", "/src15")
_PATTERN_TESTS = " OR ".join(f"regexp_matches(p, {quote(e)})" for e in PATTERNS[:3])
RULE_PATTERNS = _with_rule(LICENCE, paths=PATTERNS)


@query(
    with_(M.FILES)
    + f"""SELECT path, bool_or({_PATTERN_TESTS} OR p = '/src15') AS pruned FROM (
  SELECT path, array_to_string(parts[1:i], '/') AS p FROM (
    SELECT path, parts, unnest(range(2, len(parts) + 1)) AS i
    FROM (SELECT path, string_split(path, '/') AS parts FROM files))) GROUP BY path"""
)
def prune_path_patterns(spark, sf):
    return M.files(spark, sf).select("path", P.path_pruned("path", PATTERNS).alias("pruned"))


@query(
    with_(M.FILES, matches_ctes(RULE_PATTERNS))
    + file_leaks()
    + f" WHERE NOT (m.rule_pos = 3 AND ({_PATTERN_TESTS.replace('(p,', '(m.path,')}))"
)
def allow_rule_path_patterns(spark, sf):
    return scan_files(M.files(spark, sf), RULE_PATTERNS)


# md5 of event ids; the derived commits carry such ids.
_LISTED_COMMITS = (
    "c4ca4238a0b923820dcc509a6f75849b",
    "c81e728d9d4c2f636f067f89cc14862c",
    "eccbc87e4b5ce2fe28308fd9f2a7baf3",
)
RULE_COMMIT = _with_rule(EMAIL, commits=_LISTED_COMMITS)
GLOBAL_COMMIT = replace(HISTORY, allowlist=replace(HISTORY_ALLOW, commits=_LISTED_COMMITS))

# A path is pruned with any of its folders; each is tested on its own here.
PRUNED = """
pruned AS (SELECT DISTINCT path FROM (
    SELECT path, array_to_string(parts[1:i], '/') AS p FROM (
      SELECT path, parts, unnest(range(2, len(parts) + 1)) AS i
      FROM (SELECT DISTINCT path, string_split(path, '/') AS parts FROM files)))
  WHERE %s OR regexp_matches(path, '(^|/)\\.'))""" % " OR ".join(
    f"regexp_matches(p, {quote(e)})" if e.startswith("(") else f"p = {quote(e)}"
    for e in HISTORY_ALLOW.paths
)
_PRUNED_SQL = "path IN (SELECT path FROM pruned)"
KEPT = f"""{PRUNED},
kept AS (SELECT * FROM entries WHERE NOT {_PRUNED_SQL})"""
_HISTORY_CTES = (M.FILES, M.COMMITS, M.ENTRIES, M.BLOBS, KEPT)


def _history(spark, sf, rules, commits=None, narrowed=False, **kw):
    return scan_history(
        M.commits(spark, sf) if commits is None else commits,
        M.entries(spark, sf), M.texts(spark, sf), rules, narrowed=narrowed,
        unique_blobs=False, **kw,
    )


def _in(ids) -> str:
    return "(" + ", ".join(quote(i) for i in ids) + ")"


@query(with_(*_HISTORY_CTES, matches_ctes(HISTORY, "blobs", "blob_id")) + history_leaks())
def scan_history_all(spark, sf):
    return _history(spark, sf, HISTORY)


@query(
    with_(*_HISTORY_CTES, matches_ctes(STOCK_OPEN, "blobs", "blob_id")) + history_leaks()
)
def scan_history_stock(spark, sf):
    return _history(spark, sf, replace(STOCK_OPEN, allowlist=HISTORY_ALLOW))


_BRANCH = """
chosen AS (SELECT c.* FROM refs r JOIN commits c ON c.repo = r.repo AND c.commit = r.commit
  WHERE contains(r.ref_name, 'view/'))"""


@query(
    with_(*_HISTORY_CTES, M.REFS, _BRANCH, matches_ctes(HISTORY, "blobs", "blob_id"))
    + history_leaks(commits="chosen")
)
def scan_history_branch(spark, sf):
    leaks, _ = scan(
        Selection(branch="view/"), HISTORY, M.commits(spark, sf), M.entries(spark, sf),
        M.texts(spark, sf), M.refs(spark, sf), unique_blobs=False,
    )
    return leaks


_CHOSEN_COMMIT = "aab3238922bcc25a6f606eb525ffdc56"
_CHOSEN = """
chosen AS (SELECT * FROM commits WHERE commit = %s)""" % quote(_CHOSEN_COMMIT)


@query(
    with_(*_HISTORY_CTES, _CHOSEN, matches_ctes(HISTORY, "blobs", "blob_id"))
    + history_leaks(commits="chosen")
)
def scan_commit(spark, sf):
    leaks, _ = scan(
        Selection(commit=_CHOSEN_COMMIT), HISTORY, M.commits(spark, sf), M.entries(spark, sf),
        M.texts(spark, sf), unique_blobs=False,
    )
    return leaks


@query(
    with_(*_HISTORY_CTES, matches_ctes(RULE_COMMIT, "blobs", "blob_id"))
    + history_leaks(entries="entries")
    + f" WHERE NOT (m.rule_pos = 0 AND c.commit IN {_in(_LISTED_COMMITS)})"
    " AND NOT regexp_matches(e.path, '(^|/)\\.')"
)
def allow_rule_commit(spark, sf):
    return _history(spark, sf, RULE_COMMIT)


# ------------------------------------------------------------- pruning


@query(
    with_(M.FILES, M.ENTRIES, PRUNED)
    + f"SELECT repo, commit, path, blob_id FROM entries WHERE NOT {_PRUNED_SQL}"
)
def prune_paths(spark, sf):
    return P.prune_entries(M.entries(spark, sf), HISTORY_ALLOW)


@query(
    with_(M.FILES, M.ENTRIES, PRUNED)
    + f"SELECT repo, commit, path, blob_id FROM entries WHERE NOT {_PRUNED_SQL}"
)
def prune_nested_trees(spark, sf):
    commits, nested = M.nested_trees(spark, sf)
    return trees.entries_from_trees(commits, nested, HISTORY_ALLOW)


# A list that grows with the corpus: some files and some folders of it.
_LISTED = """
listed AS (SELECT path FROM files WHERE path LIKE '%.pdf' UNION
  SELECT regexp_replace(path, '/[^/]*$', '') FROM files WHERE path LIKE '%/src3/%' OR path LIKE '%/.cache/%'),
hit AS (SELECT DISTINCT path FROM (
    SELECT path, array_to_string(parts[1:i], '/') AS p FROM (
      SELECT path, parts, unnest(range(2, len(parts) + 1)) AS i
      FROM (SELECT DISTINCT path, string_split(path, '/') AS parts FROM files)))
  WHERE p IN (SELECT path FROM listed))"""


@query(
    with_(M.FILES, M.ENTRIES, _LISTED)
    + "SELECT repo, commit, path, blob_id FROM entries WHERE path NOT IN (SELECT path FROM hit)"
)
def prune_listed_paths(spark, sf):
    paths = M.files(spark, sf).select("path")
    folders = paths.filter("path LIKE '%/src3/%' OR path LIKE '%/.cache/%'").select(
        F.regexp_replace("path", "/[^/]*$", "").alias("path")
    )
    listed = paths.filter("path LIKE '%.pdf'").union(folders)
    return P.prune_listed(M.entries(spark, sf), listed)


@query(
    with_(M.FILES)
    + "SELECT path, regexp_matches(path, '(^|/)\\.') AS dotted FROM files"
)
def prune_dot_paths(spark, sf):
    return M.files(spark, sf).select("path", P.has_dot_part("path").alias("dotted"))


@query(
    with_(M.FILES, M.ENTRIES, PRUNED)
    + f"""SELECT repo, commit, path, blob_id FROM entries
WHERE NOT {_PRUNED_SQL} AND commit NOT IN {_in(_LISTED_COMMITS)}"""
)
def prune_commits(spark, sf):
    return P.prune_entries(M.entries(spark, sf), GLOBAL_COMMIT.allowlist)


# ------------------------------------------------------ commit selection

_FIELDS = "repo, commit, author, email, commit_message, offset_minutes, pos"
_COLUMNS = _FIELDS.split(", ")


def _commit_query(name: str, where: str, pick, ctes: tuple[str, ...] = ()) -> None:
    sql = with_(M.COMMITS, *ctes) + f"SELECT {_FIELDS} FROM commits {where}"
    query(sql, name)(lambda spark, sf: pick(spark, sf, M.commits(spark, sf)).select(*_COLUMNS))


_ONE, _TWO, _THREE = _LISTED_COMMITS
_commit_query(
    "commit_single", f"WHERE commit = {quote(_ONE)}", lambda s, sf, c: C.single(c, _ONE)
)
_commit_query("commit_author", "WHERE author = 'user7'", lambda s, sf, c: C.by_author(c, "user7"))
_commit_query("commit_all", "", lambda s, sf, c: C.all_commits(c))
_commit_query(
    "commit_time_range",
    "WHERE commit_ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 23:59:59'",
    lambda s, sf, c: C.in_time_range(c, "2024-01-10", "2024-01-12"),
)
_commit_query(
    "commit_time_range_instants",
    "WHERE commit_ts BETWEEN TIMESTAMP '2024-01-10 04:00:00' AND TIMESTAMP '2024-01-11 10:30:00'"
    " AND author = 'user7'",
    lambda s, sf, c: C.in_time_range(
        c, "2024-01-10T12:00:00+08:00", "2024-01-11T10:30:00Z", "user7"
    ),
)
_commit_query(
    "commit_excluded",
    "WHERE commit_ts BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-01-31 23:59:59'"
    " AND commit NOT IN (SELECT commit FROM refs)",
    lambda s, sf, c: C.in_time_range(c, "2024-01-01", "2024-01-31", excluded=M.refs(s, sf)),
    (M.REFS,),
)
_commit_query(
    "commit_precedence",
    "WHERE commit_ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-06 23:59:59'",
    lambda s, sf, c: select_commits(
        c, M.refs(s, sf), Selection(since="2024-01-05", until="2024-01-06", branch="view")
    ),
)
_commit_query(
    "commit_no_user_ignores_selectors",
    "",
    lambda s, sf, c: select_commits(c, None, Selection(commit=_ONE, user=None)),
)


def _listed_ids(spark, sf):
    tips = M.refs(spark, sf)
    return tips.select("commit").unionByName(tips.filter("repo = 'view'").select("commit"))


_LISTED_SQL = """
ids AS (SELECT commit FROM refs UNION ALL SELECT commit FROM refs WHERE repo = 'view')"""
_JOINED = f"SELECT {', '.join('c.' + c for c in _COLUMNS)} FROM "


@query(with_(M.COMMITS, M.REFS, _LISTED_SQL) + _JOINED + "ids i JOIN commits c USING (commit)")
def commit_list(spark, sf):
    return C.listed(M.commits(spark, sf), _listed_ids(spark, sf)).select(*_COLUMNS)


@query(with_(M.COMMITS, M.REFS, _LISTED_SQL) + _JOINED + "ids i JOIN commits c USING (commit)")
def commit_file(spark, sf):
    """The lines of an id file, with the CR that some of them end with."""
    lines = _listed_ids(spark, sf).select(
        F.when(F.col("commit") < "8", F.concat("commit", F.lit("\r"))).otherwise(F.col("commit")).alias("value")
    )
    return C.listed(M.commits(spark, sf), C.ids_of_lines(lines)).select(*_COLUMNS)


# A mirror shares the commits of one repository and counts from another place.
_RANGE_SQL = """
ends AS (SELECT md5(CAST(max(CASE WHEN user_id = 3 THEN event_id END) AS VARCHAR)) AS newer,
  md5(CAST(min(CASE WHEN user_id = 5 THEN event_id END) AS VARCHAR)) AS older
  FROM events WHERE event_type = 'click'),
stored AS (SELECT * FROM commits UNION ALL
  SELECT * REPLACE ('mirror' AS repo, pos + 1000 AS pos) FROM commits WHERE repo = 'click')"""


@query(
    with_(M.COMMITS, _RANGE_SQL)
    + f"""SELECT {', '.join('c.' + c for c in _COLUMNS)} FROM stored c
JOIN stored a ON a.repo = c.repo AND a.commit = (SELECT newer FROM ends)
JOIN stored b ON b.repo = c.repo AND b.commit = (SELECT older FROM ends)
WHERE c.pos BETWEEN a.pos AND b.pos"""
)
def commit_id_range(spark, sf):
    e = M.table(spark, sf, "events").filter("event_type = 'click'")
    end = lambda pick, user: e.agg(
        F.md5(pick(F.when(F.col("user_id") == user, F.col("event_id"))).cast("string"))
    ).scalar()
    commits = M.commits(spark, sf)
    mirror = commits.filter("repo = 'click'").withColumns(
        {"repo": F.lit("mirror"), "pos": F.col("pos") + 1000}
    )
    both = commits.unionByName(mirror)
    return C.in_id_range(both, end(F.max, 3), end(F.min, 5)).select(*_COLUMNS)


@query(
    with_(M.COMMITS, M.REFS)
    + _JOINED
    + "refs r JOIN commits c ON c.repo = r.repo AND c.commit = r.commit"
    " WHERE contains(r.ref_name, 'view/1')"
)
def commit_branch_tips(spark, sf):
    return C.branch_tips(M.commits(spark, sf), M.refs(spark, sf), "view/1").select(*_COLUMNS)


@query(
    f"""WITH RECURSIVE {M.COMMITS.strip()},{M.PARENTS},
way(commit, level) AS (SELECT commit, CAST(0 AS BIGINT) FROM commits
    WHERE commit NOT IN (SELECT parent FROM parents)
  UNION SELECT p.parent, w.level + 1 FROM way w JOIN parents p ON p.commit = w.commit),
levels AS (SELECT commit, max(level) AS level FROM way GROUP BY commit)
SELECT 'all' AS repo, l.commit,
  row_number() OVER (ORDER BY l.level, c.commit_ts DESC, l.commit) - 1 AS pos
FROM levels l JOIN commits c ON c.commit = l.commit"""
)
def commit_topological_pos(spark, sf):
    """Every parent is newer than its child here, so the places follow the levels."""
    one = M.commits(spark, sf).withColumn("repo", F.lit("all"))
    return C.topological_positions(one, M.parents(spark, sf))


@query(
    with_(M.COMMITS)
    + """SELECT repo, commit, row_number() OVER (PARTITION BY repo
  ORDER BY commit_ts DESC, place) - 1 AS pos
FROM (SELECT commit, commit_ts, pos AS place, unnest(['fork', 'main']) AS repo FROM commits)"""
)
def commit_topological_history(spark, sf):
    """A long line with merges, shared by two repositories; clocks are right but for
    commits of one second, which follow each other."""
    return C.topological_positions(*M.history(spark, sf))


@query(
    f"""WITH RECURSIVE {M.LANES.strip()},
reach(repo, commit) AS (SELECT repo, commit FROM lane_heads
  UNION SELECT r.repo, p.parent FROM reach r JOIN lane_parents p ON p.commit = r.commit)
SELECT c.repo, c.commit, c.author FROM lane_commits c JOIN reach r
  ON r.repo = c.repo AND r.commit = c.commit"""
)
def commit_reachable(spark, sf):
    """Lanes that were merged up to some commit are reached up to there, others not."""
    return C.reachable(*M.lanes(spark, sf)).select("repo", "commit", "author")


@query(
    f"""WITH RECURSIVE {M.LANES.strip()},
reach(repo, commit) AS (SELECT repo, commit FROM lane_heads
  UNION SELECT r.repo, p.parent FROM reach r JOIN lane_parents p ON p.commit = r.commit)
SELECT c.repo, c.commit, c.author FROM lane_commits c JOIN reach r
  ON r.repo = c.repo AND r.commit = c.commit WHERE c.author = 'user7'"""
)
def commit_reachable_author(spark, sf):
    return C.reachable(*M.lanes(spark, sf), user="user7").select("repo", "commit", "author")


@query(
    """SELECT 'one' AS repo, md5(CAST(event_id AS VARCHAR)) AS commit,
  max(event_id) OVER () - event_id AS pos FROM events"""
)
def commit_topological_ties(spark, sf):
    """A line of commits of one second: only the parents tell their order."""
    events = M.table(spark, sf, "events").select("event_id")
    commit = lambda e: F.md5(e.cast("string"))
    commits = events.select(
        F.lit("one").alias("repo"), commit(F.col("event_id")).alias("commit"),
        F.timestamp_seconds(F.lit(1_700_000_000)).alias("commit_ts"),
    )
    parents = events.filter("event_id > 0").select(
        commit(F.col("event_id")).alias("commit"), commit(F.col("event_id") - 1).alias("parent")
    )
    return C.topological_positions(commits, parents)


# ----------------------------------------------------------- sources


@query(
    with_(M.FILES, M.ENTRIES, M.BLOBS)
    + """SELECT e.repo, e.commit, e.path, CAST(length(b.content) AS INTEGER) AS n_chars,
  md5(b.content) AS content_md5 FROM entries e JOIN blobs b USING (blob_id)"""
)
def snapshot_files(spark, sf):
    snap = corpus.snapshot_files(M.entries(spark, sf), M.blobs(spark, sf))
    return snap.select(
        "repo", "commit", "path", F.length("content").alias("n_chars"),
        F.md5("content").alias("content_md5"),
    )


@query(
    with_(M.COMMITS)
    + f"SELECT repo, commit, author, email, commit_message, {DATE_TEXT} AS date FROM commits"
)
def commit_metadata(spark, sf):
    return corpus.commit_metadata(M.commits(spark, sf))


@query(
    """SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', chr(65533), 'g') AS content
FROM documents"""
)
def lossy_decode(spark, sf):
    latin = M.table(spark, sf, "documents").select(
        F.col("doc_id").alias("blob_id"), F.encode("text", "ISO-8859-1").alias("content")
    )
    return corpus.decoded_blobs(latin).withColumnRenamed("blob_id", "doc_id")


@query(
    with_(M.FILES, M.COMMITS, M.ENTRIES, M.BLOBS)
    + """SELECT commit AS object_id FROM commits UNION SELECT blob_id FROM entries
UNION SELECT blob_id FROM blobs"""
)
def object_ids(spark, sf):
    return corpus.object_ids(M.commits(spark, sf), M.entries(spark, sf), M.blobs(spark, sf))


@query(
    with_(M.DECODED)
    + "SELECT path, valid, CAST(length(content) AS INTEGER) AS n_chars, md5(content) AS content_md5"
    " FROM decoded"
)
def working_tree(spark, sf):
    files = corpus.decode_files(M.encoded_files(spark, sf), on_invalid="flag")
    return files.select(
        "path", "valid", F.length("content").alias("n_chars"), F.md5("content").alias("content_md5")
    )


@query(with_(M.DECODED, matches_ctes(USER, "decoded")) + file_leaks())
def working_tree_scan(spark, sf):
    files = corpus.decode_files(M.encoded_files(spark, sf), on_invalid="replace")
    return scan_files(files, USER)


@query(
    with_(M.WORKTREE)
    + """SELECT coalesce(h.path, w.path) AS path, CASE WHEN w.id IS NULL THEN 'deleted'
    WHEN h.id IS NULL THEN 'untracked' ELSE 'modified' END AS state, h.id AS head_id, w.id AS work_id
FROM head h FULL JOIN work w ON w.path = h.path WHERE h.id IS DISTINCT FROM w.id"""
)
def working_tree_status(spark, sf):
    head, files = M.worktree(spark, sf)
    return worktree.status(head, files).select("path", "state", "head_id", "work_id")


@query(
    with_(
        M.WORKTREE,
        """
changed AS (SELECT w.path, w.content FROM work w LEFT JOIN head h ON h.path = w.path
  WHERE h.id IS DISTINCT FROM w.id)""",
        matches_ctes(USER, "changed"),
    )
    + file_leaks()
)
def working_tree_changes_scan(spark, sf):
    head, files = M.worktree(spark, sf)
    changed = corpus.decode_files(worktree.uncommitted(head, files, on_deleted="skip"))
    leaks, _ = scan(
        Selection(uncommitted=True), USER, M.commits(spark, sf), M.entries(spark, sf),
        M.texts(spark, sf), files=changed,
    )
    return leaks


_CONFIG_NAMES = ("page7.toml", ".page11.toml")
_CONFIG_TREES = """
trees AS (SELECT event_type AS repo, md5(CAST(event_id AS VARCHAR)) AS commit,
  concat('/page', page_id, '.toml') AS path, html AS content FROM events e
  JOIN pages p ON p.page_id = e.event_id % 50)"""


@query(
    with_(M.COMMITS, _CONFIG_TREES)
    + """SELECT repo, commit, path, content FROM (
  SELECT t.*, row_number() OVER (PARTITION BY t.repo ORDER BY c.pos // 500, t.path, t.commit) AS n
  FROM trees t JOIN commits c ON c.repo = t.repo AND c.commit = t.commit
  WHERE t.path IN ('/page7.toml', '/page11.toml')) WHERE n = 1"""
)
def config_per_repo(spark, sf):
    """Each repository has its own catalogue; places meet within and between them."""
    trees = M.table(spark, sf, "events").select(
        F.col("event_type").alias("repo"),
        F.md5(F.col("event_id").cast("string")).alias("commit"),
        (F.col("event_id") % 50).alias("blob_id"),
    ).withColumn("path", F.concat(F.lit("/page"), "blob_id", F.lit(".toml")))
    blobs = M.table(spark, sf, "pages").select(
        F.col("page_id").alias("blob_id"), F.col("html").alias("content")
    )
    commits = M.commits(spark, sf).withColumn("pos", F.floor(F.col("pos") / 500))
    return corpus.config_from_corpus(commits, trees, blobs, ("page7.toml", "page11.toml"))


@query(
    with_(
        M.COMMITS,
        """
trees AS (SELECT event_type AS repo, md5(CAST(event_id AS VARCHAR)) AS commit,
  concat('/page', page_id, '.toml') AS path,
  html AS content FROM events e
  JOIN pages p ON p.page_id = e.event_id % (SELECT max(page_id) + 1 FROM pages))""",
    )
    + """SELECT repo, commit, path, content FROM (
  SELECT t.*, row_number() OVER (PARTITION BY t.repo ORDER BY c.pos, t.path) AS n
  FROM trees t JOIN commits c ON c.repo = t.repo AND c.commit = t.commit
  WHERE t.path IN ('/page7.toml', '/.page11.toml')) WHERE n = 1"""
)
def config_from_corpus(spark, sf):
    pages = M.table(spark, sf, "pages")
    count = pages.agg(F.max("page_id") + 1).scalar()
    trees = M.table(spark, sf, "events").select(
        F.col("event_type").alias("repo"),
        F.md5(F.col("event_id").cast("string")).alias("commit"),
        (F.col("event_id") % count).alias("blob_id"),
    ).withColumn("path", F.concat(F.lit("/page"), "blob_id", F.lit(".toml")))
    blobs = pages.select(F.col("page_id").alias("blob_id"), F.col("html").alias("content"))
    return corpus.config_from_corpus(M.commits(spark, sf), trees, blobs, _CONFIG_NAMES)


# ------------------------------------------------------------ functions

_DATE_FORMS = """
forms AS (SELECT event_id, unnest([strftime(ts, '%Y-%m-%d'), strftime(ts, '%Y-%-m-%-d'),
  strftime(ts, '%Y-%m-') || '32', strftime(ts, '%Y-%m-%d %H:%M'), strftime(ts, '%d-%m-%Y')]) AS form
  FROM events)"""


def _date_forms(spark, sf):
    ts = lambda f: F.date_format("ts", f)
    return M.table(spark, sf, "events").select(
        "event_id",
        F.explode(
            F.array(
                ts("yyyy-MM-dd"), ts("yyyy-M-d"), F.concat(ts("yyyy-MM-"), F.lit("32")),
                ts("yyyy-MM-dd HH:mm"), ts("dd-MM-yyyy"),
            )
        ).alias("form"),
    )


@query(
    with_(_DATE_FORMS)
    + """SELECT event_id, form,
  coalesce(strftime(try_strptime(form, '%Y-%m-%d'), '%Y-%m-%d') = form, false) AS valid FROM forms"""
)
def date_valid(spark, sf):
    return _date_forms(spark, sf).select(
        "event_id", "form", dates.is_valid_date("form").alias("valid")
    )


@query(
    """SELECT event_id, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS first_second,
  strftime(date_trunc('day', ts) + INTERVAL 86399 SECOND, '%Y-%m-%d %H:%M:%S') AS last_second
FROM events"""
)
def date_bounds(spark, sf):
    day = F.date_format("ts", "yyyy-MM-dd")
    show = lambda c, n: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(n)
    return M.table(spark, sf, "events").select(
        "event_id",
        show(dates.day_bound(day, "start"), "first_second"),
        show(dates.day_bound(day, "end"), "last_second"),
    )


_INSTANT_FORMS = """
forms AS (SELECT event_id, unnest([strftime(ts, '%Y-%m-%dT%H:%M:%SZ'),
  strftime(ts, '%Y-%m-%dT%H:%M:%S+08:00'), strftime(ts, '%Y-%m-%dT%H:%M:%S-0700'),
  strftime(ts, '%Y-%m-%d'), strftime(ts, '%Y-%m-%dT%H:%M:%S')]) AS form FROM events)"""


@query(
    with_(_INSTANT_FORMS)
    + """SELECT event_id, form, regexp_matches(form,
  '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(Z|[+-][0-9]{2}:[0-9]{2})$') AS valid
FROM forms"""
)
def date_rfc3339(spark, sf):
    ts = lambda f: F.date_format("ts", f)
    second = ts("yyyy-MM-dd'T'HH:mm:ss")
    forms = F.array(
        F.concat(second, F.lit("Z")), F.concat(second, F.lit("+08:00")),
        F.concat(second, F.lit("-0700")), ts("yyyy-MM-dd"), second,
    )
    return M.table(spark, sf, "events").select("event_id", F.explode(forms).alias("form")).select(
        "event_id", "form", dates.is_rfc3339("form").alias("valid")
    )


@query(with_(M.COMMITS) + f"SELECT commit, {DATE_TEXT} AS date FROM commits")
def commit_date_text(spark, sf):
    return M.commits(spark, sf).select(
        "commit", dates.commit_date_text("commit_ts", "offset_minutes").alias("date")
    )


@query(
    """SELECT page_id, kind, nullif(regexp_extract(u, '/([^/]+)\\.git$', 1), '') AS name
FROM (SELECT page_id, 'plain' AS kind, url AS u FROM pages
  UNION ALL SELECT page_id, 'git', url || '.git' FROM pages)"""
)
def repo_name_from_url(spark, sf):
    pages = M.table(spark, sf, "pages")
    urls = pages.select("page_id", F.lit("plain").alias("kind"), F.col("url").alias("u")).unionByName(
        pages.select("page_id", F.lit("git").alias("kind"), F.concat("url", F.lit(".git")).alias("u"))
    )
    return urls.select("page_id", "kind", text.repo_name_from_url("u").alias("name"))


@query(
    with_(M.FILES)
    + """SELECT path, regexp_replace(string_split(path, '/')[-1], '\\.git$', '') AS plain_name,
  string_split(path, '/')[-1] AS git_name FROM files"""
)
def repo_dir_name(spark, sf):
    return M.files(spark, sf).select(
        "path",
        text.repo_dir_name("path").alias("plain_name"),
        text.repo_dir_name(F.concat("path", F.lit(".git"))).alias("git_name"),
    )


@query(
    """SELECT page_id, kind, regexp_matches(u, '(?i)(https?://|www\\.)[^ ]') AS link
FROM (SELECT page_id, 'full' AS kind, url AS u FROM pages
  UNION ALL SELECT page_id, 'bare', regexp_replace(url, '^https?://', '') FROM pages
  UNION ALL SELECT page_id, 'www', regexp_replace(url, '^https?://', 'see www.') FROM pages)"""
)
def is_link(spark, sf):
    pages = M.table(spark, sf, "pages")
    form = lambda kind, u: pages.select("page_id", F.lit(kind).alias("kind"), u.alias("u"))
    urls = (
        form("full", F.col("url"))
        .unionByName(form("bare", F.regexp_replace("url", "^https?://", "")))
        .unionByName(form("www", F.regexp_replace("url", "^https?://", "see www.")))
    )
    return urls.select("page_id", "kind", text.is_link("u").alias("link"))


@query(
    with_(M.FILES)
    + """SELECT path, form, (starts_with(form, '(') AND ends_with(form, '$')) AS regex
FROM (SELECT path, unnest([path, '(' || path, path || '$', '(' || path || ')$']) AS form FROM files)"""
)
def is_regex(spark, sf):
    path = F.col("path")
    forms = F.array(
        path, F.concat(F.lit("("), path), F.concat(path, F.lit("$")),
        F.concat(F.lit("("), path, F.lit(")$")),
    )
    return M.files(spark, sf).select("path", F.explode(forms).alias("form")).select(
        "path", "form", text.is_regex("form").alias("regex")
    )


# -------------------------------------------------- rule catalogue

_RULE_FIELDS = (
    "pos, id, description, regex, keywords, has_allowlist, allow_paths, allow_commits, allow_target,"
    " allow_regexes, allow_stopwords, secret_group, entropy, path, tags"
)
_REST = _RULE_FIELDS.removeprefix("pos, ")
NEW_RULE = Rule(
    "BUILDING", "New rule", "[0-9]+", ("new", "er"), Allowlist(("/p",), ("c1",), "match", ("^9",), ("w", "v")),
    2, 1.5, "x$", ("fresh",),
)
_NEW = (
    "'BUILDING' AS id, 'New rule' AS description, '[0-9]+' AS regex, 'new,er' AS keywords,"
    " true AS has_allowlist, '/p' AS allow_paths, 'c1' AS allow_commits, 'match' AS allow_target,"
    " '^9' AS allow_regexes, 'w,v' AS allow_stopwords, 2 AS secret_group, 1.5::DOUBLE AS entropy,"
    " 'x$' AS path, 'fresh' AS tags"
)


def _show_rules(rules: DataFrame) -> DataFrame:
    joined = lambda c: F.array_join(c, ",")
    allow = F.col("allowlist")
    return rules.select(
        "pos", "id", "description", "regex", joined("keywords").alias("keywords"),
        allow.isNotNull().alias("has_allowlist"),
        joined(allow["paths"]).alias("allow_paths"), joined(allow["commits"]).alias("allow_commits"),
        allow["regex_target"].alias("allow_target"), joined(allow["regexes"]).alias("allow_regexes"),
        joined(allow["stopwords"]).alias("allow_stopwords"),
        "secret_group", "entropy", "path", joined("tags").alias("tags"),
    )


@query(with_(M.RULES) + f"SELECT {_RULE_FIELDS} FROM rules")
def rules_list(spark, sf):
    return _show_rules(R.list_rules(M.rules(spark, sf)))


@query(
    with_(M.RULES)
    + f"""SELECT {_RULE_FIELDS} FROM rules
UNION ALL SELECT CAST((SELECT max(pos) + 1 FROM rules) AS INTEGER) AS pos, {_NEW}"""
)
def rules_append(spark, sf):
    return _show_rules(R.append_rule(M.rules(spark, sf), NEW_RULE))


@query(with_(M.RULES) + f"SELECT {_RULE_FIELDS} FROM rules WHERE id <> 'BUILDING'")
def rules_delete(spark, sf):
    return _show_rules(R.delete_rules(M.rules(spark, sf), "BUILDING"))


@query(
    with_(M.RULES)
    + f"""SELECT {_RULE_FIELDS} FROM rules
WHERE pos <> (SELECT min(pos) FROM rules WHERE id = 'BUILDING')
UNION ALL SELECT (SELECT min(pos) FROM rules WHERE id = 'BUILDING') AS pos, {_NEW}"""
)
def rules_update(spark, sf):
    return _show_rules(R.update_rule(M.rules(spark, sf), "BUILDING", NEW_RULE))


@query(
    with_(M.RULES)
    + f"""SELECT {_RULE_FIELDS} FROM rules WHERE id = 'BUILDING'
UNION ALL SELECT CAST(pos + 1 + (SELECT max(pos) FROM rules WHERE id = 'BUILDING') AS INTEGER),
  {_REST} FROM rules WHERE id <> 'BUILDING'"""
)
def rules_extend(spark, sf):
    rules = M.rules(spark, sf)
    return _show_rules(R.extend(rules.filter("id = 'BUILDING'"), rules))


# ------------------------------------------------------------- reports

@query(
    with_(M.FILES, matches_ctes(USER))
    + """SELECT to_json({'line': line, 'line_number': line_number, 'offender': offender,
  'commit': commit, 'repo': repo, 'rule': rule, 'commit_message': commit_message,
  'author': author, 'email': email, 'file': file, 'date': date})::VARCHAR AS json FROM ("""
    + file_leaks()
    + ")"
)
def report_json(spark, sf):
    return report.json_rows(scan_files(M.files(spark, sf), USER))


def _csv_field(column: str) -> str:
    v = f"CAST({column} AS VARCHAR)"
    return (
        f"CASE WHEN regexp_matches({v}, '[\",\\n\\r]') THEN '\"' || replace({v}, '\"', '\"\"') || '\"'"
        f" ELSE {v} END"
    )


@query(
    with_(M.FILES, matches_ctes(USER))
    + f"SELECT {' || chr(44) || '.join(_csv_field(c) for c in LEAK_COLUMNS)} AS csv FROM ("
    + file_leaks()
    + ")"
)
def report_csv(spark, sf):
    return report.csv_lines(scan_files(M.files(spark, sf), USER))


@query(
    with_(M.FILES, matches_ctes(USER))
    + """SELECT to_json({'message': {'text': rule || ' detected!'}, 'properties': {'commit': commit,
  'offender': offender, 'date': date, 'author': author, 'email': email,
  'commitMessage': commit_message, 'repo': repo}, 'locations': [{'physicalLocation': {
  'artifactLocation': {'uri': file}, 'region': {'startLine': line_number,
  'snippet': {'text': line}}}}]})::VARCHAR AS json FROM ("""
    + file_leaks()
    + ")"
)
def report_sarif(spark, sf):
    return report.sarif_rows(scan_files(M.files(spark, sf), USER))


@query(
    with_(M.FILES, matches_ctes(USER))
    + "SELECT rule, count(*) AS n, count(*) AS n_ids, true AS above FROM ("
    + file_leaks()
    + ") GROUP BY rule UNION ALL SELECT 'all', count(*), count(*), true FROM ("
    + file_leaks()
    + ")"
)
def report_table(spark, sf):
    """Ids are unique, over all rules and within each, and above the last one."""
    rows = report.with_ids(scan_files(M.files(spark, sf), USER), after=1000)
    shown = [
        F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_ids"),
        (F.min("id") > 1000).alias("above"),
    ]
    return rows.groupBy("rule").agg(*shown).unionByName(
        rows.groupBy(F.lit("all").alias("rule")).agg(*shown)
    )


@query(
    with_(M.FILES, matches_ctes(USER))
    + f"SELECT *, 'first' AS run FROM ({file_leaks()}) UNION ALL SELECT *, 'second' FROM ({file_leaks()})"
)
def report_append_once(spark, sf):
    """Two runs, each written twice: every leak is there once a run."""
    leaks = scan_files(M.files(spark, sf), USER)
    path = f"{shared_folder(spark).rstrip('/')}/leaksieve/{spark.sparkContext.applicationId}/table-{uuid4().hex}"
    for run in ("first", "second", "first", "second"):
        append_once(leaks, path, run)
    return read_appended(spark, path).drop("id")


@query(
    with_(*_HISTORY_CTES, matches_ctes(HISTORY, "blobs", "blob_id"))
    + f"""SELECT (SELECT count(*) FROM ({history_leaks()})) AS leaks_number,
  (SELECT count(*) FROM commits) AS commits_number"""
)
def scan_summary(spark, sf):
    leaks, chosen = scan(
        Selection(), HISTORY, M.commits(spark, sf), M.entries(spark, sf), M.texts(spark, sf),
        unique_blobs=False,
    )
    return summary(leaks, chosen)


# --------------------------------------------------------------- opt-in


@query(
    with_(M.FILES, matches_ctes(USER))
    + "SELECT path, line_number, rule_pos, match, secret FROM matches"
)
def secret_group(spark, sf):
    found = D.match_rules(M.files(spark, sf), USER, options=D.DetectOptions(secrets=True))
    return found.select("path", "line_number", "rule_pos", "match", "secret")


@query(
    with_(M.FILES, matches_ctes(USER))
    + """SELECT path, line_number, rule_pos, secret FROM matches WHERE rule_pos <> 4
OR list_entropy(regexp_extract_all(secret, '.')) >= 3.7"""
)
def entropy_filter(spark, sf):
    found = D.match_rules(
        M.files(spark, sf), USER, options=D.DetectOptions(secrets=True, entropy=True)
    )
    return found.select("path", "line_number", "rule_pos", "secret")


@query(
    """SELECT conv_id, turn, round(coalesce(list_entropy(regexp_extract_all(role, '.')), 0), 6) AS role_entropy,
  round(coalesce(list_entropy(regexp_extract_all(replace(text, chr(10), ' '), '.')), 0), 6) AS text_entropy
FROM conversations"""
)
def entropy_value(spark, sf):
    flat = F.replace("text", F.lit("\n"), F.lit(" "))
    return M.table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        F.round(secrets.shannon_entropy(F.col("role")), 6).alias("role_entropy"),
        F.round(secrets.shannon_entropy(flat), 6).alias("text_entropy"),
    )


PATH_RULES = RuleSet((replace(EMAIL, path=r"\.txt$"), IPV4, replace(LICENCE, path="/en/")))


@query(
    with_(M.FILES, matches_ctes(PATH_RULES))
    + file_leaks()
    + " WHERE (m.rule_pos <> 0 OR regexp_matches(m.path, '\\.txt$'))"
    " AND (m.rule_pos <> 2 OR regexp_matches(m.path, '/en/'))"
)
def rule_path(spark, sf):
    return scan_files(M.files(spark, sf), PATH_RULES, D.DetectOptions(rule_paths=True))


PATH_ONLY = RuleSet((IPV4, Rule("image", "Image", None, path=r"/[a-z]{2}/[0-9]*5\.jpg$")))


@query(
    with_(M.FILES, matches_ctes(RuleSet((IPV4,))))
    + file_leaks()
    + """ UNION ALL SELECT '', 0, path, '', '', 'Image', '', '', '', path, '' FROM files
WHERE regexp_matches(path, '/[a-z]{2}/[0-9]*5\\.jpg$')"""
)
def rule_path_only(spark, sf):
    return scan_files(M.files(spark, sf), PATH_ONLY, D.DetectOptions(rule_paths=True))


@query(
    with_(M.FILES, matches_ctes(USER))
    + "SELECT path, line_number, match FROM matches WHERE rule_pos IN (0, 2)"
)
def rule_tags(spark, sf):
    found = D.match_rules(M.files(spark, sf), USER)
    return found.filter(F.array_contains(D.rule_tags(USER), "person")).select(
        "path", "line_number", "match"
    )


TARGET = _with_rule(EMAIL, stopwords=("mail5", "example", "19"))


@query(
    with_(M.FILES, matches_ctes(TARGET, match_target="secret"))
    + "SELECT path, line_number, match FROM matches"
)
def target_secret(spark, sf):
    found = D.match_rules(M.files(spark, sf), TARGET, options=D.DetectOptions(target_secret=True))
    return found.select("path", "line_number", "match")
