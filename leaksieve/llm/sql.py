"""SQL with the meaning of those queries that SQL can express."""

from __future__ import annotations

from leaksieve.llm import quality

WORD = r"[^\x20\x09-\x0D]+"


def urls(rules) -> str:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return rf"""
WITH rules(host, path, verdict) AS (VALUES {values}),
rest AS (SELECT page_id, CASE WHEN contains(url, '://')
  THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id,
  translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fits AS (SELECT p.page_id, concat(r.host, r.path) AS rule, r.verdict,
  row_number() OVER (PARTITION BY p.page_id
    ORDER BY length(concat(r.host, r.path)) DESC, length(r.host) DESC) AS n
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, concat('.', r.host)))
    AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.n = 1"""


def quality_rules(rules=quality.RULES, risk=quality.Risk()) -> str:
    grid = ", ".join(
        f"('{r.name}', {i}, {float(c)}, {r.above})"
        for r in rules
        for i, c in enumerate(r.grid)
    )
    value = " ".join(f"WHEN '{r.name}' THEN x.{r.feature}" for r in rules)
    p = risk.epsilon / len(rules)
    return rf"""
WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS text,
  regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
twice AS (SELECT doc_id, i FROM (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (
  SELECT doc_id, i, unnest(range(0, 5)) AS k FROM twice) GROUP BY doc_id),
counts AS (SELECT w.doc_id, lang, len(ws) AS n_words,
  length(array_to_string(ws, '')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS ls,
  coalesce(c.n, 0) AS n_repeat_words
  FROM w LEFT JOIN covered c ON c.doc_id = w.doc_id),
f AS (SELECT *, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts),
x AS (SELECT *,
  CASE WHEN word_chars > 0 THEN n_symbols::DOUBLE / word_chars ELSE 0 END AS symbol_share,
  CASE WHEN len(ls) > 0 THEN n_dup_lines::DOUBLE / len(ls) ELSE 0 END AS dup_line_share,
  CASE WHEN n_words > 0 THEN n_repeat_words::DOUBLE / n_words ELSE 0 END AS repeat_share,
  CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words ELSE 0 END AS mean_word FROM f),
grid(rule, step, cutoff, above) AS (VALUES {grid}),
label AS (SELECT doc_id, min(quality) = 1 AS good FROM labels
  WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
hits AS (SELECT x.lang, l.good, g.rule, g.step, g.cutoff,
  CASE WHEN g.above THEN (CASE g.rule {value} END) >= g.cutoff
    ELSE (CASE g.rule {value} END) <= g.cutoff END AS hit
  FROM x JOIN label l ON l.doc_id = x.doc_id, grid g WHERE NOT x.base_failed),
tests AS (SELECT lang, rule, step, cutoff, count(*) FILTER (good) AS n,
  count(*) FILTER (good AND hit) AS k, count(*) FILTER (NOT good AND hit) AS true_hits
  FROM hits GROUP BY ALL),
terms AS (SELECT lang, rule, step, n, k, unnest(range(0, k + 1)) AS j FROM tests),
tails AS (SELECT lang, rule, step, least(1, sum(exp(lgamma(n + 1) - lgamma(j + 1)
  - lgamma(n - j + 1) + j * ln({p}) + (n - j) * ln(1 - {p})))) AS p FROM terms GROUP BY ALL),
strata AS (SELECT count(*) AS s FROM (SELECT DISTINCT lang FROM tests)),
tested AS (SELECT t.*, t.n = 0 OR t.k >= t.n * {p}
  OR a.p > {risk.delta} / (strata.s * {len(rules)}) AS fails
  FROM tests t JOIN tails a ON a.lang IS NOT DISTINCT FROM t.lang AND a.rule = t.rule
    AND a.step = t.step, strata),
stops AS (SELECT lang, rule, min(step) FILTER (fails) AS stop FROM tested GROUP BY ALL),
best AS (SELECT t.lang, t.rule, t.cutoff, row_number() OVER (PARTITION BY t.lang, t.rule
    ORDER BY t.true_hits - {risk.cost} * t.k DESC, t.step) AS r
  FROM tested t JOIN stops s ON s.lang IS NOT DISTINCT FROM t.lang AND s.rule = t.rule
  WHERE (s.stop IS NULL OR t.step < s.stop) AND t.true_hits - {risk.cost} * t.k > 0),
rejected AS (SELECT DISTINCT x.doc_id FROM x JOIN best g ON g.r = 1
    AND g.lang IS NOT DISTINCT FROM x.lang
  JOIN (SELECT DISTINCT rule, above FROM grid) a ON a.rule = g.rule
  WHERE CASE WHEN a.above THEN (CASE g.rule {value} END) >= g.cutoff
    ELSE (CASE g.rule {value} END) <= g.cutoff END)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM rejected) AS kept
FROM f"""


CONTAINED = r"""
WITH texts AS (SELECT true AS item, item_id AS id, text FROM benchmark WHERE text IS NOT NULL
  UNION ALL SELECT false, doc_id, text FROM documents),
w AS (SELECT item, id, regexp_extract_all(lower(coalesce(text, '')),
  '[0-9A-Za-z\x{80}-\x{10FFFF}]+') AS ws FROM texts),
short AS (SELECT DISTINCT len(ws) AS k FROM w WHERE item AND len(ws) BETWEEN 1 AND 4),
sized AS (SELECT item, id, ws, least(len(ws), 5) AS k FROM w WHERE item AND len(ws) > 0
  UNION ALL SELECT item, id, ws, s.k FROM w, (SELECT k FROM short UNION SELECT 5) s
    WHERE NOT item AND len(ws) >= s.k),
shingles AS (SELECT DISTINCT item, id, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (
  SELECT item, id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM sized)),
sizes AS (SELECT id, count(*) AS n FROM shingles WHERE item GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, CAST(s.n AS INTEGER) AS n_shingles,
  CAST(count(*) AS INTEGER) AS n_found, count(*)::DOUBLE / s.n AS containment
FROM shingles i JOIN shingles d ON d.g = i.g AND NOT d.item JOIN sizes s ON s.id = i.id
WHERE i.item GROUP BY d.id, i.id, s.n HAVING count(*) * 10 >= 8 * s.n"""
