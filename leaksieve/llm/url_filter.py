"""URL filtering by a cascade of Bloom filters, exact and without joins at look-up.

A rule is a host and a path prefix. All keys that some rule could have for some url of
the corpus are known: the url's host suffixes times its path prefixes, at the label
counts and path lengths that rules have. Level 1 of the cascade encodes the listed keys;
level 2 the keys of the corpus that level 1 takes for listed, level 3 the listed keys
that level 2 takes for those, and so on until a level has no false positive. The first
level that does not know a key decides: exact for every key of the corpus. A second
cascade, over the listed keys, tells the blocked from the allowed.

A filter is a column literal of 64-bit words, at most ``max_words`` in all, so what goes
to the tasks is bounded. A longer list is looked up by a join of the distinct keys
instead; the results are the same.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaksieve.llm.common import fresh, let, saved

MAX_WORDS = 1 << 20
FIRST_FPP = 0.01
LATER_FPP = 0.5

ALLOW, BLOCK = "allow", "block"


# ------------------------------------------------------------------ url parts


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


# -------------------------------------------------------------- Bloom filters


@dataclass(frozen=True)
class Bloom:
    """``bits`` bits in 64-bit ``words``; ``hashes`` probes per key; ``salt`` of the level."""

    bits: int
    hashes: int
    salt: int
    words: tuple[int, ...]

    def holds(self, key: Column) -> Column:
        words = F.from_json(F.lit("[" + ",".join(map(str, self.words)) + "]"), "array<bigint>")

        def has(at: Column) -> Column:
            word = F.get(words, F.shiftright(at, 6).cast("int"))
            return F.getbit(word, at.bitwiseAND(F.lit(63)).cast("int")) == 1

        tests = [has(b) for b in _positions(key, self.bits, self.hashes, self.salt)]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out


def _positions(key: Column, bits: int, hashes: int, salt: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(salt * 64 + i)), F.lit(bits)) for i in range(hashes)]


def bloom_shape(n: int, fpp: float) -> tuple[int, int]:
    """(bits, hashes) for ``n`` keys, at least one word."""
    bits = max(64, ceil(-n * log(fpp) / log(2) ** 2))
    return -(-bits // 64) * 64, max(1, round(-log(fpp) / log(2)))


def build_bloom(keys: DataFrame, n: int, fpp: float, salt: int) -> Bloom:
    """The filter of the column ``key``. Words are or-ed before they move; their number
    bounds what comes to the driver."""
    bits, hashes = bloom_shape(n, fpp)
    at = F.explode(F.array(*_positions(F.col("key"), bits, hashes, salt)))
    rows = (
        keys.select(at.alias("at"))
        .select(
            F.shiftright("at", 6).alias("word"),
            F.expr("shiftleft(1L, CAST(at & 63 AS INT))").alias("bit"),
        )
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .collect()
    )
    words = [0] * (bits // 64)
    for r in rows:
        words[r["word"]] = r["bits"]
    return Bloom(bits, hashes, salt, tuple(words))


@dataclass(frozen=True)
class Cascade:
    """Levels in turn for listed keys and for those taken for listed."""

    levels: tuple[Bloom, ...]

    def holds(self, key: Column) -> Column:
        """Exact for every key of the two sets from which the cascade was built."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            out = F.when(~self.levels[i].holds(key), F.lit(i % 2 == 1)).otherwise(out)
        return out if self.levels else F.lit(False)


def build_cascade(
    listed: DataFrame, others: DataFrame, max_words: int = MAX_WORDS, salt: int = 0
) -> Cascade | None:
    """Cascade that holds the keys of ``listed`` and none of ``others``; both have one
    column ``key`` of distinct values and share none. None where it would be too large.
    """
    side = [saved(listed, "bloom-listed"), others]
    n = side[0].count()
    levels: list[Bloom] = []
    used = 0
    while n:
        fpp = FIRST_FPP if not levels else LATER_FPP
        used += bloom_shape(n, fpp)[0] // 64
        if used > max_words:
            return None
        level = build_bloom(side[0], n, fpp, salt + len(levels))
        levels.append(level)
        wrong = saved(side[1].filter(level.holds(F.col("key"))), "bloom-wrong")
        side = [wrong, side[0]]
        n = wrong.count()
    return Cascade(tuple(levels))


# ------------------------------------------------------------------ the filter


@dataclass(frozen=True)
class Shape:
    """Label counts of hosts and lengths of path prefixes that rules have."""

    labels: tuple[int, ...]
    lengths: tuple[int, ...]


def rule_shape(rules: DataFrame) -> Shape:
    """Distinct shapes only; their number is bounded by the longest host and path."""
    row = rules.agg(
        F.collect_set(F.size(F.split("host", "[.]"))).alias("labels"),
        F.collect_set(F.length("path")).alias("lengths"),
    ).first()
    return Shape(
        tuple(sorted(row["labels"] or [], reverse=True)),
        tuple(sorted(row["lengths"] or [], reverse=True)),
    )


def rule_keys(host: Column, path: Column, shape: Shape) -> Column:
    """Array of the keys that a rule of the given shape for this url would have, longest
    first; of equal lengths the longer host first."""
    numbers = lambda values: F.lit(list(values)).cast("array<int>")
    host_labels = F.when(host != "", F.size(F.split(host, "[.]"))).otherwise(0)

    def key(suffix: Column, length: Column) -> Column:
        prefix = F.left(path, length)
        return F.struct(
            (-F.length(suffix) - F.length(prefix)).alias("short"),
            (-F.length(suffix)).alias("host"),
            F.concat_ws("\n", suffix, prefix).alias("key"),
        )

    def of_host(labels: Column) -> Column:
        suffix = F.call_function("substring_index", host, F.lit("."), -labels)
        lengths = F.filter(numbers(shape.lengths), lambda m: m <= F.length(path))
        return let(suffix, lambda h: F.transform(lengths, lambda m: key(h, m)))

    fitting = F.filter(numbers(shape.labels), lambda n: n <= host_labels)
    found = F.array_sort(F.flatten(F.transform(fitting, of_host)))
    return F.transform(found, lambda k: k["key"])


def filter_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", max_words: int = MAX_WORDS
) -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    ``rules`` has host, path and verdict (``allow`` or ``block``). A rule fits its host,
    all subdomains, and paths that begin with its path; the longest fitting rule decides
    (of equal lengths that of the longer host, of equal rules ``block``). Where none
    fits, ``rule`` is null and the verdict ``allow``. A url that is null or has no
    ``://`` has an empty host and path and no rule. Repeated rows stay. Without rules
    everything is allowed. Columns named like the new ones give way to them.
    """
    rules = rules.filter("host IS NOT NULL AND path IS NOT NULL AND host != ''")
    keys = saved(
        rules.groupBy(F.concat_ws("\n", "host", "path").alias("key")).agg(
            F.bool_or(F.col("verdict") == BLOCK).alias("blocked")
        ),
        "url-rules",
    )
    shape = rule_shape(rules)
    parts = pages.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    candidates = rule_keys(F.col("host"), F.col("path"), shape)
    # The complete key universe of the corpus, without the listed keys.
    universe = parts.select(F.explode(candidates).alias("key")).distinct()
    others = saved(universe.join(keys, "key", "left_anti"), "url-universe")
    listed = build_cascade(keys.select("key"), others, max_words)
    blocked = build_cascade(
        keys.filter("blocked").select("key"), keys.filter("NOT blocked").select("key"),
        max_words, salt=1000,
    )
    plain = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    if listed is None or blocked is None:
        return _by_join(parts, keys, candidates, plain)
    columns = [F.col(f"`{c}`") for c in plain]
    first = let(
        candidates, lambda ks: F.get(F.filter(ks, lambda k: listed.holds(k)), F.lit(0))
    )
    found = parts.select(*columns, "host", "path", first.alias("rule"))
    verdict = F.when(F.col("rule").isNotNull() & blocked.holds(F.col("rule")), BLOCK)
    return found.select(
        *columns, "host", "path",
        F.replace("rule", F.lit("\n"), F.lit("")).alias("rule"),
        verdict.otherwise(ALLOW).alias("verdict"),
    )


def _by_join(parts: DataFrame, keys: DataFrame, candidates: Column, plain: list[str]) -> DataFrame:
    """The same for a list beyond the bound. A key that many urls have is split by
    adaptive execution."""
    uid, tried, hit = fresh(parts, "uid", "tried", "hit")
    kept = saved(parts.withColumn(uid, F.monotonically_increasing_id()), "url-parts")
    hits = (
        kept.select(uid, F.posexplode(candidates).alias("at", "key"))
        .join(keys, "key")
        .groupBy(uid)
        .agg(F.min(F.struct("at", "key", "blocked")).alias(hit))
    )
    rule = F.replace(F.col(f"{hit}.key"), F.lit("\n"), F.lit(""))
    return kept.join(hits, uid, "left").select(
        *[F.col(f"`{c}`") for c in plain], "host", "path", rule.alias("rule"),
        F.when(F.col(f"{hit}.blocked"), BLOCK).otherwise(ALLOW).alias("verdict"),
    )
