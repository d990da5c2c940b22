"""Quality rules with risk-controlled thresholds.

Each rule rejects documents on one side of a cutoff of one feature. The cutoffs are
chosen on labelled documents, per stratum (language), from a fixed grid that goes from
lenient to strict. A cutoff is certified if an exact binomial test rejects, at level
``delta`` divided by all strata and rules (Bonferroni), that it falsely rejects the share
``epsilon / rules`` or more of the good documents. Within a grid tests go on in that fixed
order until one fails, which needs no further correction. So with probability ``1 -
delta`` no stratum loses more than the share ``epsilon`` of its good documents to all
rules together. Of the certified cutoffs that of the largest gain is taken, the bad
documents it rejects less ``cost`` times the good ones, the most lenient of equals; a rule
without a gain is not used.

All of it is DataFrame operations; texts stay where they were read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log, pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaksieve.llm.common import fresh, let, saved, words

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

# Fixed value: the characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """Rejects a document if ``feature`` is at or beyond the cutoff, above or below it."""

    name: str
    feature: str
    above: bool
    grid: tuple[float, ...]  # from lenient to strict


RULES = (
    Rule("symbols", "symbol_share", True, (0.8, 0.6, 0.4, 0.3, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05)),
    Rule("lines", "dup_line_share", True, (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35)),
    Rule("repeats", "repeat_share", True, (0.95, 0.9, 0.8, 0.6, 0.4, 0.3, 0.2, 0.15)),
    Rule("long_words", "mean_word", True, (20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0, 8.5)),
    Rule("short_words", "mean_word", False, (1.5, 2.0, 2.5, 3.0, 3.5)),
)


@dataclass(frozen=True)
class Risk:
    epsilon: float = 0.05
    delta: float = 0.05
    cost: float = 3.0


# ------------------------------------------------------------------- features


def repeated_words(ws: Column, size: int = WINDOW) -> Column:
    """Words that lie in a window of ``size`` words found twice or more in the array.

    Windows are compared by hash; equal hashes are confirmed by the words themselves.
    """

    def covered(hs: Column) -> Column:
        tagged = F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("at")))

        def positions(s: Column) -> Column:
            def same(x: Column, i: Column, step: int) -> Column:
                other = F.get(s, i + step)
                return F.coalesce(
                    (other["h"] == x["h"])
                    & (F.slice(ws, other["at"] + 1, size) == F.slice(ws, x["at"] + 1, size)),
                    F.lit(False),
                )

            twice = F.filter(s, lambda x, i: same(x, i, -1) | same(x, i, 1))
            return F.sort_array(F.transform(twice, lambda x: x["at"]))

        def total(at: Column) -> Column:
            gaps = F.transform(
                at, lambda p, i: F.least(F.coalesce(F.get(at, i + 1) - p, F.lit(size)), F.lit(size))
            )
            return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

        repeats = let(F.sort_array(tagged), lambda s: let(positions(s), total))
        # Most texts have no repeated window; they are not sorted.
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(repeats)

    def windows(wh: Column) -> Column:
        some = F.slice(wh, 1, F.greatest(F.size(wh) - (size - 1), F.lit(0)))
        return F.transform(
            some, lambda h, i: F.xxhash64(h, *[F.get(wh, i + k) for k in range(1, size)])
        )

    hashed = F.transform(ws, lambda w: F.xxhash64(w))
    return F.when(
        F.size(ws) > size, let(hashed, lambda wh: let(windows(wh), covered))
    ).otherwise(F.lit(0)).cast("long")


def features(text: Column) -> Column:
    """Struct of the counts of a text; a null text is an empty one."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda l: F.rlike(l, F.lit(r"[^\x20\x09-\x0D]")))
    return let(
        words(t),
        lambda ws: F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda ls: F.struct(
                F.size(ls).alias("all"), (F.size(ls) - F.size(F.array_distinct(ls))).alias("dup")
            )).alias("lines"),
            repeated_words(ws).alias("n_repeat_words"),
        ),
    )


COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def with_counts(df: DataFrame, text: str, names: list[str]) -> DataFrame:
    """``df`` plus the columns of ``COUNTS`` under ``names``."""
    own = fresh(df, "f1", "f2", "f3", "f4", "f5")
    # The generator keeps filters on the counts above them; below they would be computed
    # once more for every test.
    counted = df.select("*", F.inline_outer(F.array(features(F.col(text)))).alias(*own))
    n_words, chars, symbols, lines, repeats = own
    fields = (n_words, chars, symbols, f"{lines}.all", f"{lines}.dup", repeats)
    return counted.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[F.col(a).cast("long").alias(n) for a, n in zip(fields, names)],
    )


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    """Fewer than ten words, or over a fifth of the words in repeated windows."""
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def _ratios(c: dict[str, Column]) -> dict[str, Column]:
    ratio = lambda a, b: F.coalesce(F.try_divide(c[a].cast("double"), c[b]), F.lit(0.0))
    return {
        "symbol_share": ratio("n_symbols", "word_chars"),
        "dup_line_share": ratio("n_dup_lines", "n_lines"),
        "repeat_share": ratio("n_repeat_words", "n_words"),
        "mean_word": ratio("word_chars", "n_words"),
    }


# ---------------------------------------------------------------- exact bounds


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0 by Stirling's series, moved up by eight."""
    y = x + 8
    inverse = 1 / (y * y)
    series = (
        1 / 12.0 - inverse * (1 / 360.0 - inverse * (1 / 1260.0 - inverse * (1 / 1680.0)))
    ) / y
    shift = F.ln(reduce(lambda p, q: p * q, [x + i for i in range(8)]))
    return (y - 0.5) * F.ln(y) - y + 0.5 * log(2 * pi) + series - shift


def binomial_tail(k: Column, n: Column, p: Column | float) -> Column:
    """P(X <= k) for X binomial (n, p), 0 < p < 1: the p-value of ``k`` false rejections
    of ``n`` under a true rate of ``p`` or more.

    The largest term is taken from the gamma function and the others from it by exact
    ratios, downwards from ``k``, until they are below the precision of a double. At or
    above the mean there is nothing to certify; the value is then 1.
    """
    p = F.lit(p) if isinstance(p, float) else p
    n, k = n.cast("double"), k.cast("double")
    top = (
        log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)
        + k * F.ln(p) + (n - k) * F.ln(1 - p)
    )
    # Below the mean, terms fall faster than a normal density from k down.
    steps = F.least(k, 50 + 12 * F.sqrt(n)).cast("int")

    def add(acc: Column, i: Column) -> Column:
        j = k - i  # from the term of j + 1 to that of j
        term = acc["term"] * (j + 1) / (n - j) * (1 - p) / p
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    one = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    downwards = F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(downwards, one, add, lambda acc: acc["total"])
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(top + F.ln(total))))


# ----------------------------------------------------------------- thresholds


def thresholds(
    labelled: DataFrame, rules: tuple[Rule, ...] = RULES, risk: Risk = Risk()
) -> DataFrame:
    """(stratum, rule, cutoff) of the rules in use, from (stratum, good, the features).

    One pass counts, for each stratum, rule and cutoff, the good and bad documents that
    it rejects; the table of counts has strata times cutoffs rows.
    """
    tests = [
        F.struct(
            F.lit(r.name).alias("rule"), F.lit(i).alias("step"), F.lit(float(c)).alias("cutoff"),
            (F.col(r.feature) >= c if r.above else F.col(r.feature) <= c).alias("hit"),
        )
        for r in rules
        for i, c in enumerate(r.grid)
    ]
    counts = saved(
        labelled.select("stratum", "good", F.explode(F.array(*tests)).alias("t"))
        .groupBy("stratum", "t.rule", "t.step", "t.cutoff")
        .agg(
            F.count_if("good").alias("n_good"),
            F.count_if(F.col("good") & F.col("t.hit")).alias("false_hits"),
            F.count_if(~F.col("good") & F.col("t.hit")).alias("true_hits"),
        ),
        "quality-tests",
    )
    strata = counts.select("stratum").distinct().count()
    level = risk.delta / max(1, strata * len(rules))
    p_value = binomial_tail(F.col("false_hits"), F.col("n_good"), risk.epsilon / len(rules))
    tested = counts.withColumn("fails", (F.col("n_good") == 0) | (p_value > level))
    first_fail = tested.groupBy("stratum", "rule").agg(
        F.min(F.when(F.col("fails"), F.col("step"))).alias("stop"),
    )
    gain = F.col("true_hits") - risk.cost * F.col("false_hits")
    certified = (
        tested.withColumn("gain", gain).join(
            first_fail.select(F.col("stratum").alias("s"), F.col("rule").alias("r"), "stop"),
            F.col("stratum").eqNullSafe(F.col("s")) & (F.col("rule") == F.col("r")),
        )
        .filter((F.col("stop").isNull() | (F.col("step") < F.col("stop"))) & (F.col("gain") > 0))
    )
    best = F.max_by("cutoff", F.struct(F.col("gain"), -F.col("step")))
    return saved(certified.groupBy("stratum", "rule").agg(best.alias("cutoff")), "quality-cutoffs")


def _rejected(rules: tuple[Rule, ...], ratios: dict[str, Column], cutoffs: Column) -> Column:
    """Some rule in use rejects; ``cutoffs`` maps rules to cutoffs, null where none is."""
    tests = []
    for r in rules:
        c = F.try_element_at(cutoffs, F.lit(r.name))
        x = ratios[r.feature]
        tests.append(F.coalesce(x >= c if r.above else x <= c, F.lit(False)))
    return reduce(lambda a, b: a | b, tests)


def cutoffs_of(
    counted: DataFrame,
    labels: DataFrame,
    c: dict[str, Column],
    rules: tuple[Rule, ...] = RULES,
    risk: Risk = Risk(),
) -> DataFrame:
    """(of, cutoffs): a map of the rules in use for each language, from a table (doc_id,
    lang, the counts ``c``) and labels (doc_id, quality)."""
    label = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(
        (F.min("quality") == 1).alias("good")
    )
    labelled = counted.filter(~base_failed(c["n_words"], c["n_repeat_words"])).select(
        "doc_id", F.col("lang").alias("stratum"), *[v.alias(k) for k, v in _ratios(c).items()]
    ).join(label, "doc_id")
    return thresholds(labelled, rules, risk).groupBy(F.col("stratum").alias("of")).agg(
        F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs")
    )


def _judged(
    counted: DataFrame, cutoffs: DataFrame, c: dict[str, Column], rules: tuple[Rule, ...] = RULES
) -> tuple[DataFrame, str, str]:
    """``counted`` with base_failed and kept, and the names of these columns."""
    failed = base_failed(c["n_words"], c["n_repeat_words"])
    of, cut, base, kept = fresh(counted, "of", "cutoffs", "base_failed", "kept")
    cutoffs = cutoffs.select(F.col("of").alias(of), F.col("cutoffs").alias(cut))
    out = counted.join(cutoffs, F.col("lang").eqNullSafe(F.col(of)), "left").withColumns(
        {base: failed, kept: ~failed & ~_rejected(rules, _ratios(c), F.col(cut))}
    )
    return out.drop(of, cut), base, kept


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept), one row per row of (doc_id, text, lang).

    ``labels`` has doc_id and quality (1 good, 0 bad); of repeated ids the worst label
    holds, null ids and labels do not count. A null language is a stratum of its own. A
    stratum without enough labelled documents has no cutoff and rejects nothing beyond
    the base rules; so does everything without labels. Null and blank texts have no words
    and fail the base rules. Repeated rows are judged alike.
    """
    c = {n: F.col(n) for n in COUNTS}
    narrow = docs.select("doc_id", "text", "lang")
    counted = saved(with_counts(narrow, "text", list(COUNTS)).drop("text"), "quality-counts")
    out, base, kept = _judged(counted, cutoffs_of(counted, labels, c), c)
    return out.select(
        "doc_id", *[n for n in COUNTS if n != "n_lines"],
        F.col(base).alias("base_failed"), F.col(kept).alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept; columns unchanged.

    The cutoffs come from stored counts. The texts are then counted once more and
    filtered where they are read: they do not move, and no copy of them is written.
    """
    plain = {n: F.col(n) for n in COUNTS}
    narrow = docs.select("doc_id", "text", "lang")
    counted = saved(with_counts(narrow, "text", list(COUNTS)).drop("text"), "quality-counts")
    cutoffs = cutoffs_of(counted, labels, plain)
    names = fresh(docs, *COUNTS)
    c = {n: F.col(f"`{a}`") for n, a in zip(COUNTS, names)}
    out, _, kept = _judged(with_counts(docs, "text", names), cutoffs, c)
    return out.filter(F.col(kept)).select(*[F.col(f"`{c}`") for c in docs.columns])
