import math
import random
import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from leaksieve.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [l for l in text.split("\n") if WORD.search(l)]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {
        i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)
    }
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return (
        len(w), sum(map(len, w)), symbols, len(lines), len(lines) - len(set(lines)), len(covered)
    )


def _texts():
    rng = random.Random(3)
    texts = [None, "", " \n\t", "one", "a b c d e", "a b c d e a b c d e", "a " * 20, "é à #\n" * 7]
    texts += ["x" * 50_000, "w1 w2 " * 5_000, "tail \n", "\nhead", "a\x0bb\x0cc\rd", "a\u00a0b c"]
    for _ in range(150):
        texts.append("".join(rng.choice(["a", "b", "cc", " ", " ", "\n", "#|", "ü"]) for _ in range(rng.randrange(120))))
    return texts


def test_counts(spark):
    texts = _texts()
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("lines", F.lit(1))
    out = Q.with_counts(df, "text", list(Q.COUNTS))
    for r in out.collect():
        assert tuple(r[c] for c in Q.COUNTS) == counts(texts[r["i"]]), texts[r["i"]]


def exact_tail(k, n, p):
    p = Fraction(p)
    return float(sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)))


def test_binomial_tail_is_exact(spark):
    cases = [(k, n, p) for n in (0, 1, 5, 40, 300, 2000) for k in (0, 1, 3, 10, 60) if k <= n
             for p in (0.002, 0.05, 0.3)]
    df = spark.createDataFrame(cases, "k long, n long, p double")
    for r in df.withColumn("t", Q.binomial_tail(F.col("k"), F.col("n"), F.col("p"))).collect():
        if r["k"] >= r["n"] * r["p"]:
            assert r["t"] == 1.0
        else:
            assert r["t"] == pytest.approx(exact_tail(r["k"], r["n"], r["p"]), rel=1e-9)
    big = df.limit(1).select(Q.binomial_tail(F.lit(49_000_000), F.lit(10**9), 0.05).alias("t"))
    assert 0 <= big.first()["t"] < 1e-300


RULES = (Q.Rule("s", "x", True, (0.9, 0.5, 0.1)),)


def _labelled(spark, good, bad):
    rows = [("en", True, x) for x in good] + [("en", False, x) for x in bad]
    rows += [(None, True, 0.95)] * 3 + [(None, False, 0.95)] * 3
    return spark.createDataFrame(rows, "stratum string, good boolean, x double")


def test_certified_cutoffs_only(spark):
    risk = Q.Risk(epsilon=0.05, delta=0.05)
    # 0.1 would reject a third of the good ones, 0.5 none of them.
    df = _labelled(spark, [0.0] * 200 + [0.2] * 100, [0.6] * 10 + [0.95] * 10)
    assert [tuple(r) for r in Q.thresholds(df, RULES, risk).collect()] == [("en", "s", 0.5)]
    # Too few labels certify nothing.
    few = _labelled(spark, [0.0] * 40, [0.95] * 40)
    assert Q.thresholds(few, RULES, risk).count() == 0
    # Nothing bad to reject: not used.
    assert Q.thresholds(_labelled(spark, [0.0] * 300, [0.0]), RULES, risk).count() == 0


def test_false_rejections_stay_within_the_risk(spark):
    rng = random.Random(9)
    risk = Q.Risk(epsilon=0.1, delta=0.1)
    beyond = 0
    frames = []
    for trial in range(40):
        rows = [(f"t{trial}", True, rng.random() ** 4) for _ in range(150)]
        rows += [(f"t{trial}", False, 1 - rng.random() ** 4) for _ in range(150)]
        frames += rows
    df = spark.createDataFrame(frames, "stratum string, good boolean, x double")
    grid = tuple(i / 50 for i in range(49, 0, -1))
    for r in Q.thresholds(df, (Q.Rule("s", "x", True, grid),), risk).collect():
        beyond += 1 - r["cutoff"] ** 0.25 > risk.epsilon  # true share at or above the cutoff
    assert beyond == 0  # delta holds for all strata together


def test_judge_odd_rows(spark):
    texts = _texts()
    rows = [(i if i % 9 else None, t, "en" if i % 2 else None, 1) for i, t in enumerate(texts)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int")
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int"
    )
    out = Q.judge(docs, labels).collect()
    assert len(out) == len(rows)
    key = lambda i, c: str((i, c[0], c[1], c[2], c[4], c[5]))
    assert sorted(key(i, counts(t)) for i, t, _, _ in rows) == sorted(
        str((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]))
        for r in out
    )
    for r in out:
        base = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == base and r["kept"] == (not base)
    kept = Q.keep_good(docs, labels)
    assert kept.dtypes == docs.dtypes and kept.count() == sum(r["kept"] for r in out)
    assert Q.judge(docs.filter("false"), labels.filter("false")).count() == 0
    assert Q.judge(docs, labels.filter("false")).count() == len(rows)
