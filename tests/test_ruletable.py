import random

import pytest
from pyspark.sql import functions as F

from leaksieve import stock_rules
from leaksieve.operators import detect as D
from leaksieve.operators import ruletable as T


def tables(spark, texts, rules):
    t = spark.createDataFrame(texts, "path string, content string")
    r = spark.createDataFrame(rules, "pos int, keywords array<string>")
    return t, r


def brute(texts, rules, fold=lambda s: s):
    return sorted(
        (p, i) for p, c in texts if c is not None
        for i, words in rules if any(w is not None and fold(w) in fold(c) for w in words or ())
    )


def pairs(df):
    return sorted((r["path"], r["pos"]) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_pairs_against_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abAé日.\n😀") for _ in range(rng.randint(0, n)))
    texts = [(f"/{i}", word(40)) for i in range(80)] + [("/null", None), ("/empty", "")]
    rules = [(i, [word(6) or "x" for _ in range(rng.randrange(4))]) for i in range(60)]
    rules += [(60, None), (61, []), (62, [None, "ab"]), (63, ["a", "a"])]
    t, r = tables(spark, texts, rules)
    assert pairs(T.keyword_pairs(t, r)) == brute(texts, rules)
    assert pairs(T.keyword_pairs(t, r, ignore_case=True)) == brute(texts, rules, str.lower)
    rules.append((64, ["", "zz"]))
    t, r = tables(spark, texts, rules)
    assert pairs(T.keyword_pairs(t, r)) == brute(texts, rules)


def test_no_rules_and_no_texts(spark):
    t, r = tables(spark, [("/a", "abc")], [(1, ["abc"])])
    assert pairs(T.keyword_pairs(t, r)) == [("/a", 1)]
    assert pairs(T.keyword_pairs(t, r.filter("false"))) == []
    assert pairs(T.keyword_pairs(t.filter("false"), r)) == []


def test_twenty_thousand_rules_beside_the_literal_plan(spark):
    stock = stock_rules(())
    rng = random.Random(4)
    own = [(i, list(r.keywords)) for i, r in enumerate(stock.rules)]
    more = [(i, [f"{rng.getrandbits(48):x}", f"w{i}"]) for i in range(len(own), 20_000)]
    words = [k for _, ks in own for k in ks] + ["w19999", "w150", "plain", "text"]
    texts = [(f"/{i}", " ".join(rng.choice(words) for _ in range(rng.randrange(30)))) for i in range(300)]
    t, r = tables(spark, texts, own + more)
    found = T.keyword_pairs(t, r)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    got = pairs(found)
    literal = D.keyword_pairs(t, stock).select("path", F.col("rule_pos").alias("pos"))
    assert [p for p in got if p[1] < len(own)] == pairs(literal)
    assert ("/0" in {p for p, _ in got}) and any(i >= len(own) for _, i in got)
    assert got == brute(texts, own + more)


def test_what_moves_does_not_grow_with_the_rules_of_a_keyword(spark, monkeypatch):
    met, join = [], T.join_on_skewed_key

    def counted(many, few, key, *more):
        if key == "gram":
            met.append(few.count())
        return join(many, few, key, *more)

    monkeypatch.setattr(T, "join_on_skewed_key", counted)
    texts = [(f"/{i}", f"abc{i % 3} xyz") for i in range(40)]
    rules = [(i, [f"abc{i % 9}", "xyz"]) for i in range(900)] + [(900, [f"abc{i}" for i in range(40)])]
    rules += [(900, ["xyz"]), (901, ["xyz", None, "xyz"])]
    t, r = tables(spark, texts, rules)
    got = pairs(T.keyword_pairs(t, r))
    assert got == sorted(set(brute(texts, rules)))
    assert met == [41]  # the different keywords


def test_a_rule_counts_once_however_many_keywords_are_found(spark):
    rng = random.Random(8)
    texts = [(f"/{i}", " ".join(f"k{rng.randrange(60)}x" for _ in range(20))) for i in range(60)]
    rules = [(i, [f"k{rng.randrange(60)}x" for _ in range(n)]) for i, n in enumerate((1, 2, 15, 16, 17, 40) * 5)]
    t, r = tables(spark, texts, rules)
    assert pairs(T.keyword_pairs(t, r)) == brute(texts, rules)
