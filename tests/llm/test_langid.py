import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leaksieve.llm import langid as L

SYLLABLES = {
    "aa": ["ka", "to", "mi", "ra", "no"], "bb": ["sch", "ung", "keit", "ver", "ein"],
    "cc": ["eau", "oir", "qué", "ment", "ça"],
}


def text(lang, n, rng):
    return " ".join(
        "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n)
    )


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = [
        (i, text(lang, rng.randrange(5, 60), rng), lang)
        for i, lang in ((i, rng.choice("aa bb cc".split())) for i in range(900))
    ]
    rows += [(2000, None, "aa"), (2001, "text", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def model(docs):
    return L.fit(docs, F.col("doc_id") % 3 != 1)


def test_held_out_accuracy(docs, model):
    assert model.languages == ("aa", "bb", "cc")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = L.identify(docs, model).collect()
    held = [r for r in got if r["doc_id"] % 3 == 1 and r["doc_id"] < 2000]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.99 * len(held)
    assert all(len(r["languages"]) == 1 and r["score"] == 1 for r in held if r["lang_pred"] != "und") or (
        sum(len(r["languages"]) > 1 for r in held) < 0.02 * len(held)
    )


def test_mixtures_are_taken_apart(spark, model):
    rng = random.Random(5)
    rows = []
    for i in range(40):
        a, b = rng.sample(["aa", "bb", "cc"], 2)
        rows.append((i, text(a, 140, rng) + "\n" + text(b, 60, rng), a, b))
    df = spark.createDataFrame(rows, "doc_id long, text string, a string, b string")
    for r in L.identify(df, model).collect():
        _, _, a, b = rows[r["doc_id"]]
        shares = {x["lang"]: x["share"] for x in r["languages"]}
        assert set(shares) == {a, b} and r["lang_pred"] == a
        assert shares[a] == pytest.approx(0.7, abs=0.08) and r["score"] == shares[a]


def test_odd_rows(spark, docs, model):
    odd = [
        (1, None, "und"), (2, "", "und"), (3, "123 — 😀 ...", "und"), (4, "kato" * 30_000, "aa"),
        (None, "Ungkeit, VEREIN", "bb"), (5, "ungkeit", "bb"), (5, "ungkeit", "bb"), (6, "١٢٣", "und"),
    ]
    df = spark.createDataFrame([(i, t) for i, t, _ in odd], "doc_id long, text string")
    df = df.withColumn("lang_pred", F.lit(1))
    got = L.identify(df, model).collect()
    assert sorted((str(r["doc_id"]), r["lang_pred"]) for r in got) == sorted(
        (str(i), p) for i, _, p in odd
    )
    assert all((r["score"] == 0) == (r["lang_pred"] == "und") for r in got)
    assert L.identify(df.filter("false"), model).count() == 0


def test_nothing_to_learn(docs):
    empty = L.fit(docs, F.lit(False))
    assert empty.languages == ()
    assert {r["lang_pred"] for r in L.identify(docs, empty).collect()} == {"und"}


def _odd_texts():
    rng = random.Random(11)
    texts = [None, "", "k", "é", "ung", "x" * 5000, "😀", "a b", " sch ", "ça", "ka\n"]
    texts += [text(rng.choice(["aa", "bb", "cc"]), rng.randrange(1, 4), rng) for _ in range(300)]
    return texts + [text("aa", 60, rng) + " " + text("cc", 40, rng) for _ in range(20)]


def test_a_text_does_not_depend_on_its_neighbours(model):
    texts = _odd_texts()
    shares = lambda some: L.proportions(pa.array(some, pa.string()), model)
    together = shares(texts)
    assert (shares(texts[::-1])[::-1] == together).all()
    assert all((shares([t])[0] == row).all() for t, row in zip(texts, together))


def test_training_does_not_depend_on_the_order(spark, docs):
    rows = [r for r in docs.collect() if r["text"]]
    one = L.fit(spark.createDataFrame(rows, docs.schema).coalesce(1), F.lit(True))
    other = L.fit(spark.createDataFrame(rows[::-1], docs.schema).repartition(5), F.lit(True))
    assert one.languages == other.languages and (one.logp == other.logp).all()


def _plain_shares(text, model):
    """The definition in plain Python: trigrams of words, EM, backward elimination."""
    inside = [c >= 128 or chr(c).isalpha() for c in range(256)]
    data = [c if inside[c] else 32 for c in (text or "").lower().encode()]
    words, word = [], []
    for i, c in enumerate(data):
        if c == 32:
            words, word = words + [word] * bool(word), []
            continue
        a = data[i - 1] if i else 32
        z = data[i + 1] if i + 1 < len(data) else 32
        h = (a | c << 8 | z << 16) * 2654435761 % (1 << 32)
        word.append(h >> 16)
    words += [word] * bool(word)
    n = len(model.languages)
    if not words:
        return [0.0] * n
    q = []
    for w in words:
        ll = [sum(float(model.logp[g, k]) for g in w) for k in range(n)]
        q.append([math.exp(max(x - max(ll), -L.WORD_NATS)) for x in ll])

    def em(theta, some):
        for _ in range(L.ROUNDS):
            new = [0.0] * len(some)
            for row in q:
                total = sum(row[k] * t for k, t in zip(some, theta))
                for j, k in enumerate(some):
                    new[j] += row[k] * theta[j] / total
            theta = [x / len(q) for x in new]
        return theta, fit(theta, some)

    fit = lambda theta, some: sum(math.log(sum(row[k] * t for k, t in zip(some, theta))) for row in q)
    cost = L.PENALTY * math.log(len(q) + 1)
    some = list(range(n))
    theta, full = em([1 / n] * n, some)
    single = [sum(math.log(row[k]) for row in q) for k in range(n)]
    if full - max(single) <= cost:
        return [float(k == single.index(max(single))) for k in range(n)]
    some = [k for k in some if theta[k] > 1e-6]
    theta = [theta[k] / sum(theta[j] for j in some) for k in some]
    best = fit(theta, some)
    while len(some) > 1:
        drop = theta.index(min(theta))
        fewer = [k for i, k in enumerate(some) if i != drop]
        start = [t + 1e-9 for i, t in enumerate(theta) if i != drop]
        t, ll = em([x / sum(start) for x in start], fewer)
        if best - ll > cost:
            break
        some, theta, best = fewer, t, ll
    return [theta[some.index(k)] if k in some else 0.0 for k in range(n)]


def test_shares_against_plain_python(model):
    texts = _odd_texts()[:40] + _odd_texts()[-12:]
    got = L.proportions(pa.array(texts, pa.string()), model)
    for t, row in zip(texts, got):
        assert list(row) == pytest.approx(_plain_shares(t, model), abs=1e-9)
    assert sum((row > 0).sum() > 1 for row in got) >= 5


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(L, "MAX_LANGUAGES", 2)
    df = spark.createDataFrame([(i, "ab", f"l{i}") for i in range(3)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        L.fit(df, F.lit(True))
