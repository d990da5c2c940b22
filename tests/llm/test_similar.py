import hashlib
import os
import random
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from leaksieve.llm import similar as S
from leaksieve.llm.components import connected_components


def shingles(text, size=5):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def heads(rows, similarity=0.8):
    """Ids that stay, by comparing all pairs; ids are different and not null."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            either = len(sets[a] | sets[b])
            if a < b and (not either or len(sets[a] & sets[b]) >= similarity * either - 1e-9):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return sorted(i for i in parent if find(i) == i)


def _texts(seed, originals, copies, words=(20, 300)):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    out = []
    for _ in range(originals):
        base = rng.choices(vocabulary, k=rng.randrange(*words))
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(1 + len(w) // 25)):  # similarities on both sides of 0.8
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(w))
    rng.shuffle(out)
    return list(enumerate(out))


def _kept(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(r["doc_id"] for r in S.deduplicate(df, **kw).collect())


def test_edited_copies_agree_with_brute_force(spark):
    rows = _texts(1, 40, 6)
    want = heads(rows)
    assert 40 < len(want) < 150  # some copies are near enough and some are not
    assert _kept(spark, rows) == want


def test_forests_of_large_buckets_lose_no_group(spark, monkeypatch):
    rows = _texts(2, 30, 8)
    assert _kept(spark, rows, bucket_cap=1) == heads(rows)
    monkeypatch.setattr(S, "PART", 3)  # buckets in several parts
    assert _kept(spark, rows, bucket_cap=1) == heads(rows)


def test_one_large_group_sends_on_few_pairs(spark):
    rng = random.Random(4)
    base = [f"v{i}" for i in range(400)]
    rows = []
    for i in range(600):
        w = list(base)
        w[rng.randrange(400)] = f"x{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts, edges, _ = S.links(df)
    assert edges.count() < 14 * 4 * 600  # all pairs would be 179,700
    assert S.buckets(texts).filter("n > 512").count() > 0
    assert connected_components(edges, "a", "b").select("root").distinct().count() == 1
    assert _kept(spark, rows) == [0]


def test_forest_spans_what_brute_force_connects():
    np = pytest.importorskip("numpy")
    rng = random.Random(5)
    values = []
    for _ in range(12):
        v = rng.getrandbits(256)
        for _ in range(5):
            values.append(v)
            for _ in range(rng.randrange(50)):
                v ^= 1 << rng.randrange(256)
    fps = np.array([[v >> 64 * i & (1 << 64) - 1 for i in range(4)] for v in values], np.uint64)

    def groups(edges):
        of = list(range(len(values)))
        for i, j in edges:
            of = [of[i] if g == of[j] else g for g in of]
        return {frozenset(k for k, g in enumerate(of) if g == h) for h in of}

    near = [
        (i, j) for i in range(len(values)) for j in range(i)
        if (values[i] ^ values[j]).bit_count() <= 64
    ]
    distance = S.distances(fps)
    np.fill_diagonal(distance, S.FAR)
    edges = S.forest(distance)
    assert set(map(frozenset, edges)) <= set(map(frozenset, near))
    assert groups(edges) == groups(near) and len(edges) == len(values) - len(groups(near))


def test_sketches_do_not_depend_on_other_rows_or_size(spark):
    np = pytest.importorskip("numpy")
    pa = pytest.importorskip("pyarrow")
    texts = [t for _, t in _texts(6, 8, 2)] + ["", None, "a b", " x y z q ", "ab " * 100_000]
    texts.append(" ".join(f"n{i}" for i in range(150_000)))

    def sets(some):
        out = []
        for _, n, rows, hashes in S.shingle_sets(pa.array(some, pa.string())):
            fps = S.fingerprints(rows, hashes, n)
            out += [(hashes[rows == r].tobytes(), fps[r].tobytes()) for r in range(n)]
        return out

    alone = [sets([t])[0] for t in texts]
    assert alone == sets(texts) == sets(texts[::-1])[::-1]
    for t, (h, _) in zip(texts, alone):
        assert len(np.frombuffer(h, np.uint64)) == len(shingles(t))


ODD = [
    (9, "a b c d e f g h i j k"), (3, "A b\tc d e f g h i j k"), (3, "A b\tc d e f g h i j k"),
    (5, None), (6, ""), (8, " \n "), (None, "x y z"), (None, "x y z"), (11, "one"), (12, "two words"),
    (13, "ab " * 30_000), (14, "été là ça"), (15, " "), (16, "Two words"),
]


def test_odd_rows(spark):
    schema = "doc_id long, text string, key string, bands int"
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in ODD], schema)
    kept = S.deduplicate(df)
    assert kept.dtypes == df.dtypes
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids, key=lambda i: (i is None, i or 0)) == [3, 5, 11, 12, 13, 14, 15, None]
    assert S.deduplicate(df.filter("false")).count() == 0
    key = S.with_sketches(df, "doc_id", "text").select("key").collect()
    native = df.select(S.text_key("text").alias("key")).collect()
    assert sorted(bytes(r["key"]) for r in key) == sorted(bytes(r["key"]) for r in native)


def _rows_shuffled(df):
    df.collect()

    def of(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return of(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return of(plan.plan())
        below = plan.children()
        n = sum(of(below.apply(i)) for i in range(below.size()))
        if kind == "ShuffleExchangeExec":
            n += plan.metrics().apply("shuffleRecordsWritten").value()
        return n

    return of(df._jdf.queryExecution().executedPlan())


def test_only_texts_in_pairs_move(spark, monkeypatch):
    rows = _texts(8, 1500, 1, (30, 40))
    texts = dict(rows)
    base = texts[0].split()
    near = " ".join([*base[:-1], "other"])
    rows += [(5000 + i, texts[0]) for i in range(1000)] + [(9000, near)]  # one text of many copies
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = S.saved(df.repartition(3), "t")
    wanted = spark.createDataFrame([(texts[0], near), (texts[1], texts[2])], "a string, b string")
    pairs = S.saved(wanted.select(S.text_key("a").alias("a"), S.text_key("b").alias("b")), "t")
    seen, real = {}, S.saved
    monkeypatch.setattr(S, "saved", lambda df, name: real(seen.setdefault(name, df), name))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with many pairs
    try:
        found = S.verified(pairs, df, "text", 0.8, 5).collect()
        assert _rows_shuffled(seen["similar-sets"]) < 250  # of 2,501
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    md5 = lambda t: hashlib.md5(t.encode()).digest()
    assert [(bytes(r["a"]), bytes(r["b"])) for r in found] == [(md5(texts[0]), md5(near))]


def test_large_tables_go_when_they_are_read(spark, monkeypatch):
    stored, real = {}, S.saved

    def saved(df, name):
        out = real(df, name)
        stored.setdefault(name, []).extend(out.inputFiles())
        return out

    monkeypatch.setattr(S, "saved", saved)
    rows = _texts(9, 30, 4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = S.deduplicate(df, bucket_cap=1)
    there = {n for n, files in stored.items() if any(os.path.exists(urlparse(f).path) for f in files)}
    assert {"similar-texts", "similar-sets", "similar-seats"} < stored.keys()
    assert not there & {"similar-docs", "similar-texts", "similar-sets", "similar-buckets", "similar-seats"}
    for _ in range(2):  # what is left is enough to compute the result again
        assert sorted(r["doc_id"] for r in kept.collect()) == heads(rows)


def test_low_similarities_are_refused(spark):
    with pytest.raises(ValueError):
        S.deduplicate(spark.createDataFrame(ODD, "doc_id long, text string"), similarity=0.5)


def test_bitmaps_leave_all_similar_pairs():
    np = pytest.importorskip("numpy")
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    sets, rows = [], []
    for n in (0, 1, 30, 200, 390):  # of 400 shingles, 0 to 390 are replaced; and far longer texts
        sets += [np.concatenate((base[n:], rng.integers(0, 2**63, n, dtype=np.uint64)))]
    sets += [base[:1], np.concatenate((base, rng.integers(0, 2**63, 9_000, dtype=np.uint64)))]
    sets += [np.concatenate((sets[-1][100:], base[:3]))]
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    maps = S.bitmaps(rows, np.concatenate(sets), len(sets))
    possible = S.similar_at_most(maps, np.array([len(s) for s in sets]), 0.8)
    held = [set(s.tolist()) for s in sets]
    true = np.array([[len(a & b) >= 0.8 * len(a | b) for b in held] for a in held])
    assert possible[true].all() and (possible == possible.T).all()
    assert true[0, 2] and not possible[0, 3] and not possible[0, 5] and not possible[0, 6]
