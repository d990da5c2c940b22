import random

import xxhash
from pyspark.sql import functions as F

from leaksieve.llm import simhash as S
from leaksieve.llm.components import connected_components


def fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(v >> k & 1 for v in h) > len(h))


def roots(values):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= 2:
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {v: find(v) for v in values}


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def test_chains_find_every_pair_within_two_bits():
    rng = random.Random(3)
    chains = S.chain_masks()
    for _ in range(3000):
        x = 0
        for _ in range(rng.randrange(3)):
            x ^= 1 << rng.randrange(64)
        assert any(all((x & m).bit_count() <= b for m, b in c) for c in chains)


def _linked(spark, values, **kw):
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    out = connected_components(S.links(df, **kw), "a", "b")
    return {r["node"]: r["root"] for r in out.collect()}


def _values(seed, n):
    rng = random.Random(seed)
    values = {0, (1 << 64) - 1}
    for _ in range(n):
        v = rng.getrandbits(64)
        for _ in range(rng.randrange(6)):  # chains of near values
            values.add(v)
            v ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
        values.add(v)
    return sorted(values)


def test_links_in_pairs_and_through_centres_agree_with_brute_force(spark):
    values = _values(5, 60)
    want = roots(values)
    groups = lambda m: {frozenset(k for k in m if m[k] == r) for r in m.values()}
    want = {frozenset(signed(v) for v in g) for g in groups(want) if len(g) > 1}
    assert groups(_linked(spark, values)) == want
    assert groups(_linked(spark, values, bucket_cap=1)) == want


def test_components_of_long_paths(spark):
    order = list(range(200))
    random.Random(1).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(199) if i != 100] + [(7, 7), (1, 1)]
    df = spark.createDataFrame(edges + [(None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(df, "a", "b").collect()}
    left, right = min(order[:101]), min(order[101:])
    want = {v: left for v in order[:101]} | {v: right for v in order[101:]}
    assert got == want


TEXTS = [
    (9, "a b c d e f"), (3, "A b\tc d e f"), (3, "A b\tc d e f"), (5, None), (6, ""), (8, " \n "),
    (None, "x y z"), (None, "x y z"), (11, "one"), (12, "two words"), (13, "ab " * 30_000),
    (14, "été là ça"), (15, "q w e r t y u i"),
]


def test_near_duplicates_of_odd_rows(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("fp", F.lit("x"))
    got = sorted(
        (tuple(r) for r in S.near_duplicates(df).collect()), key=lambda r: (r[0] is None, r[0] or 0)
    )
    assert [r[0] for r in got] == sorted((i for i, _ in TEXTS if i is not None)) + [None, None]
    prints = {(i, format(fingerprint(t), "016x")) for i, t in TEXTS}
    assert {r[:2] for r in got} == prints
    root = roots([fingerprint(t) for _, t in TEXTS])
    for i, print_, component in got:
        ids = [j for j, t in TEXTS if root[fingerprint(t)] == root[int(print_, 16)] and j is not None]
        assert component == (min(ids) if ids else None)


def test_one_row_of_each_component_stays(spark):
    schema = "doc_id long, text string, fp string, uid int"
    df = spark.createDataFrame([(i, t, "f", 1) for i, t in TEXTS], schema)
    kept = S.deduplicate(df)
    assert kept.dtypes == df.dtypes
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids, key=lambda i: (i is None, i or 0)) == [3, 5, 11, 12, 13, 14, 15, None]
    empty = df.filter("false")
    assert S.deduplicate(empty).count() == 0 and S.near_duplicates(empty).count() == 0
