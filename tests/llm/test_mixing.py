import random
import re

import pytest
from pyspark.sql import functions as F

from leaksieve.llm import mixing as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, mix=M.Mix()):
    """{source: target}; sources in order, None last."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: mix.weights[i % len(mix.weights)] for i, s in enumerate(names)}
    total, capped = mix.share * sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in capped]
        if not rest:
            return {s: mix.cap * sizes[s] for s in names}
        level = (total - sum(mix.cap * sizes[s] for s in capped)) / sum(weight[s] for s in rest)
        over = {s for s in rest if level * weight[s] > mix.cap * sizes[s]}
        if not over:
            return {s: mix.cap * sizes[s] if s in capped else level * weight[s] for s in names}
        capped |= over


def test_flight_keeps_both_totals():
    rng = random.Random(2)
    for n in (3, 10, 500):
        p = [0.3] * n
        sizes = [float(rng.randrange(1, 400)) for _ in range(n)]
        want = sum(a * b for a, b in zip(p, sizes))
        M.flight(p, sizes, rng.random, land=False)
        assert sum(0 < x < 1 for x in p) <= 2
        assert sum(p) == pytest.approx(0.3 * n)
        assert sum(a * b for a, b in zip(p, sizes)) == pytest.approx(want)


def test_flight_keeps_probabilities():
    rng = random.Random(4)
    taken = [0] * 40
    sizes = [float(1 + i % 7 * 10) for i in range(40)]
    for _ in range(2000):
        p = [0.25] * 40
        M.flight(p, sizes, rng.random, land=False)
        taken = [t + x for t, x in zip(taken, p)]
    assert all(abs(t / 2000 - 0.25) < 0.05 for t in taken)


def test_landing_is_close():
    rng = random.Random(6)
    for _ in range(20):
        n = rng.randrange(40, 200)
        p, sizes = [0.7] * n, [float(rng.randrange(1, 900)) for _ in range(n)]
        want = 0.7 * sum(sizes)
        M.flight(p, sizes, rng.random, land=True)
        assert set(p) <= {0.0, 1.0}
        assert abs(sum(a * b for a, b in zip(p, sizes)) - want) < 10


def _docs(spark):
    rng = random.Random(8)
    rows = []
    for i in range(3000):
        source = rng.choice(["a", "a", "a", "b", "c", "d", None])
        rows.append((i, " ".join(["w"] * rng.randrange(60)), source, "x"))
    rows += [(9000, None, "zero", "x"), (9001, " \n", "zero", "x"), (9002, "one\x0bword", "one", "x")]
    rows += [(7, "same row", "b", "x")] * 40
    rows += [(None, "no id", "c", "x")] * 3
    return spark.createDataFrame(rows, "doc_id long, text string, source string, copies string")


@pytest.mark.parametrize("chunk", [4096, 64])
def test_mixture_meets_its_targets(spark, monkeypatch, chunk):
    monkeypatch.setattr(M, "CHUNK", chunk)
    docs = _docs(spark)
    rows = docs.collect()
    size = {}
    for r in rows:
        size[r["source"]] = size.get(r["source"], 0) + len(WORD.findall(r["text"] or ""))
    got = M.mixture(docs).collect()
    assert sorted(map(str, [(r["doc_id"], r["source"]) for r in got])) == sorted(
        map(str, [(r["doc_id"], r["source"]) for r in rows])
    )
    want = targets(size)
    taken = dict.fromkeys(size, 0)
    for r in got:
        assert r["source_size"] == size[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["copies"] <= 2 and r["taken"] == r["size"] * r["copies"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 3 for s in size)
    again = M.mixture(docs).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(again, key=key)


def test_resample_repeats_rows(spark):
    docs = _docs(spark).withColumn("uid", F.lit(1)).withColumn("size", F.lit("s"))
    out = M.resample(docs)
    assert out.dtypes == docs.dtypes
    want = {r["doc_id"]: 0 for r in docs.collect()}
    for r in M.mixture(docs).collect():
        want[r["doc_id"]] += r["copies"]
    for r in out.collect():
        want[r["doc_id"]] -= 1
    assert not any(want.values())


def test_empty(spark):
    docs = _docs(spark).filter("false")
    assert M.mixture(docs).count() == 0 and M.resample(docs).count() == 0
