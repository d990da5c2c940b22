import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from leaksieve.llm import toxicity as T
from leaksieve.llm.texthash import SpanHasher

BAD = ["vile", "rotten", "scum"]


def _docs(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            for b in rng.sample(BAD, 2):
                w.insert(rng.randrange(len(w)), b)
        rows.append((i, " ".join(w), "x", int(toxic)))
    return rows


def test_features_are_words_pairs_and_skips():
    def grams(text):
        return {int(h) for _, _, g, _ in T.features(pa.array([text]), SpanHasher()) for h in g}

    assert len(grams("a b c")) == 3 + 2 + 1
    assert grams("a b c") & grams("A, B! d") == grams("a b")
    assert grams("a x c") & grams("a y c") == grams("a x c") & grams("a y c")
    assert len(grams("a x c") & grams("a y c")) == 3  # a, c and the skip
    assert grams("") == set()


def test_l1_keeps_the_model_short():
    hasher = SpanHasher()
    rows = _docs(600, 1)
    examples = []
    for _, text, _, y in rows:
        ((_, _, g, _),) = T.features(pa.array([text]), hasher)
        examples.append((np.unique(g), float(y)))
    model = T.train_ftrl(examples, T.Ftrl())
    assert 3 <= len(model.hashes) < 100
    assert list(model.hashes) == sorted(model.hashes)
    empty = T.train_ftrl([], T.Ftrl())
    assert len(empty.hashes) == 0 and empty.bias == 0


def test_held_out_accuracy_and_odd_rows(spark):
    rows = _docs(1500, 2)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame(
        [(r[0], 1, r[3]) for r in rows] + [(3, 1, None), (None, 1, 1)],
        "doc_id long, quality int, toxic int",
    )
    odd = spark.createDataFrame(
        [(-1, None, ""), (-2, "", ""), (None, "vile scum", ""), (-3, "w1 " * 200_000 + "vile scum", ""),
         (-4, "VILE, scum.", ""), (-4, "VILE, scum.", "")],
        docs.schema,
    )
    model = T.fit(docs, labels, F.col("doc_id") % 4 != 2)
    out = T.score(docs.unionByName(odd), model).collect()
    assert len(out) == 1506
    truth = {r[0]: r[3] for r in rows}
    held = [(truth[r["doc_id"]], r["score"]) for r in out if r["doc_id"] in truth and r["doc_id"] % 4 == 2]
    assert all((s >= 0.3) == bool(y) for y, s in held)
    odd = {}
    for r in out:
        if r["doc_id"] not in truth:
            odd.setdefault(r["doc_id"], []).append(r["score"])
    assert odd[-1] == odd[-2] and odd[-1][0] < 0.3
    assert odd[None][0] >= 0.3 and odd[-3][0] >= 0.3 and len(set(odd[-4])) == 1 and odd[-4][0] >= 0.3


def test_each_feature_counts_once():
    model = T.Model(np.zeros(0, np.uint32), np.zeros(0, np.float32), 0.5)
    hasher = SpanHasher()
    ((_, _, g, _),) = T.features(pa.array(["vile"]), hasher)
    model = T.Model(np.sort(g), np.ones(len(g), np.float32), 0.5)
    one, three = T.score_texts(pa.array(["vile", "vile x vile y z vile"]), model, hasher)
    assert one == three == 1 / (1 + np.exp(-1.5))


def test_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = T.fit(docs, labels, F.lit(True))
    assert {r["score"] for r in T.score(docs, model).collect()} == {0.5}
    assert T.score(docs.filter("false"), model).count() == 0


def test_the_bound_on_training_rows(spark):
    labels = spark.range(500).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    ids = [r["doc_id"] for r in T.training_ids(labels, F.col("doc_id") >= 100, 50).collect()]
    assert len(ids) == 50 and min(ids) >= 100
    assert ids == [r["doc_id"] for r in T.training_ids(labels, F.col("doc_id") >= 100, 50).collect()]
