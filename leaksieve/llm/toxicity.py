"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are words, word pairs and pairs with one word between, hashed to 32 bits; each
is present or not. Training follows McMahan et al., "Ad Click Prediction" (2013): each coordinate
has its own learning rate, and the L1 term keeps most weights at exactly zero, so the
model is a short list of (hash, weight).

It is fitted on at most ``max_train_rows`` labelled rows, chosen by a hash of their id
(a documented bound: the fit runs in one task, and more rows would not change it much).
Scoring covers every text; a text stays where it was read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaksieve.llm.common import saved
from leaksieve.llm.texthash import (
    BASE,
    MIX_1,
    SpanHasher,
    blocks,
    mixed,
    spans,
    word_bytes,
)

MAX_TRAIN_ROWS = 12_000


@dataclass(frozen=True)
class Ftrl:
    """Training parameters; ``min_docs`` drops features seen in fewer documents."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.5
    epochs: int = 4
    min_docs: int = 2


@dataclass(frozen=True)
class Model:
    """Sorted feature hashes with their weights, and the bias."""

    hashes: object
    weights: object
    bias: float


def features(texts, hasher) -> Iterator[tuple]:
    """(first row, row count, hashes, rows): all grams of a block of texts."""
    import numpy as np
    import pyarrow.compute as pc

    inside = word_bytes()
    for first, count, data, offsets in blocks(pc.utf8_lower(texts)):
        starts, ends, row = spans(data, offsets, inside)
        h = hasher.hashes(data, starts, ends)
        grams, rows = [h], [row]
        for gap, salt in ((1, BASE), (2, MIX_1)):
            if len(h) > gap:
                same = row[:-gap] == row[gap:]
                grams.append(mixed(h[:-gap][same] * np.uint64(salt) + h[gap:][same]))
                rows.append(row[:-gap][same])
        all_grams = (np.concatenate(grams) >> np.uint64(32)).astype(np.uint32)
        yield first, count, all_grams, np.concatenate(rows)


def train_ftrl(examples: list[tuple], params: Ftrl) -> Model:
    """``examples``: (distinct hashes, label). One pass per epoch, in the given order."""
    import numpy as np

    if not examples:
        return Model(np.zeros(0, np.uint32), np.zeros(0, np.float32), 0.0)
    seen, docs = np.unique(np.concatenate([h for h, _ in examples]), return_counts=True)
    seen = seen[docs >= params.min_docs]
    rows = []
    for h, y in examples:
        at = np.searchsorted(seen, h)
        known = at < len(seen)
        known[known] = seen[at[known]] == h[known]
        rows.append((np.append(at[known], len(seen)), y))  # the last one is the bias
    z, n = np.zeros(len(seen) + 1), np.zeros(len(seen) + 1)
    l1 = np.full(len(seen) + 1, params.l1)
    l1[-1] = 0

    def weights(i):
        shrunk = np.sign(z[i]) * l1[i] - z[i]
        rate = (params.beta + np.sqrt(n[i])) / params.alpha + params.l2
        return np.where(np.abs(z[i]) > l1[i], shrunk / rate, 0.0)

    for _ in range(params.epochs):
        for i, y in rows:
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / params.alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange(len(seen) + 1))
    kept = np.flatnonzero(w[:-1])
    return Model(seen[kept], w[kept].astype(np.float32), float(w[-1]))


def training_ids(labels: DataFrame, usable: Column, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """(doc_id, label) of at most ``max_rows`` labelled rows, in the order of a hash.

    Rows with a null id or label do not count; of repeated ids the largest label holds.
    """
    return saved(
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & usable)
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows),
        "toxic-ids",
    )


def fit(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column,
    params: Ftrl = Ftrl(),
    max_rows: int = MAX_TRAIN_ROWS,
) -> Model:
    """The model from (doc_id, text) and (doc_id, toxic); ``usable`` tells by ``doc_id``
    which rows may be learned from."""
    chosen = training_ids(labels, usable, max_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        hasher = SpanHasher()
        for batch in batches:
            ids, texts, label = batch.columns
            for first, n, grams, rows in features(texts, hasher):
                order = np.argsort(rows, kind="stable")
                grams, rows = grams[order], rows[order]
                cut = np.searchsorted(rows, np.arange(n + 1))
                hs = [np.unique(grams[cut[r] : cut[r + 1]]).tobytes() for r in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, n), label.slice(first, n), pa.array(hs, pa.binary())],
                    names=["doc_id", "label", "hashes"],
                )

    def learn(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        examples = []
        for batch in batches:
            for _, y, h in zip(*(x.to_pylist() for x in batch.columns)):
                examples.append((np.frombuffer(h, np.uint32), y))
        m = train_ftrl(examples, params)
        hashes = pa.array(np.append(m.hashes.astype(np.int64), -1))
        values = pa.array(np.append(m.weights.astype(np.float64), m.bias))
        yield pa.RecordBatch.from_arrays([hashes, values], names=["hash", "weight"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    counted = texts.mapInArrow(count, f"doc_id {kind}, label double, hashes binary")
    rows = (
        counted.repartition(1)
        .sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "hashes")
        .mapInArrow(learn, "hash long, weight double")
        .toPandas()
    )
    import numpy as np

    rows = rows.sort_values("hash")
    bias = float(rows.loc[rows["hash"] < 0, "weight"].sum())
    rows = rows[rows["hash"] >= 0]
    return Model(rows["hash"].to_numpy(np.uint32), rows["weight"].to_numpy(np.float32), bias)


def score_texts(texts, model: Model, hasher):
    """numpy array of scores from 0 to 1 of an Arrow array of texts."""
    import numpy as np

    out = np.full(len(texts), model.bias)
    if len(model.hashes):
        maybe = np.zeros(1 << 16, bool)
        maybe[model.hashes & 0xFFFF] = True
        for first, n, grams, rows in features(texts, hasher):
            some = np.flatnonzero(maybe[grams & 0xFFFF])
            grams, rows = grams[some], rows[some]
            at = np.minimum(np.searchsorted(model.hashes, grams), len(model.hashes) - 1)
            hit = model.hashes[at] == grams
            found = np.unique(np.stack((rows[hit], at[hit])), axis=1)  # each feature once
            w = model.weights[found[1]].astype(np.float64)
            out[first : first + n] += np.bincount(found[0], weights=w, minlength=n)
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of (doc_id, text). A null or empty text gets the
    score of the bias. Repeated rows stay; an empty table gives none."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        hasher = SpanHasher()
        for batch in batches:
            ids, texts = batch.columns
            scores = pa.array(score_texts(texts, model, hasher))
            yield pa.RecordBatch.from_arrays([ids, scores], names=["doc_id", "score"])

    narrow = docs.select("doc_id", "text")
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, score double")
