import random
import zlib

import pytest
from pyspark.sql import functions as F

from leaksieve.llm import sharding as S


def _check(rows, docs, shards, slack):
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(i) for i, _ in docs)
    size = [0] * shards
    slots = [[] for _ in range(shards)]
    for r in rows:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert sum(size) == sum(len((t or "").encode()) + 1 for _, t in docs)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert max(size) - min(size) <= slack, size


@pytest.mark.parametrize("bucket", [S.BUCKET_BYTES, 2000])
def test_equal_bytes_and_dense_slots(spark, monkeypatch, bucket):
    monkeypatch.setattr(S, "BUCKET_BYTES", bucket)
    rng = random.Random(1)
    docs = [(i, "é" * rng.randrange(400)) for i in range(3000)]
    docs += [(10_000 + i, "copy " * 30) for i in range(1500)]  # a third of all rows
    docs += [(20_007, "same row")] * 300 + [(None, None)] * 20 + [(20_008, "")] * 5
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("size", F.lit("x"))
    rows = S.shard_documents(df).collect()
    _check(rows, docs, 8, 1200)
    crc = {i: zlib.crc32((t or "").encode()) for i, t in docs}
    assert all(r["text_crc32"] == crc[r["doc_id"]] for r in rows)


def test_copies_stay_together_where_bytes_allow(spark):
    docs = [(i, f"text {i // 3} " + "x" * 50) for i in range(9000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    where = {}
    for r in S.shard_documents(df).collect():
        where.setdefault(docs[r["doc_id"]][1], set()).add(r["shard"])
    assert all(len(s) == 1 for s in where.values())


@pytest.mark.parametrize("n", [0, 1, 3, 8, 9])
def test_few_rows(spark, n):
    docs = [(i, "x" * 100) for i in range(n)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = S.shard_documents(df).collect()
    _check(rows, docs, 8, 202)


def test_one_huge_text(spark):
    docs = [(i, "y" * 10) for i in range(100)] + [(100, "x" * 1_000_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    _check(S.shard_documents(df).collect(), docs, 8, 1_001_100)


def test_texts_keep_their_columns(spark):
    rows = [(i, f"t{i}", "a", i, "b") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k1 string, shard int, bucket string")
    out = S.shard_texts(df)
    assert out.columns == [*df.columns, "shard_", "slot"]
    assert sorted(tuple(r)[:5] for r in out.collect()) == sorted(rows)


def test_key_order_is_that_of_the_numbers():
    rng = random.Random(2)
    top = 1 << 63
    keys = [tuple(rng.choice([rng.randrange(-top, top), 0, -1, -top]) for _ in range(3)) for _ in range(500)]
    packed = S._packed(keys)
    order = sorted(range(500), key=lambda i: keys[i])
    assert [keys[i] for i in packed.argsort(kind="stable")] == [keys[i] for i in order]
