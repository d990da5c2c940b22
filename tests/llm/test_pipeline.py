"""The queries against their SQL, and the stages against each other, on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

import corpus_pipeline as P  # noqa: E402
from leaksieve.llm import decontam, mixing, quality, queries  # noqa: E402
from leaksieve.llm.common import saved, table  # noqa: E402
from tests.llm.test_similar import heads  # noqa: E402
from tools.check import TABLES, compare  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ok, what, _ = compare(spark, con, name, SF)
    assert ok, what


def test_one_query_per_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert [n for n, _ in P.STAGES] == [
        "quality_rules", "near_dedup", "decontamination", "mixing", "sharding"
    ]


def test_stages(spark):
    docs = table(spark, SF, "documents")
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    good = saved(P.quality_rules(spark, docs, SF), "t")
    judged = quality.judge(docs, table(spark, SF, "labels"))
    assert good.columns == docs.columns and ids(good) == ids(judged.filter("kept"))
    single = saved(P.near_dedup(spark, good, SF), "t")
    texts = [tuple(r) for r in good.select("doc_id", "text").collect()]
    assert single.columns == docs.columns and ids(single) == heads(texts)
    clean = saved(P.decontaminated(spark, single, SF), "t")
    held = decontam.contained_items(single, table(spark, SF, "benchmark"))
    assert ids(clean) == sorted(set(ids(single)) - set(ids(held)))
    mixed = saved(P.mixed(spark, clean, SF), "t")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mixture(clean).collect()}
    assert ids(mixed) == sorted(i for i, n in copies.items() for _ in range(n))
    out = saved(P.sharded(spark, mixed, SF), "t")
    assert ids(out) == ids(mixed)
    assert ids(P.run(spark, SF)) == ids(out)


def test_empty_documents(spark):
    docs = table(spark, SF, "documents").filter("false")
    for _, stage in P.STAGES:
        docs = saved(stage(spark, docs, SF), "t")
    assert docs.count() == 0


def test_odd_rows_through_all_stages(spark):
    docs = table(spark, SF, "documents")
    odd = [
        (None, None, None, None, None), (-1, None, "en", "s", 0), (-2, "", None, "s", 0),
        (-3, " \n ", "en", None, 3), (-4, "word " * 200_000, "en", "s", None),
        (None, "some words without an id, twenty of them or more: " + "a b c d e f g h i j k l m n", "en", "s", 1),
    ]
    rows = docs.unionByName(docs.limit(20)).unionByName(
        spark.createDataFrame(odd * 2, docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
        .select(docs.columns)
    )
    rows = saved(rows.withColumn("fp", rows.doc_id).withColumn("copies", rows.lang), "t")
    out = rows
    for name, stage in P.STAGES:
        before, out = out, saved(stage(spark, out, SF), "t")
        if name != "sharding":
            assert out.columns == rows.columns
        if name in ("quality_rules", "near_dedup", "decontamination"):
            assert out.count() <= before.count()
            assert out.exceptAll(before).isEmpty()
        if name == "near_dedup":
            again = saved(stage(spark, out, SF), "t")  # what is left has no near copies
            assert again.exceptAll(out).isEmpty() and out.exceptAll(again).isEmpty()
    assert out.count() > 0
