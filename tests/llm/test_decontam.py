import random
import re

from pyspark.sql import functions as F

from leaksieve.llm import decontam as D

WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")


def words(text):
    return WORD.findall((text or "").lower())


def runs(w, k):
    return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)}


def shingles(text):
    w = words(text)
    return runs(w, min(5, len(w))) if w else set()


def contained(docs, items):
    out = []
    for d, text in docs:
        w = words(text)
        by = {k: runs(w, k) for k in range(1, 6)}
        for i, t in items:
            s = shingles(t)
            own = by[min(5, len(words(t)))] if s else set()
            if s and len(s & own) * 10 >= 8 * len(s):
                out.append((d, i, len(s), len(s & own)))
    return sorted(map(str, out))


def _tables(spark):
    rng = random.Random(1)
    word = lambda: f"w{rng.randrange(4000)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 4, 5, 6, 9, 20, 60, 300])))) for i in range(60)]
    items += [(60, items[7][1]), (61, None), (62, "  .,"), (63, "Été, déjà vu: ça va bien!")]
    items += [(64, items[8][1].upper()), (65, "What is love?"), (66, "ça va"), (None, "What is love?"), (65, "What is love?")]
    docs = []
    for i in range(300):
        w = [word() for _ in range(rng.randrange(80))]
        if i % 2:
            item = WORD.findall(items[rng.randrange(60)][1])
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                item[rng.randrange(len(item))] = word()
            w[len(w) // 2 : len(w) // 2] = item
        docs.append((i, rng.choice([" ", "\n", ", "]).join(w).upper()))
    docs += [(400, None), (401, ""), (402, items[0][1]), (402, items[0][1]), (None, items[8][1])]
    docs += [(403, "x " * 100_000 + items[9][1] + " y" * 100_000), (404, "il a ÉTÉ DÉJÀ-VU ça va bien"),
             (405, items[8][1] + " " + items[10][1]), (406, "He said: what IS love, and left the room now"),
             (407, "what is"), (408, "what is love"), (409, "what is lovely")]
    return docs, items


def test_contained_items_are_those_of_brute_force(spark):
    docs, items = _tables(spark)
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = contained(docs, items)
    assert len(want) > 40
    for block in (D.BLOCK_BYTES, 500):
        got = D.contained_items(d, b, block_bytes=block)
        assert sorted(str(tuple(r)[:4]) for r in got.collect()) == want
    ids = {r["doc_id"] for r in got.collect()}
    for block in (D.BLOCK_BYTES, 500):
        clean = D.decontaminate(d, b, block_bytes=block)
        assert clean.schema == d.schema
        assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(
            str(i) for i, _ in docs if i not in ids
        )


def test_empty(spark):
    d = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    none = F.lit(False)
    assert D.contained_items(d, b).count() == 1
    assert D.contained_items(d.filter(none), b).count() == 0
    assert D.contained_items(d, b.filter(none)).count() == 0
    assert D.decontaminate(d, b.filter(none)).count() == 1
    assert D.decontaminate(d, b.withColumn("text", F.lit(None).cast("string"))).count() == 1


def test_the_sketch_loses_nothing():
    rng = random.Random(7)
    for n in (5, 9, 15, 16, 40, 63, 64, 200, 300):
        text = " ".join(f"t{rng.getrandbits(40)}" for _ in range(n))
        index = D.build_index([(1, text)])
        size = len(shingles(text))
        missing = size - -(-size * 8 // 10)
        assert len(index.hashes) - missing >= index.needs[0] >= 1


def test_items_without_a_word(spark):
    d = spark.createDataFrame([(1, "a b c d e f"), (2, None)], "doc_id long, text string")
    b = spark.createDataFrame([(1, " "), (2, ".,!"), (3, "")], "item_id long, text string")
    assert D.contained_items(d, b).count() == 0
    assert D.decontaminate(d, b).count() == 2
    named = spark.createDataFrame([("x", "C d"), (None, ",")], "item_id string, text string")
    assert [tuple(r)[:2] for r in D.contained_items(d, named).collect()] == [(1, "x")]
