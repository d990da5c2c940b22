import random

import pytest
from pyspark.sql import functions as F

from leaksieve import Allowlist, Rule, RuleSet, scan_files
from leaksieve.operators.detect import DetectOptions
from leaksieve.operators.layout import running_totals
from leaksieve.plans import large

RULES = RuleSet(
    (
        Rule("k", "Key", r"key[0-9]+", ("key",)),
        # Its keyword may stand in another chunk than its matches.
        Rule("far", "Far", r"[A-Z]{3}", ("zebra", "yak")),
        Rule("line", "Whole line", r"^$", ("yak",)),
        Rule("cr", "CR", r"\r$", ("cr",)),
        Rule("any", "Any", r"q+", ("",), Allowlist(paths=("/b",), stopwords=("qqq",))),
        *(Rule(f"r{i}", f"R{i}", f"zq{i}x", (f"zq{i}",)) for i in range(12)),
    )
)
WORDS = ["key1", "ABC", "", "é", "zebra", "yak", "q", "qqqq", "x\r", "cr", "zq3x", "�", "plain text", "key22 key3"]


def files(seed, n=6, lines=60):
    rng = random.Random(seed)
    out = {}
    for i in range(n):
        rare = rng.sample(WORDS, 6)
        out[f"/{'abcdefgh'[i]}"] = "".join(
            rng.choice(rare) + rng.choice(["\n", "\n", "\r\n", " "]) for _ in range(rng.randrange(lines))
        )
    return out


def key(rows):
    return sorted((r["file"], r["line_number"], r["rule"], r["offender"], r["line"]) for r in rows.collect())


def chunked(texts, rng):
    rows = []
    for path, content in texts.items():
        parts, at = content.split("\n"), 0
        held = ""
        for i, p in enumerate(parts):
            held += p + ("\n" if i < len(parts) - 1 else "")
            if rng.random() < 0.4 and held.endswith("\n"):
                rows.append((path, at, held))
                held, at = "", at + rng.randint(1, 9)
        rows.append((path, at, held))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_chunks_give_what_whole_files_give(spark, seed):
    texts = files(seed)
    whole = spark.createDataFrame(list(texts.items()), "path string, content string")
    rows = chunked(texts, random.Random(seed))
    chunks = spark.createDataFrame([*rows, ("/z", 1, None)], "path string, seq int, content string").repartition(5)
    for options in (DetectOptions(), DetectOptions(ignore_keyword_case=True)):
        want = key(scan_files(whole, RULES, options))
        assert want and key(large.scan_chunks(chunks, RULES, options)) == want


def test_files_are_read_in_splits(spark, tmp_path):
    texts = files(9, n=4, lines=400) | {"/empty": "", "/one": "\n", "/long": "key7 " + "x" * 5000 + "\nkey8"}
    for path, content in texts.items():
        (tmp_path / path[1:]).write_bytes(content.replace("�", "\udcff").encode("utf-8", "surrogateescape"))
    # A CR at the very end counts as part of a line break.
    whole = [(p, c[:-1] if c.endswith("\r") else c) for p, c in texts.items()]
    want = key(scan_files(spark.createDataFrame(whole, "path string, content string"), RULES))
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    try:
        for split in ("700b", "128m"):
            spark.conf.set(name, split)
            chunks = large.read_chunks(spark, str(tmp_path), chunk_bytes=300)
            assert chunks.count() > 10
            got = large.scan_chunks(chunks, RULES)
            short = got.withColumn("file", F.regexp_replace("file", "^.*/", "/"))
            paths = RuleSet(tuple(r for r in RULES.rules if r.id != "any"))
            assert [r for r in key(short) if r[2] != "Any"] == [r for r in want if r[2] != "Any"]
            assert key(large.scan_large_files(spark, str(tmp_path), paths, chunk_bytes=300)) == sorted(
                r for r in key(got) if r[2] != "Any"
            )
    finally:
        spark.conf.set(name, before)


def test_a_keyword_across_chunks_is_refused(spark):
    chunks = spark.createDataFrame([("/a", 1, "x\n")], "path string, seq int, content string")
    with pytest.raises(ValueError):
        large.scan_chunks(chunks, RuleSet((Rule("k", "K", "x", ("a\nb",)),)))
    assert large.scan_chunks(chunks.filter("false"), RULES).count() == 0


def test_running_totals(spark):
    rng = random.Random(3)
    rows = [(g, i, rng.randrange(9)) for g in ("a", "b") for i in rng.sample(range(1000), 200)] + [("c", 1, 5)]
    df = spark.createDataFrame(rows, "g string, at int, v int").repartition(7)
    got = {(r["g"], r["at"]): r["t"] for r in running_totals(df, "g", ["at"], "v", "t").collect()}
    assert got == {(g, at): sum(w for h, b, w in rows if h == g and b < at) for g, at, _ in rows}
