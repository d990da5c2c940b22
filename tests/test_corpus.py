import os

import pytest

from leaksieve import Rule, RuleSet, scan_files
from leaksieve.errors import EmptyCatalog
from leaksieve.sources import corpus
from leaksieve.streaming import files as S

RULES = RuleSet((Rule("k", "Key", "key[0-9]+", ("key",)),))
CATALOG = "[[rules]]\nid='a'\ndescription='{}'\nregex='x'\nkeywords=['x']\n"


def make_tree(folder):
    os.makedirs(folder / "sub" / ".git")
    (folder / "a.txt").write_bytes(b"x\nkey1\n")
    (folder / "sub" / "b c.txt").write_bytes("é key2".encode())
    (folder / "sub" / ".git" / "HEAD").write_bytes(b"key3")


def test_working_tree(spark, tmp_path):
    make_tree(tmp_path)
    files = corpus.working_tree(spark, str(tmp_path))
    got = {r["path"]: r["content"] for r in files.collect()}
    assert got == {"a.txt": "x\nkey1\n", "sub/b c.txt": "é key2"}
    leaks = scan_files(files, RULES).collect()
    assert sorted((r["file"], r["line_number"], r["offender"]) for r in leaks) == [
        ("a.txt", 2, "key1"), ("sub/b c.txt", 1, "key2"),
    ]


def test_working_tree_with_bad_bytes(spark, tmp_path):
    make_tree(tmp_path)
    (tmp_path / "bad").write_bytes(b"key9\xff")
    with pytest.raises(Exception, match="not UTF-8: bad"):
        corpus.working_tree(spark, str(tmp_path)).collect()
    flagged = corpus.working_tree(spark, str(tmp_path), "flag").collect()
    assert {r["path"]: r["valid"] for r in flagged} == {"a.txt": True, "sub/b c.txt": True, "bad": False}
    files = corpus.working_tree(spark, str(tmp_path), "replace")
    assert files.filter("path = 'bad'").first()["content"] == "key9�"


def test_decode_files(spark):
    rows = [("/a", "é".encode()), ("/b", b"\xe9x"), ("/c", b"")]
    files = spark.createDataFrame([(p, bytearray(b)) for p, b in rows], "path string, content binary")
    got = {r["path"]: (r["content"], r["valid"]) for r in corpus.decode_files(files, "flag").collect()}
    assert got == {"/a": ("é", True), "/b": ("\ufffdx", False), "/c": ("", True)}


def test_config_from_corpus(spark):
    commits = spark.createDataFrame([("r", f"c{i}", i) for i in range(4)], "repo string, commit string, pos long")
    entries = spark.createDataFrame(
        [("r", "c0", "/sub/rules.toml", "b0"), ("r", "c3", "/rules.toml", "b3"),
         ("r", "c2", "/rules.toml", "b2"), ("r", "c2", "/.rules.toml", "b1")],
        "repo string, commit string, path string, blob_id string",
    )
    blobs = spark.createDataFrame(
        [(f"b{i}", CATALOG.format(i)) for i in range(4)], "blob_id string, content string"
    )
    names = ("rules.toml", ".rules.toml")
    rules = corpus.rules_from_corpus(commits, entries, blobs, names)
    assert rules.rules[0].description == "1"
    with pytest.raises(EmptyCatalog):
        corpus.rules_from_corpus(commits, entries, blobs, ("none.toml",))


def test_stream(spark, tmp_path):
    tree, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    tree.mkdir()
    (tree / "a.txt").write_bytes(b"key1\nkey2")

    def run():
        leaks = S.scan_stream(S.arriving_files(spark, str(tree)), RULES)
        S.write_stream(leaks, str(out), str(state), once=True).awaitTermination()
        return sorted(r["offender"] for r in spark.read.parquet(str(out)).collect())

    assert run() == ["key1", "key2"]
    (tree / "b.txt").write_bytes(b"key3")
    assert run() == ["key1", "key2", "key3"]
    assert run() == ["key1", "key2", "key3"]


def test_config_of_each_repository(spark):
    commits = spark.createDataFrame(
        [(r, f"{r}{i}", i // 2) for i in range(4) for r in "ab"], "repo string, commit string, pos long"
    )
    entries = spark.createDataFrame(
        [("a", "a2", "/c.toml", "b2"), ("a", "a3", "/.c.toml", "b1"), ("b", "b1", "/c.toml", "b0"),
         ("b", "b2", "/c.toml", "b2")],
        "repo string, commit string, path string, blob_id string",
    )
    blobs = spark.createDataFrame([(f"b{i}", CATALOG.format(i)) for i in range(3)], "blob_id string, content string")
    names = ("c.toml", ".c.toml")
    got = corpus.config_from_corpus(commits, entries, blobs, names).collect()
    assert sorted((r["repo"], r["commit"]) for r in got) == [("a", "a3"), ("b", "b1")]
    assert corpus.rules_from_corpus(commits, entries, blobs, names, "b").rules[0].description == "0"
    with pytest.raises(ValueError):
        corpus.rules_from_corpus(commits, entries, blobs, names)
