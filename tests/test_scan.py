import datetime as dt

import pytest

from leaksieve import (
    Allowlist, Rule, RuleSet, Selection, scan, scan_history, stock_rules, summary,
)
from leaksieve.schema import LEAK_COLUMNS
from leaksieve.sources import corpus

TS = dt.datetime(2023, 6, 1, 2, 9, 42, tzinfo=dt.timezone.utc)
RULES = RuleSet(
    (
        Rule("s", "Secret", 'secret = "[a-z0-9]+"', ("secret",)),
        Rule("d", "Digits", r"\d{4,}", ("1", "2"), Allowlist(commits=("c2",), paths=("/src/b.py",))),
    ),
    Allowlist(paths=("/vendor", r"(.*\.jpg)$"), commits=("c3",)),
)


@pytest.fixture(scope="module")
def history(spark):
    commits = spark.createDataFrame(
        [("r", f"c{i}", None if i == 1 else "ann", "a@x", "msg\n", TS, 480, i) for i in (1, 2, 3)],
        "repo string, commit string, author string, email string, commit_message string,"
        " commit_ts timestamp, offset_minutes int, pos long",
    )
    tree = {
        "/src/a.py": "b1", "/src/b.py": "b2", "/vendor/x.py": "b1", "/.ci/x": "b1", "/p.jpg": "b1",
        "/dup.py": "b1",
    }
    entries = spark.createDataFrame(
        [("r", f"c{i}", p, b) for i in (1, 2, 3) for p, b in tree.items()],
        "repo string, commit string, path string, blob_id string",
    )
    blobs = spark.createDataFrame(
        [("b1", 'x\nsecret = "k1"\r\n12345'), ("b2", "22222"), ("b3", "secret = \"lost\"")],
        "blob_id string, content string",
    )
    refs = spark.createDataFrame(
        [("r", "refs/heads/m", "c2"), ("r", "refs/heads/m2", "c2")],
        "repo string, ref_name string, commit string",
    )
    return commits, entries, blobs, refs


def rows(df):
    return sorted((r["commit"], r["file"], r["rule"], r["line_number"], r["offender"]) for r in df.collect())


def want(commit):
    out = [(commit, f, "Secret", 2, 'secret = "k1"') for f in ("/dup.py", "/src/a.py")]
    if commit != "c2":
        out += [(commit, f, "Digits", 3, "12345") for f in ("/dup.py", "/src/a.py")]
    return out


@pytest.mark.parametrize("narrowed,copies", [(False, 1), (True, 1), (False, 2), (True, 2)])
def test_history(history, narrowed, copies):
    commits, entries, blobs, _ = history
    if copies > 1:
        blobs = blobs.union(blobs)
    leaks = scan_history(
        commits, entries, blobs, RULES, narrowed=narrowed, unique_blobs=copies == 1
    )
    assert tuple(leaks.columns) == LEAK_COLUMNS
    assert rows(leaks) == sorted(want("c1") + want("c2"))
    row = leaks.filter("commit = 'c1' AND file = '/src/a.py' AND rule = 'Secret'").first()
    assert row.asDict() == {
        "line": 'secret = "k1"', "line_number": 2, "offender": 'secret = "k1"', "commit": "c1",
        "repo": "r", "rule": "Secret", "commit_message": "msg\n", "author": "", "email": "a@x",
        "file": "/src/a.py", "date": "2023-05-31 18:09:42 -08:00",
    }


def test_selected(history):
    commits, entries, blobs, refs = history
    leaks, chosen = scan(Selection(branch="m"), RULES, commits, entries, blobs, refs)
    assert rows(leaks) == sorted(want("c2") * 2)
    assert summary(leaks, chosen).first() == (4, 2)
    leaks, chosen = scan(Selection(commit="c3"), RULES, commits, entries, blobs, refs)
    assert summary(leaks, chosen).first() == (0, 1)  # allow-listed, but counted
    leaks, chosen = scan(Selection(user="zoe"), RULES, commits, entries, blobs, refs)
    assert summary(leaks, chosen).first() == (0, 0)


def test_uncommitted(spark, history):
    commits, entries, blobs, _ = history
    files = spark.createDataFrame(
        [("vendor/x.py", "12345"), ("/src/b.py", "12345")], "path string, content string"
    )
    leaks, chosen = scan(Selection(uncommitted=True), RULES, commits, entries, blobs, files=files)
    assert [(r["file"], r["commit"], r["date"]) for r in leaks.collect()] == [("vendor/x.py", "", "")]
    assert summary(leaks, chosen).first() == (1, 0)


@pytest.mark.parametrize("rules", [RULES, stock_rules(())])
def test_blobs_are_selected_before_they_are_searched(spark, history, tmp_path, rules):
    commits, entries, _, _ = history
    path = str(tmp_path / "blobs")
    spark.createDataFrame([("b1", "x")], "blob_id string, content string").write.parquet(path)
    leaks = scan_history(commits, entries, spark.read.parquet(path), rules, narrowed=True)
    plan = leaks._jdf.queryExecution().optimizedPlan().toString().splitlines()
    # From the blob scan upwards: the semi-join with the wanted ids, then the keywords.
    scan = next(i for i, l in enumerate(plan) if "content" in l and "Relation" in l)
    above = list(reversed(plan[:scan]))
    searched = next(i for i, l in enumerate(above) if "rules_called" in l or "Python" in l)
    joined = next(i for i, l in enumerate(above) if "Join LeftSemi" in l)
    assert joined < searched
    physical = leaks._jdf.queryExecution().executedPlan().toString()
    semi = next(l for l in physical.splitlines() if "LeftSemi" in l and "commit" not in l)
    assert "BroadcastHashJoin" in semi  # few ids: no text moves


def test_snapshot_and_objects(history):
    commits, entries, blobs, _ = history
    snap = corpus.snapshot_files(entries, blobs)
    assert snap.count() == 18 and snap.columns == ["repo", "commit", "path", "content"]
    ids = {r[0] for r in corpus.object_ids(commits, entries, blobs).collect()}
    assert ids == {"c1", "c2", "c3", "b1", "b2", "b3"}
    meta = corpus.commit_metadata(commits).filter("commit = 'c1'").first()
    assert meta["author"] == "" and meta["date"] == "2023-05-31 18:09:42 -08:00"


def test_blobs_from_files(spark):
    files = spark.createDataFrame([("/a", "x"), ("/b", "x"), ("/c", "y")], "path string, content string")
    entries, blobs = corpus.blobs_from_files(files)
    assert blobs.count() == 2 and entries.join(blobs, "blob_id").count() == 3
