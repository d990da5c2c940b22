"""Nested trees against a plain walk; pruned folders are not looked up."""

import random

import pytest

from leaksieve import Allowlist
from leaksieve.sources.trees import descend, entries_from_trees
from tests import brute

COMMITS = "repo string, commit string, tree_id string"
TREES = "tree_id string, name string, kind string, child string"


def walk(trees, tree, prefix, allow):
    for name, kind, child in trees.get(tree, ()):
        path = f"{prefix}/{name}"
        if name.startswith(".") or brute.pruned(path, allow.paths):
            continue
        if kind == "blob":
            yield path, child
        elif kind == "tree":
            yield from walk(trees, child, path, allow)


def test_random_trees_against_a_walk(spark):
    rng = random.Random(8)
    names = ["a", "bin", "src", ".git", "b.jpg", "x.rs", "node_modules", "doc", "été"]
    trees, below = {}, []
    for i in range(20):  # trees hold earlier ones only; many are shared
        held = {}
        for name in rng.sample(names, rng.randint(0, 6)):
            kind = rng.choice(["blob", "blob", "commit", "tree"] if below else ["blob"])
            held[name] = (name, kind, rng.choice(below) if kind == "tree" else f"b{rng.randint(0, 9)}")
        trees[f"t{i}"] = list(held.values())
        below = (below + [f"t{i}"])[-8:]
    commits = [(f"r{i % 2}", f"c{i}", f"t{rng.randint(8, 19)}") for i in range(40)]
    commits += [("r0", "lost", "unknown"), ("r0", "none", None), commits[0]]
    rows = [(t, *e) for t, held in trees.items() for e in held]
    df = spark.createDataFrame(rows + rows[:20] + [("t19", None, "blob", "b1")], TREES)
    for allow in (
        Allowlist(), Allowlist(paths=("(bin|jpg)$", "/src/a")), Allowlist(paths=("/doc",), commits=("c1", "c2"))
    ):
        got = entries_from_trees(spark.createDataFrame(commits, COMMITS), df, allow)
        want = [
            (repo, commit, path, blob) for repo, commit, tree in set(commits)
            if commit not in allow.commits for path, blob in walk(trees, tree, "", allow)
        ]
        assert len(want) > 20 and sorted(map(tuple, got.collect())) == sorted(want)


def test_pruned_folders_are_not_looked_up_and_shared_ones_once(spark):
    trees = [(f"root{i}", "lib", "tree", "lib") for i in range(50)]
    trees += [(f"root{i}", f"f{i}", "blob", "b") for i in range(50)]
    trees += [("root0", "bin", "tree", "bad"), ("root1", ".x", "tree", "bad"), ("root2", "l", "tree", "link")]
    trees += [("lib", "x.rs", "blob", "b1"), ("lib", "deep", "tree", "deep"), ("deep", "y.rs", "blob", "b2")]
    trees += [("bad", "z", "symbol", "s")]  # an error where it is read
    df = spark.createDataFrame(trees, TREES)
    commits = spark.createDataFrame([("r", f"c{i}", f"root{i}") for i in range(50)], COMMITS)
    allow = Allowlist(paths=("(bin)$",))
    levels = descend(commits, df, allow)
    assert [files.count() for _, files in levels] == [50, 1, 1]
    assert [folders.count() for folders, _ in levels] == [51, 1, 0]
    assert entries_from_trees(commits, df, allow).count() == 150
    same = spark.createDataFrame([("r", f"c{i}", "root7") for i in range(50)], COMMITS)
    assert [files.count() for _, files in descend(same, df, allow)] == [1, 1, 1]
    with pytest.raises(Exception, match="unknown kind"):
        entries_from_trees(commits, df, Allowlist()).count()


def test_empty_tables(spark):
    none = spark.createDataFrame([], TREES)
    commits = spark.createDataFrame([("r", "c", "t")], COMMITS)
    assert entries_from_trees(commits, none, Allowlist()).count() == 0
    assert entries_from_trees(commits.filter("false"), none, Allowlist()).columns == [
        "repo", "commit", "path", "blob_id"
    ]


def test_nested_trees_are_made_once_per_different_listing(spark, monkeypatch):
    """No stored table has more rows than there are commits, which hold three files each."""
    from workload import model as M

    sf, sizes, real = "/root/testdata/sf0.001", [], M.stored

    def counted(df):
        out = real(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(M, "stored", counted)
    commits, made = M.nested_trees(spark, sf)
    assert commits.count() == M.commits(spark, sf).count() >= max(sizes)
    assert made.count() > 0
