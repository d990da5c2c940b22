import random

from leaksieve import Allowlist, stock_rules
from leaksieve.operators.paths import has_dot_part, path_pruned, prune_entries, prune_listed
from tests import brute


def kept(spark, paths, entries):
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    return {r[0] for r in df.filter(~path_pruned("path", entries)).collect()}


def test_stock_paths(spark):
    paths = ["/node_modules/a/b.js", "/x/node_modules/y.js", "/foo/bin/z.rs", "/a/pic.jpg", "/ok.rs",
             "/vendored/x", "/README.md", "/a/README.md", "/docs/a.rs", "/doc/a.rs"]
    stock = stock_rules(()).allowlist.paths
    want = {p for p in paths if not brute.pruned(p, stock)}
    assert kept(spark, paths, stock) == want
    assert want == {"/x/node_modules/y.js", "/ok.rs", "/vendored/x", "/a/README.md", "/docs/a.rs"}


def test_random_paths_against_brute_force(spark):
    rng = random.Random(5)
    names = ["a", "bin", "b.jpg", "node_modules", "x.bin", "doc", "(a)$"]
    paths = list({"/" + "/".join(rng.choices(names, k=rng.randint(1, 5))) for _ in range(300)})
    for entries in (
        ["(.*?)(jpg|bin)$", "/a"], ["(a/b.*)$"], ["/a/bin"], [r"(\bdoc\b)$"], ["(^)$"],
        ["(^/a$|doc)$"], ["(?i)(BIN)$"], ["((?i)BIN)$", "(doc)$"], [], ["(a|$|x)$"],
        ["(a)|(bin)$"], ["(a)|b.jpg$", "/doc"], ["(?P<n>doc)$", "(?P<n>bin)$"], ["([[:alpha:]]/a)$"],
    ):
        want = {p for p in paths if not _pruned(p, entries)}
        assert kept(spark, paths, entries) == want, entries


def _pruned(path, entries):
    fixed = [e.replace("((?i)BIN)", "([bB][iI][nN])").replace("[[:alpha:]]", "[A-Za-z]") for e in entries]
    return brute.pruned(path, fixed)


def test_dot_paths(spark):
    df = spark.createDataFrame([(p,) for p in ("/.git/x", "/a/.b", "/a/b.c", ".x", "a.b", "/a./b")], "path string")
    got = [r[0] for r in df.select(has_dot_part("path")).collect()]
    assert got == [True, True, False, True, False, False]


def test_commit_allowlist_drops_entries(spark):
    df = spark.createDataFrame(
        [("r", "c1", "/a", "b"), ("r", "c2", "/a", "b")],
        "repo string, commit string, path string, blob_id string",
    )
    assert [r["commit"] for r in prune_entries(df, Allowlist(commits=("c1",))).collect()] == ["c2"]


def test_a_list_of_100_000_paths_against_brute_force(spark):
    rng = random.Random(6)

    def path(deep):
        return "/" + "/".join(f"d{rng.randint(0, 300)}" for _ in range(rng.randint(2, deep)))

    listed = [path(4) for _ in range(99_000)] + [f"/only/{i}" for i in range(1_000)]
    paths = [path(7) for _ in range(4_000)] + ["/only", "/only/7", "/only/7/x", "/onl", "/only/77x", "/e(.*)$"]
    paths += paths[:50]
    held = set(listed)

    def gone(p):
        parts = p.split("/")
        return any("/".join(parts[:i]) in held for i in range(2, len(parts) + 1))

    schema = "path string, gram int, p int"
    files = spark.createDataFrame([(p, 1, 2) for p in paths] + [(None, 1, 2)], schema)
    table = spark.createDataFrame([(p,) for p in listed + listed[:9] + [None, "(.*)$"]], "name string")
    kept = prune_listed(files, table)
    assert kept.dtypes == files.dtypes
    want = sorted(p for p in paths if not gone(p))
    assert 100 < len(want) < len(paths) - 100
    assert sorted(r["path"] for r in kept.collect()) == want
    assert prune_listed(files, table.filter("false")).count() == len(paths)
    assert prune_listed(files.filter("false"), table).count() == 0
