import subprocess
from hashlib import sha1

import pytest

from leaksieve.sources import corpus
from leaksieve.sources import worktree as W

FILES = "path string, content binary"
TREE = "path string, blob_id string, kind string"


def oid(data):
    return sha1(b"blob %d\0" % len(data) + data).hexdigest()


def tree(spark, files, modules=()):
    rows = [("/" + p, oid(c), "blob") for p, c in files.items()]
    return spark.createDataFrame(rows + [("/" + m, "0" * 40, "commit") for m in modules], TREE)


def listing(spark, files):
    return spark.createDataFrame([(p, bytearray(c)) for p, c in files.items()], FILES)


def states(df):
    return {r["path"]: r["state"] for r in df.collect()}


HEAD = {"a": b"1", "sub/b": b"\xff\x00", "c": b"", "d": b"x", "e": b"e"}
WORK = {"a": b"1", "sub/b": b"\xff\x01", "c": b"", "new": b"", "mod/x": b"1", "mod2/y/z": b"2", "mod2x": b"3", "e": b"e"}


def test_status(spark):
    head, files = tree(spark, HEAD, ["mod", "mod2/y"]), listing(spark, WORK)
    want = {"sub/b": "modified", "d": "deleted", "new": "untracked", "mod2x": "untracked"}
    assert states(W.status(head, files)) == want
    row = W.status(head, files).filter("path = 'sub/b'").first()
    assert (row["head_id"], row["staged_id"], row["work_id"]) == (oid(b"\xff\x00"), oid(b"\xff\x00"), oid(b"\xff\x01"))
    # Without a column for the kind there are no submodules.
    plain = states(W.status(head.drop("kind").filter("blob_id != repeat('0', 40)"), files))
    assert plain == want | {"mod/x": "untracked", "mod2/y/z": "untracked"}


def test_status_with_an_index(spark):
    index = HEAD | {"a": b"2", "e": b"staged", "new": b""}
    del index["d"]
    got = states(W.status(tree(spark, HEAD), listing(spark, WORK | {"e": b"staged"}), tree(spark, index)))
    want = {"a": "modified", "sub/b": "modified", "d": "deleted", "new": "staged", "e": "staged"}
    assert got == want | {"mod/x": "untracked", "mod2/y/z": "untracked", "mod2x": "untracked"}


def test_uncommitted_files(spark):
    head, files = tree(spark, HEAD, ["mod", "mod2/y"]), listing(spark, WORK)
    got = {r["path"]: bytes(r["content"]) for r in W.uncommitted(head, files, on_deleted="skip").collect()}
    assert got == {p: WORK[p] for p in ("sub/b", "new", "mod2x")}
    with pytest.raises(Exception, match="deleted file: d"):
        W.uncommitted(head, files).collect()
    with pytest.raises(ValueError):
        W.uncommitted(head, files, on_deleted="keep")


def test_empty_sides(spark):
    none = listing(spark, {})
    assert states(W.status(tree(spark, {}), none)) == {}
    assert states(W.status(tree(spark, {"a": b""}), none)) == {"a": "deleted"}
    assert states(W.status(tree(spark, {}), listing(spark, {"a": b""}))) == {"a": "untracked"}


def test_a_changed_folder_is_scanned(spark, tmp_path):
    for path, content in {"a": b"1", "sub/b": b"2", "c": b"3"}.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_bytes(content)
    head = tree(spark, {"a": b"1", "sub/b": b"old"})
    got = {r["path"]: r["content"] for r in corpus.working_tree(spark, str(tmp_path), head=head).collect()}
    assert got == {"sub/b": "2", "c": "3"}


def test_ids_are_those_of_the_store(spark):
    for data in (b"", b"hello\n", bytes(range(256))):
        out = subprocess.run(["git", "hash-object", "--stdin"], input=data, capture_output=True, check=True)
        df = spark.createDataFrame([(bytearray(data),)], "content binary")
        assert df.select(W.blob_object_id("content")).first()[0] == out.stdout.decode().strip()
