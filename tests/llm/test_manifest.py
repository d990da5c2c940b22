import random
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from leaksieve.llm import manifest as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, digest string, pos int"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def up(nodes):
    """All levels of a tree over ``nodes``, written from the definition."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H(*last[i : i + 8]) for i in range(0, len(last), 8)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        run = level[i // 8 * 8 : i // 8 * 8 + 8]
        out.append(run[: i % 8] + run[i % 8 + 1 :])
        i //= 8
    return out


def brute(rows):
    """Everything hashed anew for each row."""
    lower = str.maketrans(M.UPPER, M.LOWER)
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        ordered = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, H(*map(field, r))))
        trees[g] = (ordered, up([H(*map(field, r)) for r in ordered]))
    upper = up([trees[g][1][-1][0] for g in names])
    root = upper[-1][0]
    out = []
    for at, g in enumerate(names):
        ordered, levels = trees[g]
        for i, r in enumerate(ordered):
            sib = siblings(levels, i) + siblings(upper, at)
            changed = list(r)
            if r[0] is not None and crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                changed[4] = r[4].translate(lower)
            new = list(levels[0])
            new[i] = H(*map(field, changed))
            subroots = list(upper[0])
            subroots[at] = up(new)[-1][0]
            folded = up(subroots)[-1][0]
            proof = H(*(s for level in sib for s in level))
            out.append((r[0], levels[0][i], levels[-1][0], root, proof, folded, folded == root))
    return out


def proved(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    m = M.build(df, changed=("text", M.lower_ascii(F.col("text"))), is_changed=crc % 3 == 0)
    return m, [tuple(r) for r in M.prove(m).collect()]


def same(a, b):
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(a, key=key) == sorted(b, key=key)


def make(rng, i, langs):
    text = rng.choice([None, "", "abc", "Ab CÄ é", "Word " * rng.randrange(5), "X" * 100_000])
    return (i, rng.choice(["a", None, "b:-"]), rng.choice(langs), rng.choice([None, i]), text)


def test_random_tables_against_hashing_everything_anew(spark):
    rng = random.Random(4)
    rows = [make(rng, i, [None, "", "en", "de", "é", "￮", "\U0001f600"]) for i in range(90)]
    rows += [rows[3], rows[3], (None, None, None, None, None), (None, "s", "en", 1, "T")]
    _, got = proved(spark, rows)
    same(got, brute(rows))
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_more_than_one_block_and_more_groups_than_a_run(spark):
    rng = random.Random(9)
    rows = [(i, "s", "en", 1, f"Text {i}") for i in range(M.BLOCK * 2 + 1)]
    rows += [(i, "s", "de", 1, f"t {i}") for i in range(M.BLOCK)]
    rows += [(i, None, f"l{i}", 2, "Abc") for i in range(5000, 5000 + 70)]
    rng.shuffle(rows)
    m, got = proved(spark, rows)
    same(got, brute(rows))
    assert m.roots().count() == 72


@pytest.mark.parametrize("n", [1, 8, 9])
def test_small_tables(spark, n):
    rows = [(i, None, "en", None, "Q") for i in range(n)]
    _, got = proved(spark, rows)
    same(got, brute(rows))


def test_empty_table(spark):
    _, got = proved(spark, [])
    assert got == []


def test_a_fold_hashes_only_what_is_to_the_right():
    run = [H(str(i)).encode() for i in range(8)]
    parent = M.Parent(run)
    for slot in range(8):
        new = [*run[:slot], b"f" * 64, *run[slot + 1 :]]
        assert parent.fold(slot, b"f" * 64) == M.Parent(new).digest
        assert parent.fold(slot, run[slot]) == parent.digest


def test_paths_round_trip():
    digests = [H(str(i)).encode() for i in range(100)]
    tree = M.Tree(digests, M.levels_above(100))
    for i in (0, 7, 63, 64, 99):
        way = M.unpack(M.pack(tree.way(i)), digests[i])
        assert way[-1][0].digest == tree.tops[0] and len(way) == 3
