import os
import random
from collections import Counter
from hashlib import sha256

import pytest

from leaksieve.llm import alignment as A

FOLDER = "/opt/tokenizers"
FILES = f"{FOLDER}/byte_bpe_50k.json", f"{FOLDER}/piece_bpe_32k.model"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tokenizer files")

TEXTS = [
    None, "", " ", "plain words here", "naïve café 😀😀 x", "a▁b", "<s> x </s><|endoftext|>", "tab\tline\r\n\n",
    "\x00\x01", "ﬁne 日本語のテキスト", "aaaa" * 500, "the cat sat on the mat", "the cat sat on the mat",
    "   spaced    out  ", "word " * 1_500,
]


@pytest.fixture(scope="module")
def aligner():
    return A.Aligner(*FILES)


def tokens(aligner, text):
    """(id, start, end) of both, or none."""
    if not text:
        return [], []
    out = []
    for tok in (aligner.a, aligner.b):
        ids, at, found = tok.encode([text])[0], 0, []
        for i in ids:
            found.append((i, at, at + len(tok.pieces[i])))
            at += len(tok.pieces[i])
        if b"".join(tok.pieces[i] for i in ids) != (" " + text).encode():
            return [], []
        out.append(found)
    return out


def brute(aligner, texts):
    rows, links = [], []
    for t in texts:
        a, b = tokens(aligner, t)
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, start = [], 0
        for c in cuts:
            part = lambda x: ",".join(str(i) for i, s, e in x if start <= s and e <= c)
            groups.append(f"{part(a)}|{part(b)}")
            start = c
        by_byte = {}
        for j, s, e in b:
            for k in range(s, e):
                by_byte[k] = (j, s)
        over = [(i, j) for i, s, e in a for j, _ in sorted({by_byte[k] for k in range(s, e)}, key=lambda x: x[1])]
        links.append(over)
        line = ";".join(groups)
        rows.append([len(a), len(b), len(groups), len(over), sha256(line.encode()).hexdigest() if a else ""])
    count = Counter(p for over in links for p in set(over))
    most = {}
    for (i, _), n in count.items():
        most[i] = max(most.get(i, 0), n)
    return [
        (*r[:4], sum(count[p] == most[p[0]] for p in over), sum(count[p] for p in over), r[4])
        for r, over in zip(rows, links)
    ]


def random_texts(seed, n):
    rng = random.Random(seed)
    alphabet = "ab c\n.é日😀▁<0x41>̀ \u00a0\t\x1c\u2003's'll1  "
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("heavy", [A.HEAVY_PAIRS, 40, 0])
def test_all_columns_against_brute_force(spark, aligner, heavy):
    texts = TEXTS + random_texts(3, 60)
    rows = [(None if i == 5 else i % 70, t, 7) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_a int").repartition(3)
    got = A.align(df, *FILES, heavy_pairs=heavy)
    columns = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    key = lambda r: tuple((v is not None, v) for v in r)
    got = sorted((tuple(r) for r in got.select(*columns).collect()), key=key)
    assert got == sorted(((r[0], *w) for r, w in zip(rows, brute(aligner, texts))), key=key)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert A.align(df, *FILES).count() == 0
    assert A.token_links(df, *FILES).count() == 0


def test_products_against_dense_matrices():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(60):
        m, n, k = rng.integers(1, 12, 3)
        a, b = rng.random((m, k)) < 0.4, rng.random((n, k)) < 0.4
        csr = lambda x: A.Csr(np.concatenate(([0], x.sum(1).cumsum())), np.nonzero(x)[1], int(k))
        dense = np.zeros((m, n), int)
        for i, j, v in A.product(csr(a), csr(b), limit=3):
            dense[i, j] += v
        assert (dense == a.astype(int) @ b.T.astype(int)).all()


def test_links_of_tokens(spark, aligner):
    texts = [t for t in TEXTS if not t or len(t) < 100] + random_texts(8, 10)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    over, group = set(), set()
    for d, t in enumerate(texts):
        a, b = tokens(aligner, t)
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        of = lambda s: sum(c <= s for c in cuts)
        for p, (i, s, e) in enumerate(a):
            for q, (j, u, v) in enumerate(b):
                if min(e, v) > max(s, u):
                    over.add((d, p, q, i, j, min(e, v) - max(s, u)))
                if of(s) == of(u):
                    group.add((d, p, q, i, j, 1))
    assert {tuple(r) for r in A.token_links(df, *FILES).collect()} == over
    assert {tuple(r) for r in A.token_links(df, *FILES, kind="group").collect()} == group
    counts = dict(A.encode(df, *FILES).select("doc_id", "n_group_links").collect())
    assert counts == {d: sum(g[0] == d for g in group) for d in range(len(texts))}


def test_chunks_are_encoded_as_in_their_text(aligner):
    texts = [t for t in TEXTS + random_texts(21, 300) if t]
    for t in texts:
        if "▁" in t:  # stands for a space, so the bytes differ and there are no tokens
            assert aligner.aligned([t.encode()]) == [[]]
            continue
        parts = A.chunks(t)
        assert "".join(" " + c for c in parts) == " " + t and all(parts)
        for model in (aligner.a, aligner.b):
            assert sum(model.encode(parts), []) == model.encode([t])[0]


def test_chunks_that_are_not_kept(aligner, monkeypatch):
    texts = [t.encode() for t in TEXTS if t]
    want = aligner.aligned(texts)
    monkeypatch.setattr(A, "KEPT_CHUNKS", 0)
    monkeypatch.setattr(A, "KEPT_CHARS", 3)
    fresh = A.Aligner(*FILES)
    assert [fresh.aligned([t])[0] for t in texts] == want


def test_bytes_that_are_no_text(aligner):
    s = aligner.stack([b"ok", b"\xff\xfe", None])
    assert set(s.a_text.tolist()) == {0}
