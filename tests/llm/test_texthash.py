import random
import re

import numpy as np
import pyarrow as pa

from leaksieve.llm.texthash import SpanHasher, blocks, gram_hashes, spans, word_bytes

WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")


def test_spans_are_the_words_of_each_row():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab1é日 .\n-") for _ in range(rng.randrange(40))) for _ in range(300)]
    texts += ["", None, "x" * 1000, " ", "end"]
    got = [[] for _ in texts]
    for first, n, data, offsets in blocks(pa.array(texts), 200):
        raw = data.tobytes()
        for s, e, r in zip(*spans(data, offsets, word_bytes())):
            got[first + r].append(raw[s:e].decode())
    assert got == [WORD.findall(t or "") for t in texts]


def test_hash_depends_on_the_bytes_only():
    words = ["a", "b", "ab", "ba", "a" * 5000, "é", "token", "tokem"]
    text = " ".join(words * 3)
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = spans(data, np.array([0, len(data)]), word_bytes())
    for piece in (64, 1 << 16):
        h = SpanHasher(piece).hashes(data, starts, ends)
        assert (h[: len(words)] == h[len(words) : 2 * len(words)]).all()
        assert len(set(h.tolist())) == len(words)
        assert (h == SpanHasher(1 << 10).hashes(data, starts, ends)).all()


def test_grams_depend_on_order():
    h = np.array([1, 2, 3, 1, 2, 3, 3, 2, 1], np.uint64)
    g = gram_hashes(h, 3)
    assert g[0] == g[3] != g[6] and len(g) == 7
    assert len(gram_hashes(h[:2], 3)) == 0
