import random
import re
import time

from pyspark.sql import functions as F

from leaksieve.llm import credentials as C

AKIA = "AKIA" + "Q7" * 8
KEY = "Ab3dEf6hIj9lMn2pQr5tUv8xYz1bCd4fGh7jKl0n"  # 40 mixed characters


def spans(text):
    return [(k, text[s:e]) for k, s, e in C.scan_text(text)[1]]


def test_base_patterns():
    text = f"Password: hunter22 {AKIA} token=ab12 api_key = 'zz.yy/xx' " + "0f" * 12 + " " + "a" * 23
    assert spans(text) == [
        ("assign", "Password: hunter22"), ("access", AKIA), ("assign", "api_key = 'zz.yy/xx"),
        ("hex", "0f" * 12),
    ]
    # A match that fails is dropped after it was taken.
    assert spans("secret=token: abcdefgh") == []
    assert spans("paſſword: hunter22 toKen=abcdefgh") == []
    assert spans("AKIA" + "X" * 15) == []


def test_weak_parts_count_only_together():
    key, user, host = f"key: {KEY}", "user = svc_mail", "endpoint: db.example.org"
    assert spans(key) == spans(user) == spans(host) == []
    assert spans(f"{user}\n{host}") == [] and spans(f"{key}\n{host}") == []
    assert spans(f"{user}\n{key}") == [("identifier", "svc_mail"), ("key", KEY)]
    assert spans(f"{user}\n{key}\n{host}") == [
        ("identifier", "svc_mail"), ("key", KEY), ("endpoint", "db.example.org"),
    ]
    assert spans(f"{AKIA} {KEY}") == [("access", AKIA), ("key", KEY)]


def test_scope_and_reach():
    user, key = "user = svc_mail", f"key: {KEY}"
    assert spans(f"{user}\n \t\n{key}") == []
    assert len(spans(f"{user}{' .' * 100}{key}")) == 2
    assert spans(f"{user}{' .' * 200}{key}") == []


def test_long_values_are_whole():
    for n in (129, 300, 5000, 200_000):
        user, key, host = "u" * n, "k%" * n, "h." * n
        assert spans(f"user={user}\nauth={key}\nhost={host}\n") == [
            ("identifier", user), ("key", key), ("endpoint", host),
        ]


def test_no_weak_span_within_a_strong_one():
    text = f"user=abc password={KEY}"
    assert spans(text) == [("identifier", "abc"), ("assign", f"password={KEY}")]


def test_many_parts_stay_linear():
    text = "".join(f"user=u{i:04} key: {KEY[:30]}{i:010}\n" for i in range(4000))
    assert len(spans(text)) == 8000


def near(text, base, reach=C.REACH):
    """Brute force over all pairs of parts."""
    edges = [m.start() for m in re.finditer(r"\n[\x20\t\r]*\n", text)]
    scope = lambda s: sum(e <= s for e in edges)
    parts = C._weak(text) + [s for s in base]
    ids = {p for p in parts if p[0] in ("access", "identifier")}
    keys = {p for p in parts if p[0] in ("assign", "hex", "key")}
    keys = {k for k in keys if not any(k[1:] == i[1:] for i in ids)}

    def meet(a, b):
        gap = b[1] - a[2] if b[1] >= a[1] else a[1] - b[2]
        gap2 = a[1] - b[2] if b[2] <= a[2] else b[1] - a[2]
        return scope(a[1]) == scope(b[1]) and (
            (b[1] >= a[1] and b[1] - a[2] <= reach) or (b[2] <= a[2] and a[1] - b[2] <= reach)
        )

    pair = {i for i in ids if any(meet(i, k) for k in keys)} | {
        k for k in keys if any(meet(k, i) for i in ids)
    }
    ends = {p for p in parts if p[0] == "endpoint" and any(meet(p, q) for q in pair)}
    strong = [(s, e) for _, s, e in base]
    return sorted(
        {p for p in pair | ends if p[0] in C.KINDS[3:] and not any(s < p[2] and e > p[1] for s, e in strong)},
        key=C._order,
    )


def test_links_against_brute_force():
    import random

    rng = random.Random(3)
    pieces = ["user=ann ", f"key: {KEY} ", "host=a.example.org ", f"{AKIA} ", "https://x.org/a ", "\n\n",
              "word " * 30, "pwd='hunter2222' ", "token: abcdefgh ", "0a" * 14 + " "]
    for _ in range(200):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))
        base = sorted(C.base_spans(text), key=C._order)
        assert C.linked_spans(text, base) == near(text, base), text


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "é token=abcdefgh"), (3, "é token=abcdefgh"), (None, "x"),
            (4, "a" * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1))
    got = C.scan_credentials(df).select("doc_id", C.listed(F.col("spans")).alias("s")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(
        map(str, [(1, ""), (2, ""), (3, "assign:2:16"), (3, "assign:2:16"), (None, ""),
                  (4, "hex:0:300000")])
    )
    assert C.scan_credentials(df.filter("false")).count() == 0


def test_covered_against_all_strong_spans():
    rng = random.Random(6)
    for _ in range(300):
        base = [("hex", s, s + rng.randrange(1, 9)) for s in (rng.randrange(60) for _ in range(rng.randrange(8)))]
        taken = C._merged(base)
        for start in range(0, 66):
            for end in (start + 1, start + 4):
                assert C._covered(taken, start, end) == any(s < end and e > start for _, s, e in base)


def test_many_strong_spans_stay_linear():
    part = "user=someone " + "0123456789abcdef" * 2 + " key=Abc123xyz\n"
    text = part * (1_000_000 // len(part))
    begin = time.perf_counter()
    base, spans = C.scan_text(text)
    assert time.perf_counter() - begin < 10
    assert len(base) == text.count("user=") and len(spans) == 3 * len(base)
