import random
import re

import pytest
from pyspark.sql import functions as F

from leaksieve.llm import url_filter as U

RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/f", "block"), ("a.b", "", "block"), ("x.org", "/k", "allow"),
    ("x.org", "/k", "block"),
]
URLS = [
    None, "", "no scheme", "http://", "http:///path", "HTTP://EXAMPLE.Com/en/1?x#y",
    "http://www.example.com/en/", "http://www.example.com/EN/", "http://m.example.com/en",
    "http://notexample.com/en/2", "http://com", "http://com/", "ftp://q.net/es/#/", "http://q.net/fr",
    "http://a.b", "http://z.a.b?x://y", "http://ä.x.org/k/ü", "http://q.net:80/es/",
    "x://y://z.net/es/", "http://" + "s." * 3000 + "net/es/" + "p" * 100_000, "http://a\n.net/es/",
]


def judge(url, rules=RULES):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [
        (len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    if not fits:
        return host, path, None, "allow"
    return host, path, max(fits)[3], max(fits)[4]


@pytest.mark.parametrize("max_words", [U.MAX_WORDS, 0])
def test_verdicts(spark, max_words):
    rng = random.Random(1)
    urls = URLS + [
        f"http://{rng.choice(['', 'www.', 'm.'])}{rng.choice(['example', 'q', 'a', 'x'])}"
        f".{rng.choice(['com', 'net', 'b', 'org'])}{rng.choice(['', '/', '/en/1', '/es/2', '/fr', '/k'])}"
        for _ in range(300)
    ]
    pages = spark.createDataFrame(
        [(i // 2, u, "h", 1) for i, u in enumerate(urls)], "page_id long, url string, Host string, n int"
    )
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    out = U.filter_urls(pages, rules, max_words=max_words)
    assert out.columns == ["page_id", "url", "n", "host", "path", "rule", "verdict"]
    got = [(r["url"], r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()]
    assert sorted(map(str, got)) == sorted(str((u, *judge(u))) for u in urls)


def test_many_rules_need_several_levels_and_stay_exact(spark):
    rng = random.Random(2)
    rules = [(f"h{i}.com", f"/p{i % 3}/", rng.choice(["allow", "block"])) for i in range(400)]
    urls = [f"http://w.h{rng.randrange(4000)}.com/p{rng.randrange(4)}/x" for _ in range(4000)]
    df = spark.createDataFrame(rules, "host string, path string, verdict string")
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r["url"]: (r["rule"], r["verdict"]) for r in U.filter_urls(pages, df).collect()}
    fits = {h + p: v for h, p, v in rules}
    for u in urls:
        key = u.removeprefix("http://w.").removesuffix("x")
        assert got[u] == ((key, fits[key]) if key in fits else (None, "allow"))


def test_cascade_is_exact(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = keys.filter("crc32(key) % 10 = 0")
    c = U.build_cascade(listed, keys.filter("crc32(key) % 10 != 0"))
    assert len(c.levels) >= 2
    wrong = keys.filter(c.holds(F.col("key")) != F.expr("crc32(key) % 10 = 0"))
    assert wrong.count() == 0


def test_without_rules_or_pages(spark):
    pages = spark.createDataFrame([("http://a.com/",), (None,)], "url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    rules = spark.createDataFrame(RULES, none.schema)
    assert {r["verdict"] for r in U.filter_urls(pages, none).collect()} == {"allow"}
    assert U.filter_urls(pages.filter("false"), rules).count() == 0
