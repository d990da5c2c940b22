import random

import pytest
from pyspark.sql import functions as F

from leaksieve.errors import UnsupportedPattern
from leaksieve.functions import text
from leaksieve.sources.catalog import stock_stopwords
from tests.brute import split_lines

LINES = {
    "a\r\nb\n": ["a", "b"],
    "": [],
    "a\r": ["a\r"],
    "a\n\n": ["a", ""],
    "\n": [""],
    "a\rb\nc": ["a\rb", "c"],
    "a\r\r\nb": ["a\r", "b"],
    "a\n": ["a"],
    "a": ["a"],
    "\r\n": [""],
    "\n\n\r": ["", "", "\r"],
}


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "s string").select(column.alias("x")).first()[0]


def test_lines(spark):
    rows = spark.createDataFrame([(s,) for s in LINES], "s string").select("s", text.lines("s")).collect()
    assert {r[0]: r[1] for r in rows} == LINES
    assert {s: split_lines(s) for s in LINES} == LINES


def test_first_match_keeps_an_empty_match(spark):
    assert one(spark, "abc", text.first_match("s", text.java_pattern("x*"))) == ""
    assert one(spark, "abc", text.first_match("s", text.java_pattern("x"))) is None
    assert one(spark, "a1b22", text.first_match("s", text.java_pattern(r"\d+"))) == "1"


@pytest.mark.parametrize(
    "pattern,value,hit",
    [
        (r"\d", "٠", True),
        ("(?i)k", "K", True),
        ("^.$", "\u0085", True),
        ("^.$", "\r", True),
        ("a$", "a\r", False),
        (r"\s", " ", True),
        (r"(?P<x>b)", "b", True),
        ("[[:digit:]x]", "7", True),
        ("[[:digit:]x]", ":", False),
    ],
)
def test_dialect(spark, pattern, value, hit):
    assert one(spark, value, F.rlike("s", F.lit(text.java_pattern(pattern)))) is hit


@pytest.mark.parametrize("pattern", ["a(?=b)", "a(?!b)", "(?<=a)b", "(?<!a)b", r"(a)\1"])
def test_unsupported(pattern):
    with pytest.raises(UnsupportedPattern):
        text.java_pattern(pattern)


@pytest.mark.parametrize("pattern", [r"\(?=", r"(?<name>a)", r"\\1", "(?:a)"])
def test_supported(pattern):
    assert text.check_pattern(pattern) == pattern


def test_any(spark):
    pats = ("^hello", "world$")
    assert one(spark, "world\n", text.matches_any(F.col("s"), pats)) is False
    assert one(spark, "hello, world!", text.matches_any(F.col("s"), pats)) is True
    assert one(spark, "goodbye", text.matches_any(F.col("s"), pats)) is False
    assert one(spark, "x", text.matches_any(F.col("s"), ())) is False
    fruit = ["apple", "banana", "orange"]
    assert one(spark, "I like to eat bananas", text.contains_any(F.col("s"), fruit)) is True
    assert one(spark, "I like to eat grapes", text.contains_any(F.col("s"), fruit)) is False


@pytest.mark.parametrize("seed", range(4))
def test_word_lists_against_one_search_per_word(spark, seed):
    rng = random.Random(seed)
    letters = "abcB-]^\\&.[ \n\u00e9\U0001f600\u0301"
    word = lambda n: "".join(rng.choice(letters) for _ in range(rng.randint(1, n)))
    words = [word(5) for _ in range(rng.choice([1, 7, 8, 60]))]
    texts = ["", *(word(30) for _ in range(300))]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = df.select("s", text.contains_any(F.col("s"), words).alias("x")).collect()
    assert all(r["x"] == any(w in r["s"] for w in words) for r in got)


def test_odd_word_lists(spark):
    few = ["x", *"bcdefgh"]
    assert one(spark, "", text.contains_any(F.col("s"), ["", *few])) is True
    assert one(spark, "a", text.contains_any(F.col("s"), few)) is False
    assert one(spark, "a", text.contains_any(F.col("s"), [])) is False
    assert one(spark, None, text.contains_any(F.col("s"), few)) is None


def test_the_stock_words(spark):
    rng = random.Random(2)
    words = stock_stopwords()
    texts = [
        "".join(rng.choice("etaoinsrhldcumfpgwybvkxjqz_-0") for _ in range(rng.randrange(12)))
        + rng.choice(["", rng.choice(words), rng.choice(words)[:-1]])
        for _ in range(3000)
    ]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = df.select("s", text.contains_any(F.col("s"), words).alias("x")).collect()
    assert all(r["x"] == any(w in r["s"] for w in words) for r in got)
    assert 100 < sum(r["x"] for r in got) < 2900


@pytest.mark.parametrize(
    "value,hit",
    [
        ("https://www.example.com", True),
        ("http://example.com", True),
        ("www.example.com", True),
        ("https://www.example.com/path", True),
        ("https://www.example.com?q=query", True),
        ("example.com", False),
        ("example.com/path", False),
        ("example.com?q=query", False),
        ("not a link", False),
    ],
)
def test_is_link(spark, value, hit):
    assert one(spark, value, text.is_link("s")) is hit


@pytest.mark.parametrize("value,hit", [("(regex$", True), ("(regex", False), ("", False)])
def test_is_regex(spark, value, hit):
    assert one(spark, value, text.is_regex("s")) is hit


def test_repo_names(spark):
    assert one(spark, "https://github.com/user/repo.git", text.repo_name_from_url("s")) == "repo"
    assert one(spark, "https://github.com/user/repo", text.repo_name_from_url("s")) is None
    assert one(spark, "/a/b/repo.git/", text.repo_dir_name("s")) == "repo"
    assert one(spark, "/a/b/repo", text.repo_dir_name("s")) == "repo"
    assert one(spark, "", text.repo_dir_name("s")) == ""
    assert one(spark, "https://x/a.git\n", text.repo_name_from_url("s")) is None
    assert one(spark, "/a/b.git\n", text.repo_dir_name("s")) == "b.git\n"


def test_lossy_utf8(spark):
    df = spark.createDataFrame([(bytearray(b"ok\xffok\xc3"),)], "b binary")
    assert df.select(text.lossy_utf8("b")).first()[0] == "ok�ok�"


@pytest.mark.parametrize(
    "pattern,plain,wide",
    [
        ("abc", "(?m)abc", "(?m)abc"),
        (r"a\sb", r"(?m)a[\s\x0B]b", r"(?m)a[\s\x0B\x{80}-\x{10FFFF}]b"),
        (r"[\s|']\b", r"(?m)[\s|'\x0B]\b", r"(?m)[\s|'\x0B\x{80}-\x{10FFFF}](?:)"),
        (r"[^\s]", r"(?m)[^\s]", r"(?m)[^\s]"),
        (r"[^\S]", None, None),
        (r"[^\W]", r"(?m)[^\W]", None),
        (r"[]\d]", r"(?m)[]\d]", r"(?m)[]\d\x{80}-\x{10FFFF}]"),
        (r"\[\d]", r"(?m)\[\d]", r"(?m)\[[\d\x{80}-\x{10FFFF}]]"),
        (r"[a[b]]", None, None),
        (r"[[:alpha:]]", None, None),
        (r"[a-z&&b]", None, None),
        (r"\pL", None, None),
        (r"a\z", None, None),
        (r"(a|b)*", None, None),
    ],
)
def test_screen_patterns(pattern, plain, wide):
    assert text.screen_patterns(pattern) == (plain, wide)


def test_every_stock_pattern_can_be_screened():
    import pyarrow as pa
    import pyarrow.compute as pc

    from leaksieve import stock_rules
    from tests.brute import smallest

    for rule in stock_rules(()).rules:
        line = pa.array([smallest(rule.regex), "\u00e9 " + smallest(rule.regex)])
        for pattern in text.screen_patterns(rule.regex):
            assert pattern is not None, rule.id
            assert pc.match_substring_regex(line, pattern)[0].as_py(), rule.id
