"""D1 for rules that are a table: keywords are joined to texts by their rarest gram.

A rule set of the catalogue's size is literals of the plan (``operators.detect``). A table
of many thousand rules is not: here each keyword is represented by one of its grams (the
one that the fewest keywords have), a text by the grams it has, and they meet in an
equi-join; the keyword itself is then searched for in the text, and the rules that have it
are joined to what was found. Grams of a text that no
keyword is represented by are dropped before the join, by a bit set of fixed size.
Everything is a join or an expression of Spark; nothing goes through Python workers.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaksieve.operators.layout import join_on_skewed_key, stored

GRAM = 3
EARLIER = 16  # a rule with more keywords is made unique per text by a shuffle
SET_BITS = 20  # the bit set has 2 ** SET_BITS bits (128 KB), however many rules there are


def _grams(text: Column, size: int) -> Column:
    """All substrings of ``size`` characters; none of a shorter text. The characters are
    taken apart once: to count to a place in a text takes as long as the text is."""

    def runs(chars: Column) -> Column:
        n = F.size(chars) - size
        at = F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.concat(*[F.get(chars, i + k) for k in range(size)]))

    return F.flatten(F.transform(F.array(F.split(text, "")), runs))


def _slot(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(1 << SET_BITS))


def keyword_table(rules: DataFrame, ignore_case: bool = False) -> tuple[DataFrame, DataFrame]:
    """((pos, keyword, earlier), (keyword, gram)) of the keywords of (pos, keywords), stored.

    The first has a row for each rule and keyword; ``earlier`` are the rule's keywords
    before this one, null where it has more than ``EARLIER``. The second has one row per
    different keyword, however many rules share it; ``gram`` is the keyword itself if it is
    shorter than ``GRAM``, the empty one too. Null keywords, and rules without any, are left
    out: such rules never run.
    """
    words = F.filter("keywords", lambda w: w.isNotNull())
    if ignore_case:
        words = F.transform(words, lambda w: F.lower(w))
    of_rule = rules.select("pos", words.alias("words")).groupBy("pos").agg(
        F.array_distinct(F.flatten(F.collect_list("words"))).alias("words")
    )
    earlier = F.when(F.size("words") <= EARLIER, F.slice("words", F.lit(1), F.col("at")))
    called = stored(
        of_rule.select("pos", "words", F.posexplode("words").alias("at", "keyword"))
        .select("pos", "keyword", earlier.alias("earlier"))
    )
    of = F.when(F.length("keyword") < GRAM, F.array("keyword")).otherwise(_grams(F.col("keyword"), GRAM))
    each = called.select("keyword").distinct().select("keyword", F.explode(F.array_distinct(of)).alias("gram"))
    shared = each.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    best = each.join(shared, "gram").groupBy("keyword").agg(
        F.min_by("gram", F.struct("n", "gram")).alias("gram")
    )
    return called, stored(best.select("keyword", "gram"))


def in_bit_set(keywords: DataFrame):
    """Test of a gram: false only if no row of ``keywords`` has it."""
    slot = _slot(F.col("gram"))
    words = keywords.select("gram").distinct().groupBy(F.shiftright(slot, 6).alias("at")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))).alias("bits")
    )
    table = [0] * (1 << SET_BITS - 6)
    for row in words.collect():  # as many rows as the set has words, at most
        table[row["at"]] = row["bits"]
    bits = F.from_json(F.lit(json.dumps(table)), "array<bigint>")

    def test(gram: Column) -> Column:
        s = _slot(gram)
        word = F.get(bits, F.shiftright(s, 6).cast("int"))
        one = F.call_function("shiftrightunsigned", word, s.bitwiseAND(63).cast("int"))
        return one.bitwiseAND(F.lit(1).cast("long")) == 1

    return test


def keyword_pairs(
    texts: DataFrame,
    rules: DataFrame,
    key: str = "path",
    content: str = "content",
    ignore_case: bool = False,
) -> DataFrame:
    """D1 as a relation: (key, pos) for each text and each rule that runs on it, once.

    ``texts`` has one row per ``key``, ``rules`` has (pos, keywords). A rule runs iff the
    text holds one of its keywords; the empty keyword is in every text that is not null.
    Grams and keys meet in a narrow join of different keywords; a gram that many keywords
    share is split if it is hot. Texts are read again for the search and move once, unless
    the keywords to search for in them are few enough to be sent. Rules come last, to the
    keywords that were found, so nothing that is moved before grows with their number; a
    rule with several keywords counts at the first of them that the text holds.
    """
    called, keywords = keyword_table(rules, ignore_case)
    body = F.lower(content) if ignore_case else F.col(content)
    sizes = [r[0] for r in keywords.select(F.length("gram")).distinct().collect()]  # GRAM + 1 at most
    texts = texts.select(F.col(key).alias("key"), body.alias("body")).filter("body IS NOT NULL")
    every = texts.select("key", F.explode(F.array(F.lit(""))).alias("gram")) if 0 in sizes else None
    held = F.array_distinct(F.flatten(F.array(*[_grams(F.col("body"), n) for n in sizes if n] or [F.array().cast("array<string>")])))
    grams = texts.select("key", F.explode(F.filter(held, in_bit_set(keywords))).alias("gram"))
    if every is not None:
        grams = grams.unionByName(every)
    met = join_on_skewed_key(grams, keywords, "gram", ("key",))
    wanted = stored(met.groupBy("key").agg(F.collect_set("keyword").alias("maybe")))
    held = F.filter("maybe", lambda m: F.contains(F.col("body"), m))
    found = stored(
        texts.join(wanted, "key").select("key", held.alias("held"))
        .select("key", "held", F.explode("held").alias("keyword"))
    )
    first = join_on_skewed_key(found, called.filter("earlier IS NOT NULL"), "keyword", ("key",)).filter(
        ~F.arrays_overlap("earlier", "held")
    )
    many = called.filter("earlier IS NULL")
    pairs = first.select("key", "pos")
    if not many.isEmpty():
        again = join_on_skewed_key(found.drop("held"), many.drop("earlier"), "keyword", ("key",))
        pairs = pairs.unionByName(again.select("key", "pos").distinct())
    return pairs.select(F.col("key").alias(key), "pos")
