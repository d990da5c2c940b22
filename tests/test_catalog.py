import hashlib

import pytest

from leaksieve import Allowlist, Rule, RuleSet, load_catalog, load_extended, parse_catalog, stock_rules
from leaksieve.errors import EmptyCatalog, InvalidCatalog
from leaksieve.operators import rules as R
from leaksieve.sources import catalog

TOML = """
title = "x"
[allowlist]
paths = ["/a", "(b)$"]
commits = ["c", 1]
regexTarget = "line"
stopwords = ["token", 2]
[[rules]]
description = "Stripe"
id = "stripe"
regex = '''sk_[a-z]+'''
keywords = ["sk_", "pk_"]
surplus = 1
[[rules]]
description = "Digit"
id = "key"
regex = '\\d+'
keywords = ["1212"]
secretGroup = 1
entropy = 3
[rules.allowlist]
regexTarget = "line"
stopwords = ["token"]
"""


def test_parse():
    rules = parse_catalog(TOML)
    assert [r.id for r in rules.rules] == ["stripe", "key"]
    assert rules.rules[0] == Rule("stripe", "Stripe", "sk_[a-z]+", ("sk_", "pk_"))
    assert rules.rules[1].allowlist == Allowlist(regex_target="line", stopwords=("token",))
    assert (rules.rules[1].secret_group, rules.rules[1].entropy) == (1, 3.0)
    assert rules.allowlist == Allowlist(("/a", "(b)$"), ("c",), "line", (), ("token",))


@pytest.mark.parametrize(
    "text",
    [
        "title = 'x'",
        "rules = 1",
        "[[rules]]\nid='a'\nregex='b'\nkeywords=[]",
        "[[rules]]\nid='a'\ndescription='d'\nkeywords=[]",
        "[[rules]]\nid='a'\ndescription='d'\nregex='b'",
        "[[rules]]\nid='a'\ndescription='d'\nregex='b'\nkeywords=[1]",
        "[[rules]]\nid=1\ndescription='d'\nregex='b'\nkeywords=[]",
        "[allowlist]\npaths=[1]\n[[rules]]\nid='a'\ndescription='d'\nregex='b'\nkeywords=[]",
        "not toml",
    ],
)
def test_invalid(text):
    with pytest.raises(InvalidCatalog):
        parse_catalog(text)


def test_missing_file():
    with pytest.raises(EmptyCatalog):
        load_catalog("/nowhere/rules.toml")


def test_stock():
    rules = stock_rules(["a", "b"], ["/own.toml"])
    assert len(rules.rules) == 149 and len({r.id for r in rules.rules}) == 149
    assert all(r.keywords and r.regex for r in rules.rules)
    assert [r.id for r in rules.rules if r.allowlist] == ["generic-api-key"]
    assert rules.rules[55].allowlist.stopwords == ("a", "b")
    assert sum(r.secret_group is not None for r in rules.rules) == 106
    assert rules.allowlist.paths[-1] == "/own.toml" and len(rules.allowlist.paths) == 9


def test_stopword_file(tmp_path):
    (tmp_path / "w").write_text("one\n\ntwo\n")
    assert catalog.load_stopwords(str(tmp_path / "w")) == ("one", "two")
    toml = "[[rules]]\nid='generic-api-key'\ndescription='d'\nregex='x'\nkeywords=[]\n"
    (tmp_path / "c.toml").write_text(toml)
    with pytest.raises(InvalidCatalog):
        catalog.load_stopwords(str(tmp_path / "c.toml"))
    (tmp_path / "c.toml").write_text(toml + "[rules.allowlist]\nstopwords=['b', 'a', 'b']\n")
    words = catalog.load_stopwords(str(tmp_path / "c.toml"))
    assert words == ("b", "a", "b")
    generic = [r for r in stock_rules(words).rules if r.id == "generic-api-key"]
    assert generic[0].allowlist.stopwords == words


def test_stock_stopwords_are_whole():
    from workload import queries

    words = catalog.stock_stopwords()
    assert len(words) == 1474 and len(set(words)) == 1443
    assert words[:3] == ("client", "endpoint", "vpn") and words[-3:] == ("branch", "combination", "combo")
    digest = hashlib.sha256("\n".join(words).encode()).hexdigest()
    assert digest == "8e4fae4b2f4a748e673fdaf4045a30758cdbf7d5badeb3dd42ae5efb6c577716"
    generic = [r for r in queries.STOCK.rules if r.id == "generic-api-key"]
    assert generic[0].allowlist.stopwords == words


def test_path_rules_are_opt_in():
    text = "[[rules]]\nid='e'\ndescription='d'\npath='x$'\n"
    with pytest.raises(InvalidCatalog):
        parse_catalog(text)
    assert parse_catalog(text, path_rules=True).rules == (Rule("e", "d", None, path="x$"),)


def test_table_round_trip(spark):
    rules = parse_catalog(TOML)
    assert RuleSet.from_df(rules.to_df(spark), rules.allowlist) == rules


def test_extend(tmp_path):
    head = lambda i, d: f"[[rules]]\nid='{i}'\ndescription='{d}'\nregex='x'\nkeywords=[]\n"
    third = tmp_path / "c.toml"
    third.write_text(head("3", "third"))
    second = tmp_path / "b.toml"
    second.write_text(f"[extend]\npath='{third}'\n" + head("1", "other") + head("2", "second"))
    first = tmp_path / "a.toml"
    first.write_text(f"[extend]\npath='{second}'\n[allowlist]\npaths=['/p']\n" + head("1", "first"))
    rules = load_extended(str(first))
    assert [r.description for r in rules.rules] == ["first", "second", "third"]
    assert rules.allowlist.paths == ("/p",)
    first.write_text("[extend]\nuseDefault=true\n" + head("jwt", "mine"))
    with pytest.raises(InvalidCatalog, match="default rules"):
        load_extended(str(first))
    rules = load_extended(str(first), stock_rules(()))
    assert len(rules.rules) == 149 and rules.rules[0].description == "mine"


def test_rule_operations(spark):
    rules = parse_catalog(TOML + "[[rules]]\nid='key'\ndescription='D2'\nregex='x'\nkeywords=[]\n")
    df = rules.to_df(spark)
    new = Rule("new", "New", "n+", ("n",), Allowlist(paths=("/x",)), tags=("t",))
    back = lambda d: RuleSet.from_df(d, rules.allowlist).rules
    assert back(R.list_rules(df)) == rules.rules
    assert back(R.append_rule(df, new)) == rules.rules + (new,)
    assert back(R.append_rule(df.limit(0), new)) == (new,)
    assert back(R.delete_rules(df, "key")) == rules.rules[:1]
    assert back(R.delete_rules(df, "gone")) == rules.rules
    assert back(R.update_rule(df, "key", new)) == (rules.rules[0], new, rules.rules[2])
    assert back(R.update_rule(df, "gone", new)) == rules.rules
    other = RuleSet((Rule("stripe", "Other", "o"), new)).to_df(spark)
    assert back(R.extend(df, other)) == rules.rules + (new,)
