"""Rule catalogues.

A catalogue is a TOML file with ``[[rules]]`` and an optional global
``[allowlist]``. It is configuration, parsed where the plan is built; from there
it travels as literals inside the plan, never as a join side, so a scan needs no
shuffle and no broadcast for its rules.
"""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass, field, replace
from importlib import resources
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaksieve.errors import EmptyCatalog, InvalidCatalog
from leaksieve.schema import RULES


@dataclass(frozen=True)
class Allowlist:
    paths: tuple[str, ...] = ()
    commits: tuple[str, ...] = ()
    regex_target: str = ""
    regexes: tuple[str, ...] = ()
    stopwords: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rule:
    id: str | None
    description: str
    regex: str | None  # None: the rule names files by their path alone (X3)
    keywords: tuple[str, ...] = ()
    allowlist: Allowlist | None = None
    secret_group: int | None = None
    entropy: float | None = None
    path: str | None = None
    tags: tuple[str, ...] = ()


@dataclass(frozen=True)
class RuleSet:
    """Ordered rules plus the global allowlist."""

    rules: tuple[Rule, ...]
    allowlist: Allowlist = field(default_factory=Allowlist)

    def to_df(self, spark: SparkSession) -> DataFrame:
        """The rules as a DataFrame (one row per rule, in order)."""
        rows = json.dumps([{"pos": i, **asdict(r)} for i, r in enumerate(self.rules)])
        return spark.range(1).select(
            F.inline(F.from_json(F.lit(rows), f"array<{RULES.simpleString()}>"))
        )

    def with_stopwords(self, rule_id: str, words: Iterable[str]) -> RuleSet:
        """Replace the stopwords of one rule's allowlist."""
        words = tuple(words)
        return replace(
            self,
            rules=tuple(
                replace(r, allowlist=replace(r.allowlist or Allowlist(), stopwords=words))
                if r.id == rule_id
                else r
                for r in self.rules
            ),
        )

    def without_rule_allowlists(self) -> RuleSet:
        return replace(self, rules=tuple(replace(r, allowlist=None) for r in self.rules))

    @staticmethod
    def from_df(rules: DataFrame, allowlist: Allowlist = Allowlist()) -> RuleSet:
        """Rules kept as a table (after R2-R4) back to a rule set.

        A catalogue is configuration, a few hundred rows; it is streamed to the
        driver one partition at a time.
        """
        out = []
        for row in rules.orderBy("pos").toLocalIterator():
            d = row.asDict(recursive=True)
            d.pop("pos")
            if d["allowlist"] is not None:
                d["allowlist"] = Allowlist(
                    **{k: tuple(v) if isinstance(v, list) else v for k, v in d["allowlist"].items()}
                )
            out.append(Rule(**{k: tuple(v) if isinstance(v, list) else v for k, v in d.items()}))
        return RuleSet(tuple(out), allowlist)


def _strings(table: dict, key: str, strict: bool = False) -> tuple[str, ...]:
    values = table.get(key)
    if not isinstance(values, list):
        return ()
    if strict and not all(isinstance(v, str) for v in values):
        raise InvalidCatalog(f"{key} must hold strings only")
    return tuple(v for v in values if isinstance(v, str))


def _allowlist(table: object, strict_paths: bool) -> Allowlist:
    if not isinstance(table, dict):
        return Allowlist()
    target = table.get("regexTarget")
    return Allowlist(
        paths=_strings(table, "paths", strict=strict_paths),
        commits=_strings(table, "commits"),
        regex_target=target if isinstance(target, str) else "",
        regexes=_strings(table, "regexes"),
        stopwords=_strings(table, "stopwords"),
    )


def _rule(table: dict, path_rules: bool) -> Rule:
    alone = path_rules and "regex" not in table and isinstance(table.get("path"), str)
    for key in ("description", "id") if alone else ("description", "id", "regex"):
        if not isinstance(table.get(key), str):
            raise InvalidCatalog(f"rule without {key}: {table!r:.200}")
    keywords = table.get("keywords", [] if alone else None)
    if not isinstance(keywords, list) or not all(isinstance(k, str) for k in keywords):
        raise InvalidCatalog(f"rule without a keyword list: {table['id']}")
    group, entropy, path = table.get("secretGroup"), table.get("entropy"), table.get("path")
    return Rule(
        id=table["id"],
        description=table["description"],
        regex=table.get("regex"),
        keywords=tuple(keywords),
        allowlist=_allowlist(table["allowlist"], False) if "allowlist" in table else None,
        secret_group=group if isinstance(group, int) else None,
        entropy=float(entropy) if isinstance(entropy, (int, float)) else None,
        path=path if isinstance(path, str) else None,
        tags=_strings(table, "tags"),
    )


def parse_catalog(text: str, path_rules: bool = False) -> RuleSet:
    """TOML text to a rule set. Unknown keys are ignored. With ``path_rules`` a
    rule may have a path and no regex (X3); else that is refused."""
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise InvalidCatalog(str(e)) from e
    if not isinstance(data.get("rules"), list):
        raise InvalidCatalog("no [[rules]]")
    return RuleSet(
        rules=tuple(_rule(r, path_rules) for r in data["rules"]),
        allowlist=_allowlist(data.get("allowlist"), True),
    )


def load_catalog(path: str) -> RuleSet:
    """Read a TOML catalogue file."""
    try:
        text = Path(path).read_text(encoding="utf-8")
    except OSError as e:
        raise EmptyCatalog(str(e)) from e
    return parse_catalog(text)


def load_extended(path: str, default: RuleSet | None = None, depth: int = 2) -> RuleSet:
    """Follow ``[extend]`` (``path`` or ``useDefault``) up to two levels.

    Rules of the extending file win on equal ids, allowlists are appended.
    """
    base = load_catalog(path)
    extend = tomllib.loads(Path(path).read_text(encoding="utf-8")).get("extend", {})
    if depth == 0 or not extend:
        return base
    if extend.get("useDefault") and extend.get("path"):
        raise InvalidCatalog("useDefault and path exclude each other")
    if extend.get("useDefault"):
        if default is None:
            raise InvalidCatalog("useDefault needs the default rules")
        return extend_rules(base, default)
    if extend.get("path"):
        return extend_rules(base, load_extended(extend["path"], default, depth - 1))
    return base


def extend_rules(base: RuleSet, other: RuleSet) -> RuleSet:
    """X5 on rule sets; ``operators.rules.extend`` does it on tables."""
    known = {r.id for r in base.rules}
    a, b = base.allowlist, other.allowlist
    return RuleSet(
        base.rules + tuple(r for r in other.rules if r.id not in known),
        Allowlist(
            a.paths + b.paths,
            a.commits + b.commits,
            a.regex_target or b.regex_target,
            a.regexes + b.regexes,
            a.stopwords + b.stopwords,
        ),
    )


def load_stopwords(path: str, rule_id: str = "generic-api-key") -> tuple[str, ...]:
    """The stopwords of a rule in a catalogue file (``.toml``), or a file with one word
    per line."""
    if path.endswith(".toml"):
        rules = [r for r in load_catalog(path).rules if r.id == rule_id]
        if not rules or rules[0].allowlist is None:
            raise InvalidCatalog(f"{path} has no stopwords of {rule_id}")
        return rules[0].allowlist.stopwords
    return tuple(w for w in Path(path).read_text(encoding="utf-8").splitlines() if w)


def _data(name: str) -> str:
    return resources.files(__package__).joinpath(name).read_text(encoding="utf-8")


def stock_stopwords() -> tuple[str, ...]:
    """The whole stopword list of the generic rule, 1,474 words in their natural order."""
    return tuple(tomllib.loads(_data("stock_stopwords.toml"))["stopwords"])


def stock_rules(stopwords: Sequence[str], config_paths: Sequence[str] = ()) -> RuleSet:
    """The 149 stock rules and the stock path allowlist.

    ``stopwords`` is the list of the generic rule and has no default, as any list but the
    whole one reports more: ``stock_stopwords()`` is the stock list, ``load_stopwords``
    reads another, ``()`` asks for the rule without stopwords.
    ``config_paths`` are further allow-listed paths, such as ``/`` + the name of
    the catalogue file that a repository keeps for itself.
    """
    rules = parse_catalog(_data("stock_rules.toml")).with_stopwords("generic-api-key", stopwords)
    allow = rules.allowlist
    return replace(rules, allowlist=replace(allow, paths=allow.paths + tuple(config_paths)))
