"""Personal data replaced by keyed surrogates of the same type and format.

Detected are e-mail addresses, phone numbers, payment cards, IPv4 addresses, social
security numbers, IBANs and names: capitalised words after a title, and the same words
without one, capitalised, elsewhere in that text. An entity is a kind with a canonical
value (digits without punctuation, lower case), so all spellings of one value get one
surrogate, in all documents. A name may be found with several titles and as given and
family name; one kind is chosen for it in the whole corpus. The surrogate is drawn
from a keyed hash of kind and value and keeps what the kind needs: length and
punctuation, the first digit and the validity of check digits, private or public
address ranges, top-level domain, letter case, script, and the gender that the title of a
name tells.

Distinct entities must stay distinct. The distinct entities of the corpus are gathered
(combined before they move), and where surrogates meet each other or a real value, all
but one draw again, in rounds, until none meet; names of all kinds of a script count
together. From the third time on an entity draws from a space that is ten times larger or
more with each attempt (further digits or syllables, other address ranges), so a kind
with few possible values, or with all of them taken, comes to an end as well. Entities that were redrawn or whose kind was changed are few; up to
``max_redrawn`` of them go to the tasks as a dictionary, more are joined to their
documents instead.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from hashlib import blake2b

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaksieve.llm.common import fresh, saved

MAX_REDRAWN = 100_000

# Titles and the gender that they tell (n: none).
TITLES = {
    "Mr": "m", "Sir": "m", "Herr": "m", "Señor": "m", "Don": "m", "Monsieur": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Señora": "f", "Doña": "f",
    "Madame": "f", "Mme": "f", "Mlle": "f",
    "Dr": "n", "Prof": "n", "Doctor": "n", "Professor": "n",
    "господин": "m", "госпожа": "f", "Κύριος": "m", "Κυρία": "f",
}

# An e-mail address is a run of LOCAL characters that ends at an @, and a DOMAIN after it.
LOCAL = re.compile(r"[\w.%+-]+")
DOMAIN = re.compile(r"@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,}")
NUMBER = re.compile(
    r"""(?<![\w.])(?<!\d[-.])(?:
      (?P<ip>(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}(?!\.\d))
    | (?P<ssn>\d{3}-\d{2}-\d{4})
    | (?P<phone>\+\d{1,3}(?:[ .-]?\(\d{1,5}\))?(?:[ .-]\d{2,4}){2,4} | \+\d{8,15}
        | \(\d{3}\)[ .-]?\d{3}[ .-]\d{4} | \d{3}[.-]\d{3}[.-]\d{4})
    | (?P<card>\d{4}(?:[ -]\d{4}){3} | \d{4}[ -]\d{6}[ -]\d{5} | \d{13,19})
    | (?P<iban>[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?)
    )(?!\w)(?!-\d)""",
    re.VERBOSE | re.ASCII,
)
PERSON = re.compile(
    r"(?<!\w)(" + "|".join(sorted(TITLES, key=len, reverse=True)) + r")\.?[ ](?=[^\W\d_])"
)
_NAME = re.compile(r"[^\W\d_]+(?:[ -][^\W\d_]+){0,2}")
_NAME_WORD = re.compile(r"[^\W\d_]+")
_MENTION = re.compile(r"(?<!\w)[^\W\d_]+(?!\w)")

Entity = tuple[int, int, str, str]  # start, end, kind, canonical value


# ------------------------------------------------------------------- detection


def entities(text: str | None) -> list[Entity]:
    """Entities of a text from left to right; of overlapping ones the earlier, then the
    longer. Each word of a name is an entity of its own, of one kind in the text; its
    mentions without a title count too, if they begin with a capital letter."""
    if not text:
        return []
    found: list[Entity] = []
    if "@" in text:
        found += _emails(text)
    for m in NUMBER.finditer(text):
        value = m[0] if m.lastgroup == "ip" else re.sub(r"[^0-9A-Z+]", "", m[0])
        found.append((m.start(), m.end(), m.lastgroup, value))
    if any(t in text for t in TITLES):
        for m in PERSON.finditer(text):
            found += _names(TITLES[m[1]], _NAME.match(text, m.end()))
    found = _leftmost(found)
    kinds: dict[str, set[str]] = {}
    for _, _, k, v in found:
        if k.startswith(_ROLES):
            kinds.setdefault(v, set()).add(k)
    if not kinds:
        return found
    own = {v: one_kind(k) for v, k in kinds.items()}
    found = [(s, e, own[v] if k.startswith(_ROLES) else k, v) for s, e, k, v in found]
    for m in _MENTION.finditer(text):
        value = m[0].lower()
        if value in own and m[0][0].isupper() and m[0] not in TITLES:
            found.append((m.start(), m.end(), own[value], value))
    return _leftmost(found)


def _emails(text: str) -> Iterator[Entity]:
    """E-mail addresses from left to right. Each run of characters is looked at once, so
    a long word costs its length."""
    end = 0
    for run in LOCAL.finditer(text):
        start = max(run.start(), end)
        if start < run.end() and (m := DOMAIN.match(text, run.end())):
            end = m.end()
            yield start, end, "email", text[start:end].lower()


_ROLES = ("given-", "family-")


def one_kind(kinds: Iterable[str]) -> str:
    """The kind of a name that was found with all of ``kinds``: a given name if it is one
    anywhere, of the gender that its titles tell, of none where they differ."""
    parts = [k.split("-") for k in kinds]
    role = "given" if any(p[0] == "given" for p in parts) else "family"
    told = {p[1] for p in parts} - {"n"}
    return f"{role}-{told.pop() if len(told) == 1 else 'n'}-{parts[0][2]}"


def _leftmost(found: list[Entity]) -> list[Entity]:
    found.sort(key=lambda e: (e[0], -e[1]))
    out: list[Entity] = []
    for e in found:
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


def _names(gender: str, m: re.Match) -> list[Entity]:
    """Leading capitalised words after a title; the last is the family name. A title
    among them begins a name of its own."""
    own = []
    for w in _NAME_WORD.finditer(m[0]):
        other = own and script(w[0]) != script(own[0][0])
        if not w[0][0].isupper() or w[0] in TITLES or other:
            break
        own.append(w)
    out = []
    for i, w in enumerate(own):
        family = i == len(own) - 1
        # Latin and Greek family names are the same for all; Cyrillic ones are not.
        g = gender if not family or script(w[0]) == "cyrillic" else "n"
        kind = f"{'family' if family else 'given'}-{g}-{script(w[0])}"
        out.append((m.start() + w.start(), m.start() + w.end(), kind, w[0].lower()))
    return out


def script(word: str) -> str:
    c = ord(word[0])
    if 0x400 <= c < 0x530:
        return "cyrillic"
    if 0x370 <= c < 0x400 or 0x1F00 <= c < 0x2000:
        return "greek"
    return "latin"


# ------------------------------------------------------------------ surrogates

# Letters and endings of drawn names by script; endings by gender.
_CONSONANTS = {"latin": "bdfgklmnprstvz", "cyrillic": "бвгдзклмнпрст", "greek": "βγδζκλμνπρστφ"}
_VOWELS = {"latin": "aeiou", "cyrillic": "аеиоу", "greek": "αεηιο"}
_ENDINGS = {
    ("given", "latin"): {"m": ("o", "us", "an", "er"), "f": ("a", "ia", "ina", "elle"), "n": ("e", "i", "y")},
    ("given", "cyrillic"): {"m": ("ий", "ан", "ей"), "f": ("а", "ия", "ина"), "n": ("и", "е")},
    ("given", "greek"): {"m": ("ος", "ης", "ας"), "f": ("α", "η", "ια"), "n": ("ι", "ω")},
    ("family", "latin"): {"n": ("son", "er", "ez", "ini", "ard")},
    ("family", "cyrillic"): {"m": ("ов", "ев", "ский"), "f": ("ова", "ева", "ская"), "n": ("ко", "енко")},
    ("family", "greek"): {"n": ("ου", "ιδης", "ακης")},
}


class _Draw:
    """Numbers from a keyed hash, as many as are asked for. ``wider`` widens the space that
    is drawn from: by so many further digits or syllables, or by address ranges."""

    wider = 0

    def __init__(self, key: bytes, *parts: object) -> None:
        self._state = blake2b(
            "\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), key=key, digest_size=32
        ).digest()
        self._value = int.from_bytes(self._state, "big")
        self._left = 1 << 256

    def below(self, n: int) -> int:
        if self._left < n << 64:
            self._state = blake2b(self._state, digest_size=32).digest()
            self._value, self._left = int.from_bytes(self._state, "big"), 1 << 256
        self._value, out = divmod(self._value, n)
        self._left //= n
        return out

    def one_of(self, values):
        return values[self.below(len(values))]


def luhn_valid(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _iban_check(country: str, rest: str) -> str:
    value = "".join(str(int(c, 36)) for c in rest + country + "00")
    return f"{98 - int(value) % 97:02d}"


def _reshaped(value: str, draw: _Draw) -> str:
    """Letters for letters of the same script, digits for digits, the rest as it is."""
    out = []
    for c in value:
        if c.isdigit():
            out.append(str(draw.below(10)))
        elif c.isalpha():
            s = script(c)
            out.append(draw.one_of(_CONSONANTS[s] + _VOWELS[s]))
        else:
            out.append(c)
    return "".join(out)


def surrogate(kind: str, value: str, key: bytes, attempt: int = 0) -> str:
    """Canonical surrogate of a canonical value; never the value itself."""
    for again in range(1000):
        draw = _Draw(key, kind, value, attempt, again)
        draw.wider = max(0, attempt - 2)
        out = _drawn(kind, value, key, draw)
        if out != value:
            return out
    return out  # one possible value only


def _drawn(kind: str, value: str, key: bytes, draw: _Draw) -> str:
    wider = draw.wider
    more = "".join(str(draw.below(10)) for _ in range(wider)) if wider else ""
    if kind == "email":
        local, _, domain = value.rpartition("@")
        host, _, top = domain.rpartition(".")
        # A domain has one surrogate, whoever writes from it.
        return f"{_reshaped(local, draw)}{more}@{_reshaped(host, _Draw(key, 'domain', domain))}.{top}"
    if kind == "ip":
        a, b, c, d = (int(x) for x in value.split("."))
        low = [str(draw.below(256)), str(draw.below(256)), str(1 + draw.below(254))]
        if wider:
            # Private addresses move to the largest private range; then, and all others,
            # to the reserved one, which no host has.
            private = a == 10 or (a, b) == (192, 168) or (a == 172 and 16 <= b < 32)
            first = 10 if private and wider <= 2 else 240 + draw.below(15)
            return ".".join([str(first), *low])
        if a == 10 or a == 127:
            return ".".join([str(a), *low])
        if (a, b) == (192, 168):
            return ".".join(["192.168", *low[1:]])
        if a == 172 and 16 <= b < 32:
            return ".".join(["172", str(16 + draw.below(16)), *low[1:]])
        return ".".join([str(draw.one_of([*range(11, 127), *range(128, 172), *range(173, 192)])), *low])
    if kind == "iban":
        country, rest = value[:2], value[4:]
        rest = "".join(
            str(draw.below(10)) if c.isdigit() else chr(65 + draw.below(26)) for c in rest
        ) + more
        return country + _iban_check(country, rest) + rest
    if kind in ("phone", "card", "ssn"):
        keep = 2 if value[0] == "+" else 1 if kind == "card" else 0
        out = value[:keep] + "".join(str(draw.below(10)) for _ in value[keep:]) + more
        if kind == "card" and luhn_valid(out) != luhn_valid(value):
            last = [d for d in "0123456789" if luhn_valid(out[:-1] + d) == luhn_valid(value)]
            out = out[:-1] + draw.one_of(last)
        return out
    role, gender, s = kind.split("-")
    body = "".join(
        draw.one_of(_CONSONANTS[s]) + draw.one_of(_VOWELS[s]) for _ in range(2 + draw.below(2) + wider)
    )
    return body + draw.one_of(_CONSONANTS[s]) + draw.one_of(_ENDINGS[role, s][gender])


def render(kind: str, original: str, replacement: str) -> str:
    """The canonical surrogate in the format of the original."""
    if kind == "email":
        return replacement.upper() if original.isupper() else replacement
    if kind == "ip":
        return replacement
    if kind in ("phone", "card", "ssn", "iban"):
        chars = iter(replacement)
        shaped = "".join(next(chars) if c.isalnum() or c == "+" else c for c in original)
        return shaped + "".join(chars)  # a widened one is longer
    if original.isupper() and len(original) > 1:
        return replacement.upper()
    return replacement.capitalize() if original[0].isupper() else replacement


def rewrite(text: str | None, key: bytes, attempts: dict) -> tuple[str | None, int]:
    """(text with surrogates, number of entities); ``attempts`` has (kind to draw, attempt)
    by (kind, value) where these are not the found kind and zero."""
    found = entities(text)
    if not found:
        return text, 0
    out, at = [], 0
    for start, end, kind, value in found:
        own, attempt = attempts.get((kind, value), (kind, 0))
        new = surrogate(own, value, key, attempt)
        out += [text[at:start], render(own, text[start:end], new)]
        at = end
    return "".join([*out, text[at:]]), len(found)


# ------------------------------------------------------------------- DataFrames


def distinct_entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, value), each entity of the corpus once."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            own = {(k, v) for t in batch.column(0) for _, _, k, v in entities(t.as_py())}
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in own], pa.string()), pa.array([v for _, v in own], pa.string())],
                names=["kind", "value"],
            )

    return docs.select(text).mapInArrow(run, "kind string, value string").distinct()


def resolved(found: DataFrame) -> DataFrame:
    """(kind, value, own): ``one_kind`` of all kinds that a name has in the corpus."""
    part = lambda i: F.get(F.split("kind", "-"), F.lit(i))
    is_name = part(0).isin("given", "family")
    of = found.filter(is_name).groupBy("value").agg(
        F.max(part(0) == "given").alias("given"),
        F.max(part(1) == "m").alias("m"),
        F.max(part(1) == "f").alias("f"),
        F.min(part(2)).alias("script"),
    )
    own = F.concat_ws(
        "-",
        F.when(F.col("given"), "given").otherwise("family"),
        F.when(F.col("m") & ~F.col("f"), "m").when(F.col("f") & ~F.col("m"), "f").otherwise("n"),
        "script",
    )
    names = found.filter(is_name).join(of.select("value", own.alias("own")), "value")
    return names.select("kind", "value", "own").unionByName(
        found.filter(~is_name).select("kind", "value", F.col("kind").alias("own"))
    )


def _scope() -> Column:
    """What surrogates must be distinct in: the kind, for names the script."""
    return F.regexp_replace("kind", "^(given|family)-[mfn]-", "name-")


def _drawn_for(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, attempt) with the surrogate of that attempt."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            new = pa.array([surrogate(k, v, key, a) for k, v, a in rows], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, new], names=["kind", "value", "attempt", "surrogate"]
            )

    return found.select("kind", "value", "attempt").mapInArrow(
        run, "kind string, value string, attempt int, surrogate string"
    )


def assign(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, attempt, surrogate): distinct surrogates within a kind, for names
    within a script, none a real value of the corpus. Of values that meet, that of the earlier attempt, then the
    lesser one, keeps its surrogate; what is decided stays decided."""
    real = found.select(_scope().alias("scope"), F.col("value").alias("surrogate")).distinct()
    table = saved(_drawn_for(found.withColumn("attempt", F.lit(0)), key), "pii-drawn")
    while True:
        row = F.struct("attempt", "value", "kind")
        drawn = table.withColumn("scope", _scope())
        owners = drawn.groupBy("scope", "surrogate").agg(
            F.min(row).alias("owner"), F.count(F.lit(1)).alias("n")
        )
        losers = (
            drawn.join(owners.filter("n > 1"), ["scope", "surrogate"])
            .filter(row != F.col("owner"))
            .select("kind", "value", "attempt")
            .unionByName(drawn.join(real, ["scope", "surrogate"]).select("kind", "value", "attempt"))
            .distinct()
        )
        losers = saved(losers, "pii-losers")
        if losers.isEmpty():
            return table
        again = _drawn_for(losers.withColumn("attempt", F.col("attempt") + 1), key)
        table = saved(
            table.join(losers, ["kind", "value"], "left_anti").unionByName(again), "pii-drawn"
        )


def replace_entities(
    docs: DataFrame, key: bytes, text: str = "text", max_redrawn: int = MAX_REDRAWN
) -> DataFrame:
    """``docs`` with surrogates in ``text`` and the number of entities in ``n_replaced``.

    Rows keep their order and all other columns; null and empty texts stay as they are.
    A column of the name ``n_replaced`` gives way. An empty table gives an empty one.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "n_replaced"])
    found = saved(resolved(saved(distinct_entities(docs, text), "pii-entities")), "pii-kinds")
    table = assign(found.select(F.col("own").alias("kind"), "value").distinct(), key)
    drawn = table.select(F.col("kind").alias("own"), "value", "attempt")
    changed = found.join(drawn, ["own", "value"]).filter("attempt > 0 OR own != kind")
    redrawn = saved(changed.select("kind", "value", "own", "attempt"), "pii-redrawn")
    if redrawn.count() <= max_redrawn:
        few = {(r["kind"], r["value"]): (r["own"], r["attempt"]) for r in redrawn.collect()}
        return _rewritten(docs, key, text, lambda batch: [few] * batch.num_rows)
    return _rewritten_by_join(docs, redrawn, key, text)


def _rewritten(docs: DataFrame, key: bytes, text: str, attempts, drop: str | None = None) -> DataFrame:
    names = [c for c in docs.columns if c != drop]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            own = batch.column(text)
            new = [rewrite(t.as_py(), key, a) for t, a in zip(own, attempts(batch))]
            columns = [
                pa.array([t for t, _ in new], own.type) if n == text else batch.column(n)
                for n in names
            ]
            counts = pa.array([n for _, n in new], pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, counts], names=[*names, "n_replaced"])

    schema = docs.select(*[F.col(f"`{c}`") for c in names]).schema.add("n_replaced", "long")
    return docs.mapInArrow(run, schema)


def _rewritten_by_join(docs: DataFrame, redrawn: DataFrame, key: bytes, text: str) -> DataFrame:
    """The same with the attempts of each document's own entities beside its text."""
    uid, own = fresh(docs, "uid", "attempts")
    marked = saved(docs.withColumn(uid, F.monotonically_increasing_id()), "pii-texts")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = [
                (u.as_py(), k, v)
                for u, t in zip(*batch.columns)
                for k, v in {(k, v) for _, _, k, v in entities(t.as_py())}
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], kind)
                 for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))],
                names=[uid, "kind", "value"],
            )

    held = marked.select(uid, text).mapInArrow(run, f"`{uid}` long, kind string, value string")
    attempts = held.join(redrawn, ["kind", "value"]).groupBy(uid).agg(
        F.collect_list(F.struct("kind", "value", "own", "attempt")).alias(own)
    )
    both = marked.join(attempts, uid, "left").drop(uid)

    def of(batch):
        return [
            {(a["kind"], a["value"]): (a["own"], a["attempt"]) for a in x or ()}
            for x in batch.column(own).to_pylist()
        ]

    return _rewritten(both, key, text, of, drop=own)
