"""Secret scans with multipart credential linking.

Strong patterns (assignments, access identifiers, long hex runs) are reported as they
are. Weak parts are not secrets by themselves: a user or key identifier, a quoted key or
password, an address. They are reported only where complementary parts meet: an
identifier and a secret within ``reach`` characters in one scope, and an address beside
such a pair. A scope is a paragraph, the text between blank lines.

The interval join of the parts of a scope is a search for the nearest complement on each
side, so it is linear in the parts however many there are, and it runs where the text
was read: no text and no part moves.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REACH = 300

# The base patterns, in the order in which equal starts are listed.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "identifier", "key", "endpoint")
MIN_ASSIGNED, MIN_ACCESS, MIN_HEX = 6, 20, 24

# Weak parts; group 1 is the part. It has no greatest length: its characters end it.
IDENTIFIER = re.compile(
    r"""(?<![A-Za-z0-9])(?:user(?:name)?|login|account|client_?id|(?:access_?)?key_?id)"""
    r"""["']?[\x20\t]*[:=][\x20\t]*["']?([A-Za-z0-9_.@+-]{3,})""",
    re.ASCII | re.IGNORECASE,
)
KEY = re.compile(
    r"""(?<![A-Za-z0-9])(?:pass(?:wd|word|phrase)?|pwd|key|auth|credentials?|signature)"""
    r"""["']?[\x20\t]*[:=][\x20\t]*["']?([^\s"']{6,})""",
    re.ASCII | re.IGNORECASE,
)
BARE_KEY = re.compile(r"(?<![A-Za-z0-9+/=_-])([A-Za-z0-9+/]{40}={0,2})(?![A-Za-z0-9+/=_-])")
ENDPOINT = re.compile(
    r"""((?:https?|ftps?|ssh|sftp|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?)"""
    r"""://[^\s"'<>]+)""",
    re.ASCII | re.IGNORECASE,
)
HOST = re.compile(
    r"""(?<![A-Za-z0-9])(?:host(?:name)?|endpoint|server|bucket)"""
    r"""["']?[\x20\t]*[:=][\x20\t]*["']?([A-Za-z0-9.:-]{4,})""",
    re.ASCII | re.IGNORECASE,
)
BLANK_LINE = re.compile(r"\n[\x20\t\r]*\n")
_ASSIGN_WORDS = ("passw", "secret", "token", "api")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Strong spans by kind, leftmost and without overlap within a kind."""
    found: list[Span] = []
    lowered = text.lower()
    if any(w in lowered for w in _ASSIGN_WORDS):
        found += [
            ("assign", m.start(), m.end())
            for m in ASSIGN.finditer(text)
            if len(m[2]) >= MIN_ASSIGNED
        ]
    if "AKIA" in text:
        found += [
            ("access", m.start(), m.end())
            for m in ACCESS.finditer(text)
            if m.end() - m.start() >= MIN_ACCESS
        ]
    found += [
        ("hex", m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= MIN_HEX
    ]
    return found


def _mixed(value: str) -> bool:
    """Capitals, small letters and digits: what a drawn key has and a word has not."""
    return bool(re.search(r"[A-Z]", value) and re.search(r"[a-z]", value) and re.search(r"\d", value))


def _weak(text: str) -> list[Span]:
    found = []
    if ":" in text or "=" in text:
        for kind, pattern in (("identifier", IDENTIFIER), ("key", KEY), ("endpoint", HOST)):
            found += [(kind, *m.span(1)) for m in pattern.finditer(text)]
        if "://" in text:
            found += [("endpoint", *m.span(1)) for m in ENDPOINT.finditer(text)]
    found += [("key", *m.span(1)) for m in BARE_KEY.finditer(text) if _mixed(m[1])]
    return found


def _near(spans: list[Span], others: list[Span], reach: int) -> list[Span]:
    """Those of ``spans`` with one of ``others`` within ``reach`` in the same scope; all
    are of one scope. The nearest on each side decides."""
    starts = sorted(s for _, s, _ in others)
    ends = sorted(e for _, _, e in others)
    out = []
    for kind, start, end in spans:
        i = bisect_left(starts, start)
        j = bisect_right(ends, end)
        after = i < len(starts) and starts[i] - end <= reach
        before = j > 0 and start - ends[j - 1] <= reach
        if after or before:
            out.append((kind, start, end))
    return out


def linked_spans(text: str, base: list[Span], reach: int = REACH) -> list[Span]:
    """Weak spans that complete a credential, none within a strong span."""
    weak = _weak(text)
    strong_id = [s for s in base if s[0] == "access"]
    strong_key = [s for s in base if s[0] != "access"]
    if not any(k != "endpoint" for k, _, _ in weak):
        if not (weak and strong_id and strong_key):
            return []
    edges = [m.start() for m in BLANK_LINE.finditer(text)]
    scopes: dict[int, list[Span]] = {}
    for s in weak + strong_id + strong_key:
        scopes.setdefault(bisect_right(edges, s[1]), []).append(s)
    taken = _merged(base)
    out: set[Span] = set()
    for parts in scopes.values():
        ids = [p for p in parts if p[0] in ("access", "identifier")]
        keys = [p for p in parts if p[0] in ("assign", "hex", "key")]
        ids, keys = _apart(ids, keys)
        good_ids, good_keys = _near(ids, keys, reach), _near(keys, ids, reach)
        pair = good_ids + good_keys
        ends = [p for p in parts if p[0] == "endpoint"]
        for kind, s, e in [*pair, *(_near(ends, pair, reach) if pair else [])]:
            if kind in ("identifier", "key", "endpoint") and not _covered(taken, s, e):
                out.add((kind, s, e))
    return sorted(out, key=_order)


def _apart(ids: list[Span], keys: list[Span]) -> tuple[list[Span], list[Span]]:
    """A part is not its own complement: of equal intervals the key goes."""
    own = {(s, e) for _, s, e in ids}
    return ids, [k for k in keys if (k[1], k[2]) not in own]


def _merged(base: list[Span]) -> tuple[list[int], list[int]]:
    """(starts, ends) of the strong spans, overlapping ones as one."""
    starts: list[int] = []
    ends: list[int] = []
    for start, end in sorted((s, e) for _, s, e in base):
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def _covered(taken: tuple[list[int], list[int]], start: int, end: int) -> bool:
    """Overlaps a strong span: the first that ends after ``start`` begins before ``end``."""
    starts, ends = taken
    i = bisect_right(ends, start)
    return i < len(starts) and starts[i] < end


def _order(span: Span) -> tuple:
    return span[1], KINDS.index(span[0]), span[2]


def scan_text(text: str | None, reach: int = REACH) -> tuple[list[Span], list[Span]]:
    """(strong spans, all spans), each by start and then kind."""
    text = text or ""
    base = sorted(base_spans(text), key=_order)
    return base, sorted(base + linked_spans(text, base, reach), key=_order)


def scan_credentials(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """(doc_id, spans), one row per row of (doc_id, text).

    ``spans`` is an array of (kind, start, end, strong, value) in code points, by start
    and then kind. Null and empty texts have none; repeated rows stay; an empty table
    gives none.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(
            pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                       ("strong", pa.bool_()), ("value", pa.string())])
        )
        for batch in batches:
            ids, texts = batch.columns
            rows = []
            for text in texts:
                text = text.as_py() or ""
                base, spans = scan_text(text, reach)
                strong = set(base)
                rows.append([
                    {"kind": k, "start": s, "end": e, "strong": (k, s, e) in strong,
                     "value": text[s:e]}
                    for k, s, e in spans
                ])
            yield pa.RecordBatch.from_arrays([ids, pa.array(rows, kind)], names=["doc_id", "spans"])

    narrow = docs.select("doc_id", "text")
    return narrow.mapInArrow(
        run,
        f"doc_id {narrow.schema['doc_id'].dataType.simpleString()},"
        " spans array<struct<kind:string,start:int,end:int,strong:boolean,value:string>>",
    )


def listed(spans):
    """Spans as ``kind:start:end``, comma-joined in their order."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
