"""Text and pattern functions.

Patterns in a catalogue follow the dialect of linear-time engines: Unicode
classes, ``.`` and ``$`` sensitive to ``\\n`` only, no look-around, no
back-references. ``java_pattern`` gives the Java pattern with that meaning, so
every match stays inside the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from leaksieve.errors import UnsupportedPattern

# d: only \n ends a line; U: Unicode classes; -u: no folding of ı and İ to i, which simple
# case folding does not have. What it has beyond ASCII is spelled out in the pattern.
_FLAGS = "dU-u"
_FLAGS_BEYOND_ASCII = "dU"

_UNSUPPORTED = re.compile(r"(?<!\\)(?:\\\\)*(?:\(\?<?[=!]|\\[1-9])")
_TEXT_ANCHOR = re.compile(r"\\[AzZGB]|\(\?[a-zA-Z]*-")
_OPEN_GROUP_REPEAT = re.compile(r"\)(?:[*+]|\{\d+,\})")


def check_pattern(pattern: str) -> str:
    """Return ``pattern``, or raise if linear-time engines would reject it."""
    if _UNSUPPORTED.search(pattern):
        raise UnsupportedPattern(f"look-around or back-reference in {pattern!r}")
    return pattern


# Bracketed ASCII classes, which Java does not know.
_POSIX_CLASSES = {
    "[:alnum:]": "0-9A-Za-z",
    "[:alpha:]": "A-Za-z",
    "[:blank:]": r"\t ",
    "[:digit:]": "0-9",
    "[:lower:]": "a-z",
    "[:space:]": r"\t\n\x0B\f\r ",
    "[:upper:]": "A-Z",
    "[:word:]": "0-9A-Za-z_",
    "[:xdigit:]": "0-9A-Fa-f",
}


def _java_syntax(pattern: str) -> str:
    # Names of groups are not used, and one pattern may be joined with another.
    out = re.sub(r"\(\?P?<\w+>", "(", check_pattern(pattern))
    for name, chars in _POSIX_CLASSES.items():
        out = out.replace(name, chars)
    return out


# Character classes, groups with flags, escapes, and single characters of a pattern.
_TOKENS = re.compile(r"\[\^?\]?(?:\\.|[^\]\\])*\]|\(\?[a-zA-Z-]*[:)]|\\.|.", re.S)

# Simple case folding of ASCII letters beyond ASCII (Kelvin sign, long s).
_FOLDED = {"k": "\u212a", "s": "\u017f"}


def _class_has(token: str, letter: str) -> bool:
    try:
        body = token[0] + token[1:].removeprefix("^")
        return bool(re.match(body, letter) or re.match(body, letter.upper()))
    except re.error:
        return False


def _translated(pattern: str, end: str) -> str:
    """Java pattern with simple case folding where ``(?i)`` is on and with ``end`` for
    the anchor ``$``."""
    out = []
    fold, outer = False, []
    for token in _TOKENS.findall(_java_syntax(pattern)):
        if token.startswith("(?") and len(token) > 2 and token[-1] in ":)":
            on, _, off = token[2:-1].partition("-")
            if token[-1] == ":":
                outer.append(fold)
            fold = ("i" in on or fold) and "i" not in off
        elif token == "(":
            outer.append(fold)
        elif token == ")" and outer:
            fold = outer.pop()
        elif token == "$":
            token = end
        elif fold and token[0] == "[" and len(token) > 1:
            more = "".join(f for c, f in _FOLDED.items() if _class_has(token, c))
            token = token[:-1] + more + "]"
        elif fold and token.lower() in _FOLDED:
            c = token.lower()
            token = f"[{c}{c.upper()}{_FOLDED[c]}]"
        out.append(token)
    return "".join(out)


def _flags(pattern: str, more: str = "") -> str:
    return f"(?{more}{_FLAGS if pattern.isascii() else _FLAGS_BEYOND_ASCII})"


def java_pattern(pattern: str) -> str:
    """For a line or a whole value: ``$`` is the very end, as without the flag m."""
    sees_lines = re.search(r"\(\?[a-zA-Z]*m", pattern)
    return _flags(pattern) + _translated(pattern, "$" if sees_lines else r"\z")


def java_pattern_multiline(pattern: str) -> str:
    """The same pattern with ``^`` and ``$`` at every line of a whole text."""
    return _flags(pattern, "m") + _translated(pattern, "$")


def ancestor_pattern(pattern: str) -> str | None:
    """Pattern that is found in a path iff ``pattern`` is found in the path or in one of
    its folders; None if an anchor or a branch stands in the way of that.

    A folder ends where a slash follows (the empty one does not count). Only a pattern
    with one end anchor, its last character, and without a top-level branch is such.
    """
    tokens = _TOKENS.findall(_java_syntax(pattern))
    depth = 0
    for t in tokens[:-1]:
        depth += (t == "(" or (t.startswith("(?") and t[-1] == ":")) - (t == ")")
        if t == "$" or (t == "|" and depth == 0) or t in (r"\A", r"\z", r"\Z", r"\G", r"\b", r"\B"):
            return None
    if not tokens or tokens[-1] != "$":
        return None
    # A scan for a look-ahead must not depend on what follows the folder.
    return _flags(pattern) + _translated(pattern, r"(?<!\A)(?=/|\z)")


def implied_by_line_match(pattern: str) -> bool:
    """True if a match in one line always implies a multi-line match in the text.

    Text anchors and switched-off flags break that. An unbounded repeat of a
    group is also refused, because Java recurses once per repetition and a whole
    text is much longer than a line.
    """
    return not (_TEXT_ANCHOR.search(pattern) or _OPEN_GROUP_REPEAT.search(pattern))


_BEYOND_ASCII = r"\x{80}-\x{10FFFF}"


def screen_patterns(pattern: str) -> tuple[str | None, str | None]:
    """Linear-time patterns for a first look at (ASCII texts, any text).

    Each is found in a whole text wherever ``pattern`` is found in one of its lines;
    None where that cannot be promised. The linear-time engine knows ASCII classes
    only, so for any text each class is widened by all other characters; and its ``\\s``
    lacks the vertical tab, which is added.
    """
    if not implied_by_line_match(pattern) or re.search(r"\\[pPQ]", pattern):
        return None, None
    plain: list[str] = []
    wide: list[str] | None = []
    for token in _TOKENS.findall(pattern):
        broad = token
        if token[0] == "[" and len(token) > 1:
            body = token[1:-1]
            if "[" in re.sub(r"\\.", "", body) or re.search(r"&&|--|~~", body):
                return None, None  # nested or combined classes mean something else there
            if body[0] == "^":
                # A negated class lets more through there, unless a negated one is inside.
                if re.search(r"\\S", body):
                    return None, None
                wide = None if re.search(r"\\[DW]", body) else wide
            else:
                tab = r"\x0B" if re.search(r"\\s", body) else ""
                token = f"[{body}{tab}]"
                broad = f"[{body}{tab}{_BEYOND_ASCII if re.search(r'\\[dsw]', body) else ''}]"
        elif token == r"\s":
            token, broad = r"[\s\x0B]", rf"[\s\x0B{_BEYOND_ASCII}]"
        elif token in (r"\d", r"\w"):
            broad = f"[{token}{_BEYOND_ASCII}]"
        elif token in (r"\b", r"\B"):
            broad = "(?:)"
        plain.append(token)
        if wide is not None:
            wide.append(broad)
    return "(?m)" + "".join(plain), "(?m)" + "".join(wide) if wide is not None else None


def lossy_utf8(content: Column | str) -> Column:
    """L3: decode bytes as UTF-8; each invalid sequence becomes U+FFFD."""
    c = F.col(content) if isinstance(content, str) else content
    return F.make_valid_utf8(c.cast("string"))


def unix_newlines(content: Column | str) -> Column:
    return F.replace(
        F.col(content) if isinstance(content, str) else content, F.lit("\r\n"), F.lit("\n")
    )


def lines(content: Column | str) -> Column:
    """Array of lines. One CR before LF goes, a lone CR stays, and a final
    line break opens no further line."""
    return lines_of_unix_text(unix_newlines(content))


def lines_of_unix_text(text: Column | str) -> Column:
    """The same for the output of ``unix_newlines``; done twice, CR CR LF would lose
    both CRs."""
    text = F.col(text) if isinstance(text, str) else text
    body = F.when(F.endswith(text, F.lit("\n")), F.left(text, F.length(text) - 1)).otherwise(text)
    return F.when(text == "", F.lit([]).cast("array<string>")).otherwise(F.split(body, "\n", -1))


def group_of_match(text: Column, pattern: Column, group: Column) -> Column:
    """``regexp_extract`` with pattern and group taken from columns."""
    return F.call_function("regexp_extract", text, pattern, group)


def first_match(line: Column | str, pattern: Column | str) -> Column:
    """D3: leftmost match (group 0), NULL when there is none.

    An empty match stays ``''``; ``regexp_substr`` would lose it.
    """
    line = F.col(line) if isinstance(line, str) else line
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.when(F.rlike(line, pattern), group_of_match(line, pattern, F.lit(0)))


def words_pattern(words: Sequence[str]) -> str:
    """Java pattern that is found in a text iff one of the words is a substring of it.

    The words share their beginnings: alternatives are told apart by their next
    character, so a place in the text costs one look at the first characters and not one
    search per word. Words that begin with another word are implied by it.
    """
    tree: dict = {}
    for word in sorted(set(words), key=len):
        node = tree
        for c in word:
            if None in node:  # a shorter word ends here
                break
            node = node.setdefault(c, {})
        else:
            node.clear()
            node[None] = {}

    def written(node: dict) -> str:
        chain = ""
        while len(node) == 1 and None not in node:
            c, node = next(iter(node.items()))
            chain += _quoted(c)
        if None in node:
            return chain
        # Branches that are one character only become a class.
        ends = "".join(_quoted(c) for c, below in node.items() if None in below)
        parts = [_quoted(c) + written(below) for c, below in node.items() if None not in below]
        if ends:
            parts.append(f"[{ends}]")
        return chain + (parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})")

    return written(tree) if tree else r"(?!)"


def _quoted(c: str) -> str:
    return "\\" + c if c.isascii() and not c.isalnum() and c.isprintable() and c != " " else (
        c if c.isprintable() or c == " " else f"\\x{{{ord(c):X}}}"
    )


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """Some of the words is a substring of ``text`` (case-sensitive)."""
    if len(words) < WORDS_PATTERN_FROM:
        return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words], F.lit(False))
    return F.rlike(text, F.lit(words_pattern(words)))


def matches_any(text: Column, patterns: Sequence[str]) -> Column:
    """Some pattern of the list is found in ``text``; an empty list is false. Each
    pattern is a literal of the plan, so it is compiled once."""
    tests = [F.rlike(text, F.lit(java_pattern(p))) for p in patterns]
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def is_regex(entry: Column | str) -> Column:
    """An allowlist entry is a pattern iff it starts with ``(`` and ends with ``$``."""
    c = F.col(entry) if isinstance(entry, str) else entry
    return F.startswith(c, F.lit("(")) & F.endswith(c, F.lit("$"))


def is_link(text: Column | str) -> Column:
    """The text holds an http(s) or www link."""
    c = F.col(text) if isinstance(text, str) else text
    return F.rlike(c, F.lit(java_pattern(LINK_PATTERN)))


# From here on one pattern of all words beats one search per word.
WORDS_PATTERN_FROM = 8

# Patterns that decide results.
LINK_PATTERN = r"(?i)\b((?:https?://|www\.)\S+)\b"
REPO_URL_PATTERN = r"/([^/]+)\.git$"


def repo_name_from_url(url: Column | str) -> Column:
    """Last path part of a ``.git`` URL, NULL for any other text."""
    c = F.col(url) if isinstance(url, str) else url
    return first_group(c, REPO_URL_PATTERN)


def first_group(text: Column, pattern: str) -> Column:
    p = java_pattern(pattern)
    return F.when(F.rlike(text, F.lit(p)), F.regexp_extract(text, p, 1))


def repo_dir_name(path: Column | str) -> Column:
    """Last component of a repository folder without a trailing ``.git``."""
    c = F.col(path) if isinstance(path, str) else path
    trimmed = F.regexp_replace(c, r"/+\z", "")
    last = F.element_at(F.split(trimmed, "/"), -1)
    return F.coalesce(F.regexp_replace(last, r"\.git\z", ""), F.lit(""))
