"""A plain Python scan, as slow and as literal as the semantics read. Tests only."""

import re


def split_lines(text):
    parts = text.split("\n")
    if parts[-1] == "":
        parts.pop()
    else:
        parts[-1] += "\0"  # the last line had no line feed: its CR stays
    out = []
    for p in parts:
        if p.endswith("\0"):
            out.append(p[:-1])
        else:
            out.append(p[:-1] if p.endswith("\r") else p)
    return out


def rust(pattern):
    """Python pattern for a catalogue pattern; inline flags move to the front."""
    flags = re.I if "(?i)" in pattern else 0
    return re.compile(pattern.replace("(?i)", ""), flags)


def listed(regexes, stopwords, target):
    if regexes and stopwords:
        return False
    return any(re.search(r, target) for r in regexes) or any(w in target for w in stopwords)


def path_listed(path, paths):
    """A pattern is searched; equality counts iff some entry is no pattern."""
    patterns = {p for p in paths if p[:1] == "(" and p[-1:] == "$"}
    equal = patterns != set(paths) and path in paths
    # Python's $ also stands before a final line feed.
    return equal or any(re.search(p.replace("$", r"\Z"), path) for p in patterns)


def pruned(path, paths):
    parts = path.split("/")
    return any(path_listed("/".join(parts[:i]), paths) for i in range(2, len(parts) + 1))


def scan(content, rules, path="", commit=""):
    """[(rule_pos, line_number, line, match)]"""
    found = []
    g = rules.allowlist
    for pos, rule in enumerate(rules.rules):
        if not any(k in content for k in rule.keywords):
            continue
        pattern = rust(rule.regex)
        for n, line in enumerate(split_lines(content), 1):
            m = pattern.search(line)
            if not m:
                continue
            match = m.group(0)
            if listed(g.regexes, g.stopwords, line if g.regex_target == "line" else match):
                continue
            a = rule.allowlist
            if a:
                if path_listed(path, a.paths) or commit in a.commits:
                    continue
                if listed(a.regexes, a.stopwords, line if a.regex_target == "line" else match):
                    continue
            found.append((pos, n, line, match))
    return found


def smallest(pattern, space=" "):
    """A short text that the pattern matches, from its parse tree; ``space`` stands
    where white space may."""
    from re import _constants as c
    from re import _parser

    def char(items):
        if any(op is c.CATEGORY and v is c.CATEGORY_SPACE for op, v in items) and space != " ":
            return space
        for op, v in items:
            if op is c.LITERAL:
                return chr(v)
            if op is c.RANGE:
                return chr(v[0])
            if op is c.CATEGORY:
                return {c.CATEGORY_SPACE: space, c.CATEGORY_DIGIT: "0"}.get(v, "a")
        return "a"

    def walk(items):
        out = ""
        for op, v in items:
            if op is c.LITERAL:
                out += chr(v)
            elif op is c.NOT_LITERAL:
                out += "~" if chr(v) != "~" else "!"
            elif op is c.ANY:
                out += "a"
            elif op is c.IN:
                out += "~" if v[0][0] is c.NEGATE else char(v)
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
                out += walk(v[2]) * v[0]
            elif op is c.SUBPATTERN:
                out += walk(v[3])
            elif op is c.BRANCH:
                out += walk(v[1][0])
        return out

    return walk(_parser.parse(pattern.replace("(?i)", "")))
