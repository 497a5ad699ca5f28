"""Patterns written once, for the regular expressions of Spark and of DuckDB.

``\\b`` means an ASCII word boundary and ``\\s`` Unicode white space with U+00A0 and U+FEFF, in either.
"""

import re

SPACE = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
_WORD = "[A-Za-z0-9_]"
# classes of both cases need no ignoring of case, which makes them slow
_EDGE = rf"(?-i:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def _first_letters(pattern: str) -> str:
    """Letters that a match of ``pattern`` may begin with; empty where it, or an alternative of its leading group, begins with no plain letter."""
    marks = re.findall(r"\\.|\[[^]]*\]|.", pattern, re.S)
    grouped = marks[:1] == ["("]
    found, depth, fresh = [], 0, True
    for c, following in zip(marks[grouped:], [*marks[grouped + 1 :], ""]):
        depth += (c == "(") - (c == ")")
        if grouped and depth < 0:  # the group's end; one that may lack says nothing
            found = [] if fresh or following in ("?", "*", "{") else found
            break
        if fresh and (not (c.isascii() and c.isalpha()) or following in ("?", "*", "{")):
            return ""
        found += [c] * fresh
        fresh = c == "|" and not depth
        if fresh and not grouped:
            return ""
    return "".join(sorted({x for f in found for x in (f.lower(), f.upper())}))


def spark(pattern: str, ignore_case: bool = True) -> str:
    """For rlike, regexp_extract and regexp_replace.

    Where a word must begin, its first letter is looked at before the edge: most places of a text are passed over by that.
    """
    begins = _first_letters(pattern[2:]) if pattern.startswith(r"\b") else ""
    lead = rf"(?-i:(?=[{begins}])(?<!{_WORD}))" if begins else ""
    rest = pattern[2:] if begins else pattern
    return ("(?i)" if ignore_case else "") + lead + rest.replace(r"\b", _EDGE).replace(r"\s", SPACE)


def duckdb(pattern: str) -> str:
    """For a string literal of DuckDB, whose RE2 knows ASCII boundaries."""
    return pattern.replace("'", "''")
