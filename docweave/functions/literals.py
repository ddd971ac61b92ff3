"""Literals that a pattern cannot match without: a cheap look before the pattern itself."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from re import _constants as c
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F


def mandatory_literal(pattern: str) -> str:
    """The longest text that every match of the pattern holds as it stands; empty if none is sure.

    Literals in a row are one text; boundaries between them don't part it, classes, choices and repeats do. What must
    be repeated holds its own literal once. Patterns with flags, or that Python cannot read, have none.
    """
    return max(mandatory_literals(pattern), key=len, default="")


def mandatory_literals(pattern: str) -> list[str]:
    """All texts that every match of the pattern holds, in its order; see mandatory_literal()."""
    try:
        tree = parser.parse(pattern)
    except (re.error, OverflowError):
        return []
    if tree.state.flags & re.IGNORECASE or "(?" in re.sub(r"\(\?(?::|[=!]|<[=!])", "", pattern.replace("(?<prefix>", "(")):
        return []
    runs: list[str] = [""]

    def walk(items: parser.SubPattern) -> None:
        for kind, value in items:
            if kind is c.LITERAL:
                runs[-1] += chr(value)
            elif kind is c.SUBPATTERN:
                walk(value[-1])
            elif kind is c.MAX_REPEAT and value[0] >= 1:
                runs.append("")
                walk(value[2])
                runs.append("")
            elif kind is not c.AT and kind not in (c.ASSERT, c.ASSERT_NOT):
                runs.append("")

    walk(tree)
    return [r for r in runs if r]


def sql_text(text: str) -> str:
    """A text as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_found(column: str, pattern: str, flags: str = "") -> str:
    """SQL for whether the pattern is found in the column; its mandatory literals, longest first, are looked for before.

    A pattern of nothing but (?=.*x) is found where each x is; as it stands it would read the rest of the text from
    every place of it. That needs the flag s, by which the dot is any character.
    """
    ahead = _looked_ahead(pattern) if "s" in flags else []
    if ahead:
        return f"({' AND '.join(sql_found(column, x, flags) for x in ahead)})"
    literals = sorted({x for x in mandatory_literals(pattern) if len(x) > 1}, key=lambda x: (-len(x), x))
    looks = [f"contains({column}, {sql_text(x)})" for x in literals]
    found = " AND ".join([*looks, f"regexp_like({column}, {sql_text(flags + pattern)})"])
    return f"({found})" if looks else found


def _looked_ahead(pattern: str) -> list[str]:
    """What a pattern of nothing but (?=.*x)(?=.*y) looks for; empty for all others."""
    parts = pattern[5:-1].split(")(?=.*") if pattern.startswith("(?=.*") and pattern.endswith(")") else []
    try:
        whole = all(parser.parse(x) and not re.search(r"\||\(\?=", x) for x in parts)
    except re.error:
        return []
    return parts if whole else []


def may_match(upper: Column, pattern: str) -> Column:
    """Whether a pattern, be it without regard to case, may be found in a text given in upper case. Never false for a match.

    Literals with other than ASCII letters are not looked for; of patterns whose case is that of Unicode, none is.
    """
    flags, plain = re.fullmatch(r"(?:\(\?([a-zA-Z]+)\))?(.*)", pattern, re.DOTALL).groups()
    words = {x.upper() for x in mandatory_literals(plain) if len(x) > 1 and x.isascii()}
    found = F.lit(True)
    for word in sorted(words, key=lambda x: (-len(x), x)) if "u" not in (flags or "").lower() else ():
        found = found & F.contains(upper, F.lit(word))
    return found


def sql_may(column: str, patterns: Iterable[str]) -> str:
    """SQL for whether one of the patterns may be found in the column: all literals of one are there. Never false for a match.

    Literals that few patterns have are looked for first, so that most patterns cost one look.
    """
    sets = [sorted({x for x in mandatory_literals(p) if len(x) > 1}) for p in patterns]
    if not sets:
        return "false"
    if not all(sets):
        return "true"
    often = Counter(x for words in sets for x in words)
    rows = dict.fromkeys(tuple(sorted(words, key=lambda x: (often[x], -len(x), x))) for words in sets)
    listed = ", ".join(f"array({', '.join(map(sql_text, words))})" for words in rows)
    # The column is named once: a filter that is pushed below its projection computes it once.
    return f"exists(array({column}), value -> exists(array({listed}), words -> forall(words, word -> contains(value, word))))"
