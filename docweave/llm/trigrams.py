"""Boolean trigram queries derived from regular expressions.

A query is True (any text may match), a trigram, or ("and" | "or", parts). Literals are lower-cased, for an index
of lower-cased texts. What a part of the pattern can match is described by the full set of its strings where that is
small ("exact"), else by the strings it can begin and end with; joining two parts yields trigrams across the seam.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

try:  # the parser's home since Python 3.11
    from re import _constants as sre
    from re import _parser as parser
except ImportError:  # pragma: no cover
    import sre_constants as sre
    import sre_parse as parser

Query = bool | str | tuple
#: Above so many strings a set is given up for its edges.
MOST_STRINGS = 40


@dataclass(frozen=True)
class Part:
    exact: frozenset[str] | None
    first: frozenset[str]
    last: frozenset[str]
    query: Query


EMPTY = frozenset([""])
ANYTHING = Part(None, EMPTY, EMPTY, True)


def both(*parts: Query) -> Query:
    return _joined("and", True, parts)


def either(*parts: Query) -> Query:
    return True if any(p is True for p in parts) else _joined("or", False, parts)


def _joined(kind: str, neutral: bool, parts: tuple) -> Query:
    flat: list[Query] = []
    for p in parts:
        flat += p[1] if isinstance(p, tuple) and p[0] == kind else [p]
    kept = tuple(dict.fromkeys(p for p in flat if p is not neutral))
    return neutral if not kept else kept[0] if len(kept) == 1 else (kind, kept)


def of_strings(strings: frozenset[str]) -> Query:
    """One of the strings occurs: all trigrams of one of them do."""
    return either(*(both(*(s[i : i + 3] for i in range(len(s) - 2))) for s in sorted(strings)))


def _strings(values: frozenset[str]) -> Part:
    return Part(values, values, values, True)


def _settled(p: Part) -> Part:
    """Turn sets that grew too large into trigrams plus edges of two characters."""
    if p.exact is not None and len(p.exact) > MOST_STRINGS:
        edges = frozenset(s[:2] for s in p.exact), frozenset(s[-2:] for s in p.exact)
        p = Part(None, *edges, both(p.query, of_strings(p.exact)))
    first, last = frozenset(s[:2] for s in p.first), frozenset(s[-2:] for s in p.last)
    if p.exact is None:
        cut = EMPTY
        p = Part(None, first if len(first) <= MOST_STRINGS else cut, last if len(last) <= MOST_STRINGS else cut, p.query)
    return p


def _then(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= 4 * MOST_STRINGS:
        return _settled(_strings(frozenset(x + y for x, y in product(a.exact, b.exact))))
    seam = of_strings(frozenset(x + y for x, y in product(a.last, b.first)))
    own = [of_strings(p.exact) for p in (a, b) if p.exact is not None]
    first = frozenset(x + y for x, y in product(a.exact, b.first)) if a.exact is not None else a.first
    last = frozenset(x + y for x, y in product(a.last, b.exact)) if b.exact is not None else b.last
    return _settled(Part(None, first, last, both(a.query, b.query, seam, *own)))


def _or(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None:
        return _settled(_strings(a.exact | b.exact))
    full = [both(p.query, of_strings(p.exact)) if p.exact is not None else p.query for p in (a, b)]
    return _settled(Part(None, a.first | b.first, a.last | b.last, either(*full)))


def _set(items: list) -> Part:
    chars: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            chars.add(chr(arg).lower())
        elif op is sre.RANGE and arg[1] - arg[0] < 10:
            chars |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return ANYTHING
    return _strings(frozenset(chars)) if len(chars) <= 10 else ANYTHING


def _of(tree) -> Part:
    done = _strings(EMPTY)
    for op, arg in tree:
        if op is sre.LITERAL:
            part = _strings(frozenset([chr(arg).lower()]))
        elif op is sre.IN:
            part = _set(arg)
        elif op is sre.SUBPATTERN:
            part = _of(arg[-1])
        elif op is sre.BRANCH:
            part = _of(arg[1][0])
            for other in arg[1][1:]:
                part = _or(part, _of(other))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, inner = arg
            if least == 0:
                part = _or(_of(inner), _strings(EMPTY)) if most == 1 else ANYTHING
            else:
                once = _of(inner)
                part = once
                for _ in range(min(least, 3) - 1):
                    part = _then(part, once)
                if most != least or least > 3:
                    part = _then(_then(part, ANYTHING), Part(None, once.first, once.last, True))
        elif op is sre.AT:
            continue
        else:
            part = ANYTHING
        done = _then(done, part)
    return done


def trigram_query(pattern: str) -> Query:
    """What trigrams a lower-cased text must have to match the pattern; True if none is mandatory."""
    whole = _of(parser.parse(pattern, re.ASCII))
    return both(whole.query, of_strings(whole.exact)) if whole.exact is not None else whole.query


def trigrams_of(query: Query) -> list[str]:
    """All trigrams that a query mentions."""
    if isinstance(query, str):
        return [query]
    return sorted({t for p in query[1] for t in trigrams_of(p)}) if isinstance(query, tuple) else []
