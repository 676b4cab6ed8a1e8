"""Boolean trigram queries derived from regular expressions.

A query is a set of conjunctions, each a set of lower-cased trigrams: a text that
matches the expression contains every trigram of some conjunction. The empty
conjunction is "no condition", so a query holding it must scan fully.

Defined results: these are queries on rules, not on rows, so NULL, empty and very long texts, ties, repeated rows, empty tables and
clashing columns are matters of the scan (see `secrets`): a text without trigrams, NULL included, meets the empty conjunction
only. An empty expression asks for nothing. Expressions that Python's parser refuses raise its error.
"""

from __future__ import annotations

from itertools import product
from re import _constants as op
from re import _parser as parser

Query = frozenset[frozenset[str]]
ANY: Query = frozenset({frozenset()})
#: Strings that an exactly known part may stand for, and characters of a class that is still spelt out.
MOST_STRINGS, MOST_CHARS = 64, 8


def grams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def absorb(q: frozenset) -> Query:
    """Without conjunctions that another one implies."""
    return frozenset(c for c in q if not any(d < c for d in q))


def of_strings(strings: frozenset[str]) -> Query:
    return absorb(frozenset(map(grams, strings)))


def both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > MOST_STRINGS:
        return min(a, b, key=len) if ANY not in (a, b) else (b if a == ANY else a)
    return absorb(frozenset(x | y for x, y in product(a, b)))


def members(items: list) -> frozenset[str] | None:
    """Characters of a class, or None if they are many or not listed."""
    out: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            out.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < MOST_CHARS:
            out |= {chr(x).lower() for x in range(value[0], value[1] + 1)}
        else:
            return None
    return frozenset(out) if len(out) <= MOST_CHARS else None


def node(kind, value) -> tuple[frozenset[str] | None, Query]:
    """The strings the node can match if they are few, and its query otherwise."""
    if kind is op.LITERAL:
        return frozenset({chr(value).lower()}), ANY
    if kind is op.IN:
        return members(value), ANY
    if kind is op.AT:
        return frozenset({""}), ANY
    if kind is op.SUBPATTERN:
        return sequence(value[-1])
    if kind is op.BRANCH:
        parts = [sequence(x) for x in value[1]]
        if all(s is not None for s, _ in parts) and len(union := frozenset().union(*(s for s, _ in parts))) <= MOST_STRINGS:
            return union, ANY
        return None, absorb(frozenset().union(*(q if s is None else of_strings(s) for s, q in parts)))
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        low, high, sub = value
        strings, query = sequence(sub)
        if strings is not None and (low, high) == (0, 1):
            return strings | {""}, ANY
        if strings is not None and low == high and len(strings) ** low <= MOST_STRINGS:
            return frozenset("".join(x) for x in product(strings, repeat=low)), ANY
        if low == 0:
            return None, ANY
        return None, query if strings is None else of_strings(strings)
    return None, ANY


def sequence(parsed) -> tuple[frozenset[str] | None, Query]:
    query, known, exact = ANY, frozenset({""}), True
    for kind, value in parsed:
        strings, inner = node(kind, value)
        if strings is not None and len(known) * len(strings) <= MOST_STRINGS:
            known = frozenset(a + b for a, b in product(known, strings))
            continue
        query, exact = both(query, of_strings(known)), False
        known = strings if strings is not None else frozenset({""})
        query = both(query, inner)
    if exact:
        return known, ANY
    return None, both(query, of_strings(known))


def trigram_query(regex: str) -> Query:
    strings, query = sequence(parser.parse(regex))
    return query if strings is None else of_strings(strings)
