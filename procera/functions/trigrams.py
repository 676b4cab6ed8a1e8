"""What three-character pieces a text must hold for a pattern to match it.

Only literal stretches of the pattern count; anything else ends a stretch and asks for nothing.
Pieces are of code points. The parse is Python's; where a term is valid in both Python's and
Java's notation, their literals are the same.
"""

from __future__ import annotations

import re
from re import _constants as op
from re import _parser

#: Alternatives kept apart; a pattern with more asks for less, never for more.
MOST = 32

Need = frozenset[frozenset[str]]
#: One alternative that asks for nothing.
NOTHING: Need = frozenset([frozenset()])


def pieces(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _both(a: Need, b: Need) -> Need:
    joined = frozenset(x | y for x in a for y in b)
    return joined if len(joined) <= MOST else a if len(a) <= MOST else NOTHING


def _needs(parsed) -> Need:
    found, run = NOTHING, ""

    def flush() -> None:
        nonlocal found, run
        found, run = _both(found, frozenset([pieces(run)])), ""

    for kind, value in parsed:
        if kind is op.LITERAL:
            run += chr(value)
        elif kind is op.AT:
            continue  # of no width: what stands on both sides still adjoins
        else:
            flush()
            if kind is op.SUBPATTERN:
                found = _both(found, _needs(value[-1]))
            elif kind is op.ATOMIC_GROUP:
                found = _both(found, _needs(value))
            elif kind is op.BRANCH:
                options = frozenset(x for branch in value[1] for x in _needs(branch))
                found = _both(found, options if len(options) <= MOST else NOTHING)
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and value[0] > 0:
                found = _both(found, _needs(value[2]))
    flush()
    return found


def required(pattern: str, literal: bool = False) -> list[frozenset[str]] | None:
    """Alternatives: a text that matches holds all pieces of one of them. None where some alternative asks for no piece."""
    if literal:
        needs: Need = frozenset([pieces(pattern)])
    else:
        parsed = _parser.parse(pattern)
        if parsed.state.flags & ~re.UNICODE:
            return None
        needs = _needs(parsed)
    if frozenset() in needs:
        return None
    return sorted((x for x in needs if not any(y < x for y in needs)), key=sorted)
