"""Texts that every match of a pattern must hold, so that a long list of patterns can be looked up instead of tried."""

from __future__ import annotations

import re

_UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_COUNT = re.compile(r"\{(\d+)(?:,\d*)?\}")
_NAMED = re.compile(r"\(\?<[A-Za-z]\w*>")
_FLAGS = re.compile(r"\(\?[ims-]+([:)])")


class _Unclear(Exception):
    """The pattern holds something that is not read here."""


def required_literals(pattern: str) -> frozenset[str] | None:
    """Texts, with A-Z in small letters, of which every match of the pattern holds at least one (compared without regard to the
    case of A-Z). None where no such texts are found: for patterns that may match without them and for those not read here.

    Plain characters that follow each other are a text. Alternatives give one text each. What may be left out, classes, dots
    and looks ahead or behind give nothing.
    """
    try:
        found, end = _branches(pattern, 0)
    except (_Unclear, IndexError, RecursionError):
        return None
    return frozenset(found) if found and end == len(pattern) else None


def _branches(p: str, i: int) -> tuple[set[str] | None, int]:
    sets = []
    while True:
        found, i = _sequence(p, i)
        sets.append(found)
        if i >= len(p) or p[i] != "|":
            break
        i += 1
    return (None if None in sets else set().union(*sets)), i


def _sequence(p: str, i: int) -> tuple[set[str] | None, int]:
    offers: list[set[str]] = []
    run = ""
    while i < len(p) and p[i] not in "|)":
        char, inner, i = _atom(p, i)
        least, i = _times(p, i)
        if char and least is None:
            run += char
            continue
        if char and least:
            run += char
        if run:
            offers.append({run})
        run = ""
        if inner and least != 0:
            offers.append(inner)
    if run:
        offers.append({run})
    return max(offers, key=lambda s: (min(map(len, s)), -len(s)), default=None), i


def _times(p: str, i: int) -> tuple[int | None, int]:
    """How often the atom before ``i`` stands at least (None: no count is given) and where the count ends."""
    if i >= len(p) or p[i] not in "?*+{":
        return None, i
    if p[i] == "{":
        found = _COUNT.match(p, i)
        if not found:
            raise _Unclear
        least, i = int(found[1]), found.end()
    else:
        least, i = (1 if p[i] == "+" else 0), i + 1
    return least, i + (i < len(p) and p[i] in "?+")


def _atom(p: str, i: int) -> tuple[str, set[str] | None, int]:
    """A plain character, or the texts of a group, and the end of what stands at ``i``."""
    c = p[i]
    if c in ".^$":
        return "", None, i + 1
    if c == "\\":
        n = p[i + 1]
        if not n.isalnum():
            return n, None, i + 2
        if n in "dDwWsSbBAzZGhHvVRtnrfae":
            return "", None, i + 2
        raise _Unclear
    if c == "[":
        return "", None, _class_end(p, i)
    if c == "(":
        return _group(p, i)
    if c in "*+?{":
        raise _Unclear
    return c.translate(_UPPER), None, i + 1


def _class_end(p: str, i: int) -> int:
    j = i + 1 + (p[i + 1] == "^")
    if p[j] in "]&":
        raise _Unclear
    depth = 1
    while depth:
        if p[j] == "\\":
            if p[j + 1] == "Q":
                raise _Unclear
            j += 1
        else:
            depth += {"[": 1, "]": -1}.get(p[j], 0)
        j += 1
    return j


def _group(p: str, i: int) -> tuple[str, set[str] | None, int]:
    start, counts = i + 1, True
    if p[start] == "?":
        flags, named = _FLAGS.match(p, i), _NAMED.match(p, i)
        if flags and flags[1] == ")":
            return "", None, flags.end()
        if flags or named:
            start = (flags or named).end()
        elif p[i + 2] in ":>":
            start = i + 3
        elif p[i + 2] in "=!":
            start, counts = i + 3, False
        elif p[i + 2] == "<" and p[i + 3] in "=!":
            start, counts = i + 4, False
        else:
            raise _Unclear
    found, end = _branches(p, start)
    if end >= len(p):
        raise _Unclear
    return "", (found if counts else None), end + 1
