"""How much work a user's pattern can take in a backtracking engine, as a bound that a text can be held against before it is run.

A search starts at every character, and each repeat that can end at several places multiplies the ways in which a run of characters can be
divided. So a run of n characters costs about n ** degree, where degree is 1 more than the number of repeats that compete for the
same run. Repeats compete if some character fits them all and all that must stand between them. Choices of few ways are counted
apart: many of them in a row double the work each, so such patterns are refused.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions.text import quoted

#: The work that a text may ask for: that of a pattern with one repeat over a run of 20,000 characters.
BUDGET = 20_000**2
#: Runs are short if they cannot use up the work of a text of this length.
SHORT_TEXT = 80_000
#: From so many ways on a repeat counts as one; of choices with fewer ways so many may compete, and so often are repeated groups looked into.
WIDE, NARROW, UNROLLED = 10, 10, 40

_COUNT = re.compile(r"([*+?]|\{(\d*)(,?)(\d*)\})[+?]?")
_PIECE = re.compile(r"\(\?P=\w+\)|\((?:\?(?:P<\w+>|[:=!>]|<[=!]|[a-zA-Z-]+[:)]))?|\\.|\[\^?\]?|[|)^$]|.", re.S)
_ENDLESS = 1 << 30


class _Item(NamedTuple):
    """kind: "atom" (body: the source of one character), "look" or "group" (body: branches), "same" (a group again), "empty"."""

    kind: str
    body: str | list
    low: int
    high: int


class Effort(NamedTuple):
    """narrow: how many choices of few ways compete at most. runs: for each set of competing repeats its degree and what it matches, a character class of Java's."""

    narrow: int
    runs: tuple[tuple[int, str], ...]


def _tree(source: str) -> list[list[_Item]]:
    at = 0

    def branches() -> list[list[_Item]]:
        nonlocal at
        out: list[list[_Item]] = [[]]
        while at < len(source):
            m = _PIECE.match(source, at)
            piece, at = m[0], m.end()
            kind, body = "atom", piece
            if piece == ")":
                return out
            if piece == "|":
                out.append([])
                continue
            if piece.startswith("(?P="):
                kind = "same"
            elif piece.startswith("("):
                kind = "empty" if piece.endswith(")") else "look" if piece[-1] in "=!" else "group"
                body = branches() if kind != "empty" else piece
            elif piece[0] == "[":
                while at < len(source) and source[at] != "]":
                    at += 2 if source[at] == "\\" else 1
                at += 1
                body = source[m.start() : at]
            elif piece in ("^", "$") or re.fullmatch(r"\\[bBAZz]", piece):
                kind = "empty"
            elif re.fullmatch(r"\\[1-9]", piece):
                kind = "same"
            low, high = 1, 1
            if again := _COUNT.match(source, at):
                at = again.end()
                low, high = {"*": (0, _ENDLESS), "+": (1, _ENDLESS), "?": (0, 1)}.get(again[1], (int(again[2] or 0), int(again[4] or (_ENDLESS if again[3] else again[2] or 0))))
            out[-1].append(_Item(kind, body, low, high))
        return out

    return branches()


@lru_cache(maxsize=4096)
def _fits(atom: str, char: str) -> bool:
    try:
        return re.fullmatch(atom, char, re.I | re.S) is not None
    except re.error:
        return True


def _atoms(items: list[_Item]) -> list[str]:
    return [a for x in items for a in ([x.body] if x.kind == "atom" else [a for b in x.body for a in _atoms(b)] if x.kind in ("group", "look") else [])]


class _Open(NamedTuple):
    """What competes for a run of one character at some place: repeats, narrow choices, and the atoms that the repeats match."""

    wide: int
    narrow: int
    atoms: frozenset[str]


_NOTHING = _Open(0, 0, frozenset())


def _either(found: list[_Open]) -> _Open:
    return _Open(max(x.wide for x in found), max(x.narrow for x in found), frozenset().union(*(x.atoms for x in found)))


def _starts(branch: list[_Item], char: str) -> bool:
    """Whether a branch could begin with a character, or with none."""
    first = next((x for x in branch if x.kind != "empty"), None)
    return first is None or first.kind != "atom" or first.low == 0 or _fits(first.body, char)


def _walk(items: list[_Item], char: str, at: _Open, seen: list[_Open]) -> _Open:
    """What competes for a run of ``char`` at the end of the items, where ``at`` does before them; all that does anywhere is added to ``seen``."""
    for kind, body, low, high in items:
        if kind == "empty":
            continue
        if kind == "look":
            for b in body:
                _walk(b, char, _NOTHING, seen)
            continue
        wide, narrow = high - low >= WIDE, 0 < high - low < WIDE
        if kind == "group" and high < _ENDLESS:
            forks = sum(_starts(b, char) for b in body) > 1
            for _ in range(min(max(high, 1), UNROLLED)):
                end = _either([_walk(b, char, at, seen) for b in body] + [at] * (low == 0))
                kept = end.wide + end.narrow >= at.wide + at.narrow
                at = _Open(end.wide + (wide and kept), end.narrow + (kept and narrow + forks), end.atoms.union(_atoms([_Item(kind, body, low, high)]) if wide else ()))
                seen.append(at)
            continue
        inner = [body] if kind == "atom" else ["."] if kind == "same" else _atoms([_Item(kind, body, low, high)])
        if kind == "same" or any(_fits(a, char) for a in inner):
            at = _Open(at.wide + wide, at.narrow + narrow, at.atoms.union(inner if wide else ()))
            seen.append(at)
        elif low > 0:
            at = _NOTHING
    return at


def _class_of(atom: str) -> str:
    """An atom as a part of a class of Java's."""
    if atom == ".":
        return r"[^\n]"
    if atom[0] == "[":
        return atom[:1] + re.sub(r"(?<!\\)(\[|&)", r"\\\1", atom[1:])
    return atom if atom[0] == "\\" or atom.isalnum() else "\\" + atom if atom.isascii() else atom


@lru_cache(maxsize=1024)
def effort_of(source: str) -> Effort:
    """The effort of a pattern in the users' dialect. What a last repeat takes is not given back, so it divides nothing."""
    seen = [_NOTHING]
    probes = sorted({chr(c) for c in range(32, 127)} | set(source) | set("\n\té漢"))
    for items in _tree(source):
        last = items[-1] if items else None
        fixed = [*items[:-1], last._replace(high=last.low)] if last and last.kind == "atom" else items
        for c in probes:
            _walk(fixed, c, _NOTHING, seen)
    met: dict[frozenset[str], int] = {}
    for x in seen:
        if x.wide:
            met[x.atoms] = max(met.get(x.atoms, 0), x.wide)
    kept = [(1 + n, "".join(sorted({_class_of(a) for a in atoms}))) for atoms, n in met.items() if not any(atoms < other and n <= m for other, m in met.items())]
    return Effort(max(x.narrow for x in seen), tuple(sorted((d, f"[{runs}]") for d, runs in kept)))


def affordable(text: Column, effort: Effort, budget: float = BUDGET) -> Column:
    """Whether a pattern of this effort can be run over the whole of a text; found in one pass for each of its runs, whatever the text.

    Runs of at most so many characters cannot ask for more than the text's length times a constant, so where that is within the budget
    only longer ones are looked for, and all of them are counted elsewhere.
    """
    if not effort.runs:
        return F.lit(True)

    def work(least: int, degree: int, runs: str) -> Column:
        found = F.regexp_extract_all(text, F.expr(quoted(f"(?iU){runs}{{{least},}}+")), F.lit(0))
        return F.aggregate(found, F.lit(0.0), lambda a, x: a + F.pow(F.length(x).cast("double"), F.lit(float(degree))))

    most, exact = F.lit(0.0), F.lit(0.0)
    for degree, runs in effort.runs:
        short = max(1, int((BUDGET / SHORT_TEXT) ** (1 / (degree - 1))))
        most = most + work(short + 1, degree, runs) + F.length(text) * F.lit(float(short ** (degree - 1)))
        exact = exact + work(1, degree, runs)
    return F.coalesce(F.when(most <= float(budget), True).otherwise(exact <= float(budget)), F.lit(True))
