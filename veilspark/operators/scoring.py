"""Confidence of candidates, as whole points out of 100, and of address blocks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.keywords import ADDRESS_CUES, ADDRESS_POINTS, ADDRESS_POSTAL, NEGATIVE, TIERS
from ..functions.text import WHITE, any_of_sql, bound, first_of, has_any, let, plain, shortest, trie
from .catalog import BARE_NUMBERS, STRONGLY_CHECKED, Pattern

#: Characters on each side of a value that are its context, and those that are next to it (before, after).
WINDOW, BESIDE = 48, (20, 12)
#: Points for and against.
SHAPE, PASSED, STRONG, MEDIUM, WEAK, NEXT_TO, TWO_CUES = 20, 40, 30, 15, 6, 10, 10
FAILED, FAILED_BUT_NAMED, AGAINST, AGAINST_CHECKED, NOTHING_BUT_DIGITS = 30, 12, 30, 10, 20
#: All words that say something of an address.
_CUES = tuple(dict.fromkeys([t for _, _, terms in ADDRESS_CUES.values() for t in terms] + list(ADDRESS_POSTAL)))
_SHORT = [t for terms in [*(terms for _, _, terms in ADDRESS_CUES.values()), ADDRESS_POSTAL] for t in shortest(terms)]
_RUN = re.compile(rf"[{WHITE}][ {WHITE}]*| [ {WHITE}]+")


def _if(condition: Column, points: int) -> Column:
    return F.when(condition, F.lit(points)).otherwise(F.lit(0))


def points(kind: str, passed: Column | None, context: Column, beside: Column, shape: bool = True, bare: bool | None = None) -> Column:
    """Points of a candidate. context: normalized text around it; passed: its checksum, None without one; beside: a word is next to it."""
    strong, medium, weak = TIERS.get(kind, ((), (), ()))
    s, m, bad = has_any(context, strong), has_any(context, medium), has_any(context, NEGATIVE)
    total = F.lit(SHAPE if shape else 0) + _if(s, STRONG) + _if(m, MEDIUM) + _if(has_any(context, weak) & ~s & ~m, WEAK) + _if(beside & (s | m), NEXT_TO) + _if(s & m, TWO_CUES)
    ok = F.lit(False) if passed is None else passed
    if passed is not None:
        total = total + F.when(passed, PASSED).when(s, -FAILED_BUT_NAMED).otherwise(-FAILED)
    mild = ok if kind in STRONGLY_CHECKED else F.lit(False)
    total = total - F.when(~bad, 0).when(mild, AGAINST_CHECKED).otherwise(AGAINST)
    if kind in BARE_NUMBERS if bare is None else bare:
        total = total - _if(~s & ~m & ~ok, NOTHING_BUT_DIGITS)
    return F.greatest(F.lit(0), F.least(F.lit(100), total))


def signals(kind: str, passed: Column | None, context: Column, beside: Column) -> Column:
    """Why a candidate has its points, in words that never hold the value."""
    strong, medium, weak = TIERS.get(kind, ((), (), ()))
    s, m, w, bad = (first_of(context, t) for t in (strong, medium, weak, NEGATIVE))
    ok = F.lit(False) if passed is None else passed
    named = lambda text, x: F.when(x.isNotNull(), F.concat(F.lit(text), x))
    mild = ok if kind in STRONGLY_CHECKED else F.lit(False)
    found = [
        F.lit(f"{kind.lower()} pattern matched"),
        F.lit(None).cast("string") if passed is None else F.when(passed, "strong validation passed").otherwise("validation failed"),
        named("strong context: ", s),
        named("medium context: ", m),
        F.when(s.isNull() & m.isNull(), named("weak context: ", w)),
        F.when(beside & (s.isNotNull() | m.isNotNull()), "spatial proximity to keyword"),
        F.when(s.isNotNull() & m.isNotNull(), "multiple corroborating cues"),
        F.when(mild, named("negative context (mild, validated): ", bad)).otherwise(named("negative context: ", bad)),
        F.when(s.isNull() & m.isNull() & ~ok, "bare numeric without corroboration") if kind in BARE_NUMBERS else F.lit(None).cast("string"),
    ]
    return F.array_compact(F.array(*found))


def confidence(pattern: Pattern, passed: Column | None, score: Column) -> Column:
    """Points as a confidence; types with a form of their own have at least their base unless a checksum fails."""
    model = score / F.lit(100.0)
    if pattern.kind in BARE_NUMBERS:
        value = model
    else:
        prior = F.greatest(model, F.lit(pattern.base))
        value = prior if passed is None else F.when(passed, prior).otherwise(model)
    return F.round(F.least(F.lit(0.99), value), 4)


def is_constant(pattern: Pattern) -> bool:
    """Whether no context can move the confidence: without a checksum the model gives at most 85 points.

    A passport's strong word holds a word against it ("port"), so its model stays below the base as well.
    """
    return pattern.value is None and pattern.check is None and pattern.kind not in BARE_NUMBERS and (pattern.base >= 0.85 or pattern.kind == "PASSPORT")


def has_pincode(block: Column) -> Column:
    """A postal code: five or six digits that belong to no longer number."""
    runs = F.regexp_extract_all(block, F.lit(r"\p{Nd}[\p{Nd} ]*\p{Nd}"), F.lit(0))
    size = lambda r: F.length(F.regexp_replace(r, " ", ""))
    long = F.exists(runs, lambda r: ((size(r) >= 7) & ~F.contains(r, F.lit(" "))) | (size(r) >= 10))
    # fixed values: the forms of a postal code; the first is a cheap expression that texts with one of the others match
    return block.rlike(r"\p{Nd}{3}") & (block.rlike(r"(?U)(?<!\d)\d{3}\s?\d{3}(?!\d)") | block.rlike(r"(?U)(?<!\d)\d{5,6}(?!\d)")) & ~long


def has_house_number(block: Column) -> Column:
    """A line that begins with a house or plot number."""
    # fixed values: the form of a house number
    return block.rlike(r"(?iU)(?<![^\n\r\x0b\f])\s*(?:flat|plot|door|house|no\.?|#)?\s*#?\d{1,4}[a-z]?\s*[,/\-]")


def _said_of_address(texts: pd.Series) -> pd.Series:
    said = lambda n: "|".join(w for w in _SHORT if w in n)
    return texts.map(lambda t: said(_RUN.sub(" ", t.lower())), na_action="ignore")


def address_words(text: Column) -> Column:
    """The words of a long text that say something of an address, joined by bars, as ``said`` of ``address_points``: many searches of the whole
    text, which are plain searches of strings here. Opaque to the optimizer, which might otherwise put it into a lambda."""
    return F.pandas_udf(_said_of_address, "string").asNondeterministic()(text)


def address_points(block: Column, many_lines: Column | None = None, words_said: Column | None = None) -> Column:
    """Points of a block of text as a postal address; fewer than two cues give 30 at most. words_said: its ``address_words``, if they are known."""

    said = ", ".join(f"{any_of_sql('n', terms)} AS {name}" for name, terms in [*((k, t) for k, (_, _, t) in ADDRESS_CUES.items()), ("postal", ADDRESS_POSTAL)])

    def total(words: Column) -> Column:
        return let(F.struct(*[words[k].alias(k) for k in (*ADDRESS_CUES, "postal")], has_pincode(block).alias("pin"), has_house_number(block).alias("house")), sum_up)

    def sum_up(flags: Column) -> Column:
        cues = sum((_if(flags[name], 1) for name in ADDRESS_CUES), _if(flags["pin"] | flags["postal"], 1))
        score = sum((_if(flags[name], p) for name, (p, _, _) in ADDRESS_CUES.items()), F.when(flags["pin"], ADDRESS_POINTS["pincode"]).when(flags["postal"], ADDRESS_POINTS["postal"]).otherwise(0))
        score = score + _if(flags["house"], ADDRESS_POINTS["house"])
        if many_lines is not None:
            score = score + _if(many_lines, ADDRESS_POINTS["lines"])
        return F.least(F.lit(100), F.when(cues >= 2, score).otherwise(F.least(score, F.lit(30))))

    return let(bound(plain(block) if words_said is None else words_said, "n", f"struct({said})"), total)


def address_cue(line: Column) -> Column:
    """Whether a line says anything of an address."""
    return F.lower(line).rlike(trie(_CUES)) | has_pincode(line) | has_house_number(line)
