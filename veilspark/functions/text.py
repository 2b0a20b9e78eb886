"""Column helpers for text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space but for the space itself, as a part of a class: all characters of that property.
WHITE = r"\t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPAN = "struct<start:int,end:int,value:string>"
#: A character that no text should hold.
MARK = "\uffff"
#: Elements of an array over which a running value is carried at once.
BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body`` as often as needed."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def quoted(text: str) -> str:
    """A string as a literal of Spark's SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bound(value: Column, name: str, body: str) -> Column:
    """``body``, an SQL expression, with ``value`` evaluated once under ``name``. Large expressions are analysed much faster as one SQL text."""
    return F.get(F.call_function("transform", F.array(value), F.expr(f"{name} -> {body}")), F.lit(0))


def bound_sql(value: str, name: str, body: str) -> str:
    """``bound`` as SQL."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def running_sql(items: str, zero: str, step: str) -> str:
    """For each item the whole number that ``step``, SQL over (a, x), has made of ``zero`` by the items before it.

    Arrays are copied as they grow, so long ones are taken in blocks: the work is that of n * sqrt(n) at most, not of n * n.
    """
    scan = lambda items, zero: f"aggregate({items}, named_struct('at', {zero}, 'out', CAST(array() AS array<int>)), (s, x) -> named_struct('at', {step.format(a='s.at')}, 'out', concat(s.out, array(s.at))), s -> s.out)"
    heads = f"aggregate(bs, named_struct('at', {zero}, 'out', CAST(array() AS array<int>)), (s, b) -> named_struct('at', aggregate(b, s.at, (c, x) -> {step.format(a='c')}), 'out', concat(s.out, array(s.at))), s -> s.out)"
    blocks = f"transform(sequence(0, (size(items) - 1) div {BLOCK}), i -> slice(items, i * {BLOCK} + 1, {BLOCK}))"
    long = bound_sql(blocks, "bs", f"flatten(zip_with(bs, {heads}, (b, z) -> {scan('b', 'z')}))")
    return bound_sql(items, "items", f"CASE WHEN size(items) <= {BLOCK} THEN {scan('items', zero)} ELSE {long} END")


def plain(text: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed. Only runs that are not one space already are replaced."""
    return F.trim(F.regexp_replace(F.lower(text), rf"[{WHITE}][ {WHITE}]*+| [ {WHITE}]++", " "))


def trie(terms: Iterable[str]) -> str:
    """An expression for the longest of the terms that begins at a place of a text in lower case, as if its runs of white space were one space."""
    root: dict = {}
    for term in terms:
        node = root
        for c in term:
            node = node.setdefault(c, {})
        node[""] = {}

    def source(node: dict) -> str:
        parts = [(rf"[ {WHITE}]++" if c == " " else re.escape(c)) + source(below) for c, below in sorted(node.items()) if c]
        ends = [""] if "" in node else []
        return "".join(parts) if len(parts) + len(ends) < 2 else f"(?:{'|'.join(parts + ends)})"

    return source(root)


def shortest(terms: Iterable[str]) -> list[str]:
    """Terms without those that contain another: where they are found, that one is too."""
    every = list(dict.fromkeys(terms))
    return [t for t in every if not any(u != t and u in t for u in every)]


def has_any(text: Column, terms: Iterable[str]) -> Column:
    """Whether any term occurs anywhere in the text: one expression, as plans with one per term are slow to analyse."""
    short = shortest(terms)
    return text.rlike("|".join(map(re.escape, short))) if short else F.lit(False)


def any_of_sql(text: str, terms: Iterable[str]) -> str:
    """``has_any`` for long texts, as SQL: plain searches, of which the first hit ends the rest."""
    return "(" + " OR ".join(f"contains({text}, {quoted(t)})" for t in shortest(terms)) + ")"


def first_of(text: Column, terms: Iterable[str]) -> Column:
    """The first of the listed terms that occurs, or null."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(t)), F.lit(t)) for t in terms], F.lit(None).cast("string"))


def between(text: Column, start: Column, end: Column) -> Column:
    """The code points from start to end, exclusive; offsets from 0 and clipped to the text."""
    low = F.greatest(start, F.lit(0))
    return F.substring(text, low + 1, F.greatest(F.least(end, F.length(text)) - low, F.lit(0)))


def spans_sql(text: str, regex: str, group: int = 0) -> str:
    """``spans`` as SQL over the name of a text."""
    r = quoted(regex)
    named = "w" if group == 0 else "n"
    pair = "(w, g) -> named_struct('w', w, 'n', w, 'g', length(g))"
    whole = f"zip_with(regexp_extract_all({text}, {r}, 0), split({text}, {r}, -1), {pair})"
    if not group:  # one search: matches are put between marks, at which the text is then cut, unless it holds such a mark
        marked = bound_sql(f"split(regexp_replace({text}, {r}, '{MARK}$0{MARK}'), '{MARK}', -1)", "cut", f"zip_with(filter(cut, (c, i) -> i % 2 = 1), filter(cut, (c, i) -> i % 2 = 0), {pair})")
        whole = f"CASE WHEN contains({text}, '{MARK}') THEN {whole} ELSE {marked} END"
    else:
        whole = f"zip_with({whole}, regexp_extract_all({text}, {r}, {group}), (x, n) -> named_struct('w', x.w, 'n', {named}, 'g', x.g))"
    ends = "(x, at) -> named_struct('start', at + x.g + length(x.w) - length(x.n), 'end', at + x.g + length(x.w), 'value', x.n)"
    placed = f"zip_with(parts, {running_sql('parts', '0', '{a} + x.g + length(x.w)')}, {ends})"
    return bound_sql(f"filter({whole}, x -> x.w IS NOT NULL)", "parts", placed)


def spans(text: Column, regex: str, group: int = 0) -> Column:
    """All matches as ``SPAN``, in order. Splitting yields the gaps between matches, so lengths add up to offsets.

    With a group, the span is the group's, which must end where the match ends.
    """
    return bound(text, "t", spans_sql("t", regex, group))
