"""Detection in a text, inside its row: candidates of all patterns, scores, overlap resolution. No shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ScanConfig
from ..effort import affordable
from ..functions import validators
from ..functions.text import between, bound, bound_sql, has_any, let, plain, quoted, running_sql, spans, spans_sql
from . import scoring
from .catalog import FAMILIES, PATTERNS, SEVERITY, Pattern

#: A detection. ord and start break ties; passed is the checksum's result, null without one.
MATCH = "struct<neg:double,shorter:int,ord:int,start:int,end:int,type:string,severity:string,value:string,confidence:double,passed:boolean,signals:array<string>>"
_NONE = f"array<{MATCH}>"
#: A label's value stands within so many characters after it and has at least this confidence.
LABEL_REACH, LABELLED = 24, 0.6


def _match(ord_: int, kind: str, start: Column, end: Column, value: Column, confidence: Column, passed: Column | None, signals: Column | None) -> Column:
    return F.struct(
        (-confidence).alias("neg"), (start - end).alias("shorter"), F.lit(ord_).alias("ord"), start.alias("start"), end.alias("end"), F.lit(kind).alias("type"), F.lit(SEVERITY[kind]).alias("severity"),
        value.alias("value"), confidence.alias("confidence"), (F.lit(None).cast("boolean") if passed is None else passed).alias("passed"), (F.array().cast("array<string>") if signals is None else signals).alias("signals"),
    ).cast(MATCH)


def _regex(source: str) -> str:
    return f"(?U){source}"


def _check(pattern: Pattern, cfg: ScanConfig) -> Callable[[Column], Column] | None:
    return {None: None, "luhn": validators.luhn, "ipv4": validators.ipv4, "verhoeff": lambda v: validators.verhoeff(v, cfg.verhoeff_table)}[pattern.check]


def _constant(ord_: int, pattern: Pattern) -> str:
    """All matches of a pattern whose confidence no context can move, as SQL over the text t."""
    match = f"""named_struct('neg', -{pattern.base}D, 'shorter', x.start - x.end, 'ord', {ord_}, 'start', x.start, 'end', x.end, 'type', {quoted(pattern.kind)}, 'severity', {quoted(pattern.severity)},
        'value', x.value, 'confidence', {pattern.base}D, 'passed', CAST(NULL AS boolean), 'signals', CAST(array() AS array<string>))"""
    found = f"CAST(transform({spans_sql('t', _regex(pattern.regex), pattern.group)}, x -> {match}) AS {_NONE})"
    return found if pattern.gate is None else f"CASE WHEN t RLIKE {quoted(pattern.gate)} THEN {found} ELSE CAST(array() AS {_NONE}) END"


def _of_pattern(text: Column, ord_: int, pattern: Pattern, cfg: ScanConfig, explain: bool) -> Column:
    found, check = spans(text, _regex(pattern.regex), pattern.group), _check(pattern, cfg)
    if pattern.must_pass:
        found = F.filter(found, lambda x: check(x["value"]))
    before, after = scoring.BESIDE

    def look(x: Column) -> Column:
        around = plain(between(text, x["start"] - scoring.WINDOW, x["end"] + scoring.WINDOW))
        beside = plain(between(text, x["start"] - before, x["end"] + after))
        passed = F.lit(None).cast("boolean") if check is None else F.lit(True) if pattern.must_pass else check(x["value"])
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), around.alias("around"), has_any(beside, pattern.near).alias("beside"), passed.alias("passed"))

    def rate(x: Column) -> Column:
        passed = None if check is None else x["passed"]
        said = scoring.signals(pattern.kind, passed, x["around"], x["beside"]) if explain else None
        sure = scoring.confidence(pattern, passed, scoring.points(pattern.kind, passed, x["around"], x["beside"]))
        return _match(ord_, pattern.kind, x["start"], x["end"], x["value"], sure, passed, said)

    return F.transform(F.transform(found, look), rate)


def _of_label(text: Column, ord_: int, pattern: Pattern, explain: bool) -> Column:
    """Values right after a label. Any context word counts as support, also one that speaks against the type."""
    value = _regex(pattern.value)

    def look(x: Column) -> Column:
        reach = between(text, x["end"], x["end"] + LABEL_REACH)
        return F.struct(x["start"].alias("label"), x["end"].alias("after"), F.regexp_instr(reach, F.lit(value)).alias("at"), F.regexp_extract(reach, value, 0).alias("value"))

    def surround(x: Column) -> Column:
        start = x["after"] + x["at"] - 1
        end = start + F.length(x["value"])
        return F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"), plain(between(text, x["label"] - scoring.WINDOW, end + scoring.WINDOW)).alias("around"))

    strong, medium, weak = scoring.TIERS[pattern.kind]
    valued = F.filter(F.transform(spans(text, _regex(pattern.regex)), look), lambda x: x["at"] > 0)
    near = F.filter(F.transform(valued, surround), lambda x: has_any(x["around"], (*strong, *medium, *weak, *scoring.NEGATIVE)))

    def rate(x: Column) -> Column:
        beside = F.lit(True)
        score = scoring.points(pattern.kind, None, x["around"], beside)
        sure = F.round(F.least(F.lit(0.99), F.greatest(score / F.lit(100.0), F.lit(LABELLED))), 4)
        return _match(ord_, pattern.kind, x["start"], x["end"], x["value"], sure, None, scoring.signals(pattern.kind, None, x["around"], beside) if explain else None)

    return F.transform(near, rate)


def address_match(block: Column, many_lines: Column | None = None, threshold: int = 45, words: Column | None = None) -> Column:
    """The block as one ADDRESS detection, or null. words: as in ``scoring.address_points``."""
    size = F.length(block)

    def rate(score: Column) -> Column:
        return F.when(score >= threshold, _match(len(PATTERNS), "ADDRESS", F.lit(0), size, F.regexp_replace(block, r"(?U)^\s+|\s+$", ""), F.least(F.lit(0.99), F.round(score / F.lit(100.0), 4)), None, None))

    return let(scoring.address_points(block, many_lines, words), rate)


def _custom(ord_: int, confidence: float, said: Column) -> Callable[[Column], Column]:
    return lambda x: _match(ord_, "CUSTOM_PATTERN", x["start"], x["end"], x["value"], F.lit(confidence), None, said)


def fits(text: Column, cfg: ScanConfig) -> Column:
    """For each pattern of the user's whether it can be run over a text, or its effort there is beyond the budget."""
    read = text if cfg.custom_text is None else F.left(text, F.lit(cfg.custom_text))
    return F.array(*[affordable(read, c.effort) for c in cfg.custom]) if cfg.custom and cfg.wants("CUSTOM_PATTERN") else F.array().cast("array<boolean>")


def unfinished(fit: Column) -> Column:
    """Whether some pattern of the user's was not run over a text, by its ``fits``."""
    return F.coalesce(F.exists(fit, lambda ok: ~ok), F.lit(False))


def _gated(text: Column, parts: list[tuple[str | None, Column]]) -> Column:
    """Candidates of patterns, each behind its gate, and those of families behind the gate of the family as well."""
    empty = F.array().cast(_NONE)
    every = [found if gate is None else F.when(text.rlike(gate), found).otherwise(empty) for gate, found in parts]
    return F.concat(*every)


def candidates(text: Column, cfg: ScanConfig, explain: bool = False, words: Column | None = None, fit: Column | None = None) -> Column:
    """All candidates of the enabled types, unresolved."""
    parts, constant, wanted = [], [], [(i, p) for i, p in enumerate(PATTERNS) if cfg.wants(p.kind)]
    for gate, family in [*FAMILIES, (None, None)]:
        kin = [(i, p) for i, p in wanted if (p.kind in family if family else not any(p.kind in f for _, f in FAMILIES))]
        said = [_constant(i, p) for i, p in kin if scoring.is_constant(p) and not explain]
        looked = [(p.gate, _of_pattern(text, i, p, cfg, explain) if p.value is None else _of_label(text, i, p, explain)) for i, p in kin if not scoring.is_constant(p) or explain]
        if said:
            constant.append(f"concat({', '.join(said)})" if gate is None else f"CASE WHEN t RLIKE {quoted(gate)} THEN concat({', '.join(said)}) ELSE CAST(array() AS {_NONE}) END")
        if looked:
            parts.append(_gated(text, looked) if gate is None else _gated(text, [(gate, _gated(text, looked))]))
    if cfg.wants("ADDRESS"):
        parts.append(F.array_compact(F.array(address_match(text, words=words))))
    if cfg.wants("CUSTOM_PATTERN"):
        read = text if cfg.custom_text is None else F.left(text, F.lit(cfg.custom_text))
        for i, c in enumerate(cfg.custom):
            ok = F.lit(True) if not c.effort.runs else affordable(read, c.effort) if fit is None else F.get(fit, F.lit(i))
            seen = F.filter(spans(F.when(ok, read).otherwise(""), _regex(c.regex)), lambda x: F.length(x["value"]) > 0)
            said = F.array(F.lit(f"custom pattern: {c.name}"), F.lit("user-defined pattern matched"))
            parts.append(F.transform(seen, _custom(len(PATTERNS) + 1 + i, round(min(0.99, c.confidence), 4), said)))
    if constant:
        parts.append(bound(text, "t", f"concat({', '.join(constant)})"))
    return F.concat(*parts) if parts else F.array().cast(_NONE)


def resolve(found: Column) -> Column:
    """Keep the surest of overlapping detections, then the longest, then the first in the catalog; result by start.

    An address only competes with other addresses. Detections are cut into runs that touch no other, so that each competes
    with the few of its own run.
    """
    by = lambda items, key: f"transform(sort_array(transform({items}, (x, i) -> named_struct('k', {key}, 'i', i, 'm', x))), x -> x.m)"
    clash = "exists(out, k -> k.start < x.end AND x.start < k.end)"
    best = lambda items: f"aggregate(sort_array({items}), CAST(array() AS {_NONE}), (out, x) -> CASE WHEN {clash} THEN out ELSE concat(out, array(x)) END)"
    reach = running_sql("own", "0", "greatest({a}, x.end)")
    fresh = f"filter(transform(zip_with(own, {reach}, (x, r) -> x.start >= r), (new, i) -> CASE WHEN new THEN i END), i -> i IS NOT NULL)"
    runs = f"transform(heads, (h, i) -> slice(own, h + 1, coalesce(get(heads, i + 1), size(own)) - h))"
    resolved = bound_sql(by("items", "x.start"), "own", bound_sql(fresh, "heads", f"flatten(transform({runs}, run -> CASE WHEN size(run) = 1 THEN run ELSE {best('run')} END))"))
    both = f"concat({bound_sql("filter(f, x -> x.type <> 'ADDRESS')", 'items', resolved)}, {best("filter(f, x -> x.type = 'ADDRESS')")})"
    return bound(found, "f", f"CASE WHEN size(f) < 2 THEN f ELSE {by(both, 'x.start')} END")


def detect(text: Column, cfg: ScanConfig, explain: bool = False, kept_only: bool = True, words: Column | None = None, fit: Column | None = None) -> Column:
    """Detections in a text. words: as in ``scoring.address_points``; fit: the text's ``fits``; both are found here if they are not given. With ``kept_only`` candidates below the threshold go first: they could never displace any other."""
    found = candidates(text, cfg, explain, words, fit)
    if kept_only:
        found = F.filter(found, lambda x: F.round(x["confidence"] * 100, 6) >= cfg.redact_from)
    return resolve(found)
