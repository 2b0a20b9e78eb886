"""Positioned tokens and lines as rows: what ``spatial`` does inside the row of a page, set by set for texts of any length.

tokens: keys, line, place, text, start, end (offsets in the whole text), x, y, w, h. lines: keys, line, text, x, y, w, h, where line counts
the lines with tokens. Joins are dealt by key and a part of the text or the page, so a long document is many small groups; arrays
hold the few lines of one frame, and what one line's label or one document's detections are, never a document's tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ScanConfig
from ..functions.geometry import box, overlap_area, pad_box
from ..functions.masks import mask_value
from ..functions.text import bound_sql, running_sql
from .catalog import PATTERNS
from .detect import detect
from .scoring import address_cue
from .spatial import ADDRESS_LINES, LABEL_GAP, LOCATED, NUMBER_GAP, best_block, dedupe, numbers

#: Characters of a text, heights and cells of a page by which joins are dealt, in the units of the offsets and boxes.
CHARACTERS, BAND, CELL = 256, 96.0, 64.0
#: A box that touches more cells than this meets the others of its page without cells.
CELLS = 256
#: A number has at most 19 digits in groups of three or more, so from the line where it starts it reaches over no more lines than this.
NUMBER_LINES = 8
#: Lines of digit groups only.
DIGIT_LINE = r"(?U)^\d{3,8}(?: \d{3,8})*$"
#: The same as a line of a text.
HAS_DIGIT_LINE = r"(?m)^ *\p{Nd}{3,8}(?: +\p{Nd}{3,8})* *$"
#: Types without a label of their own whose values can go over the end of a line.
OVER_LINES = ("PASSWORD",)
_BOX = ("x", "y", "w", "h")


def _box(of: str = "") -> Column:
    return box(*(F.col(f"{of}{n}") for n in _BOX))


def _printed_lines(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, line, _row (its number with empty lines), _at (its offset), said (as it stands) of each line with a token."""
    starts = running_sql("items", "0", "{a} + length(x) + 1")
    rows = f"filter(transform(zip_with(ls, {starts.replace('items', 'ls', 1)}, (l, s) -> named_struct('at', s, 'said', l)), (z, i) -> named_struct('row', i, 'at', z.at, 'said', z.said)), z -> z.said RLIKE '[^ ]')"
    split = bound_sql(f"split(coalesce({text}, ''), '\n', -1)", "ls", rows)
    found = df.select(*keys, F.posexplode(F.expr(split)).alias("line", "l"))
    return found.select(*keys, "line", F.col("l.row").alias("_row"), F.col("l.at").alias("_at"), "l.said")


def tokens_of_text(df: DataFrame, keys: list[str], text: str = "text", advance: float = 10.0, line_height: float = 24.0, height: float = 20.0) -> DataFrame:
    """The tokens of a text as if it were printed in a fixed pitch, one line per line of text. No shuffle; a null text has none."""
    starts = running_sql("items", "0", "{a} + length(x) + 1")
    words = bound_sql("split(said, ' ', -1)", "ws", f"filter(zip_with(ws, {starts.replace('items', 'ws', 1)}, (w, s) -> named_struct('text', w, 'at', s)), z -> z.text <> '')")
    found = _printed_lines(df, keys, text).select(*keys, "line", "_row", "_at", F.posexplode(F.expr(words)).alias("place", "t"))
    start = F.col("_at") + F.col("t.at")
    size = F.length("t.text")
    return found.select(
        *keys, "line", "place", F.col("t.text").alias("text"), start.alias("start"), (start + size).alias("end"),
        (F.col("t.at") * F.lit(advance)).alias("x"), (F.col("_row") * F.lit(line_height)).alias("y"), (size * F.lit(advance)).alias("w"), F.lit(height).alias("h"),
    )


def lines_of_text(df: DataFrame, keys: list[str], text: str = "text", advance: float = 10.0, line_height: float = 24.0, height: float = 20.0) -> DataFrame:
    """The lines of ``tokens_of_text`` with their text, words joined by one space, the box around them, and ``said``, the line as it stands. No shuffle."""
    found = _printed_lines(df, keys, text)
    bare = F.rtrim("said")
    left = F.length("said") - F.length(F.ltrim("said"))
    return found.select(
        *keys, "line", F.regexp_replace(F.trim("said"), " +", " ").alias("text"),
        (left * F.lit(advance)).alias("x"), (F.col("_row") * F.lit(line_height)).alias("y"), ((F.length(bare) - left) * F.lit(advance)).alias("w"), F.lit(height).alias("h"), "said",
    )


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], bucket: int = CHARACTERS) -> DataFrame:
    """Pairs of rows with the same keys whose intervals [start, end) overlap: the columns of ``left``, and ``other``, those of ``right`` but the keys.

    Both sides are dealt to the stretches of ``bucket`` units that they touch, and a pair is made where the later one starts, so it
    comes once and a key with many rows is spread. Null keys and empty intervals meet nothing; repeated rows make repeated pairs.
    """
    touched = F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("end") - 1) / bucket)))
    part = lambda df: df.where(F.col("end") > F.col("start")).withColumn("_bucket", touched)
    other = F.struct(*[F.col(f"`{c}`") for c in right.columns if c not in keys]).alias("other")
    r = part(right).select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"), other)
    same = F.col("_bucket") == F.col("_b")
    for i, k in enumerate(keys):
        same = same & (F.col(k) == F.col(f"_r{i}"))
    overlap = (F.col("start") < F.col("other.end")) & (F.col("other.start") < F.col("end"))
    first = F.floor(F.greatest(F.col("start"), F.col("other.start")) / bucket) == F.col("_bucket")
    return part(left).join(r, same & overlap & first).select(*[F.col(f"`{c}`") for c in left.columns], "other")


def boxes_of_spans(spans: DataFrame, tokens: DataFrame, keys: list[str], ratio: float = 0.12) -> DataFrame:
    """The spans, start and end in the text, with the box around all tokens that each touches, padded; spans that touch none go. Repeated spans are one."""
    own = spans.columns
    t = F.col("other")
    edges = [F.min(t["x"]).alias("x"), F.min(t["y"]).alias("y"), F.max(t["x"] + t["w"]).alias("_right"), F.max(t["y"] + t["h"]).alias("_below")]
    found = interval_join(spans, tokens.select(*keys, "start", "end", *_BOX), keys).groupBy(*own).agg(*edges)
    around = box(F.col("x"), F.col("y"), F.col("_right") - F.col("x"), F.col("_below") - F.col("y"))
    return found.select(*own, pad_box(around, ratio).alias("box"))


def span_boxes(df: DataFrame, keys: list[str], cfg: ScanConfig | None = None, text: str = "text") -> DataFrame:
    """Detections of whole texts, addresses aside, with their boxes among the tokens of the text: keys, type, start, end, value, confidence, box.

    Only texts with a detection are cut into tokens.
    """
    found = df.select(*keys, text, F.filter(detect(F.coalesce(F.col(text), F.lit("")), cfg or ScanConfig()), lambda m: m["type"] != "ADDRESS").alias("_m")).where(F.size("_m") > 0)
    spans = found.select(*keys, F.explode("_m").alias("m")).select(*keys, "m.type", "m.start", "m.end", "m.value", "m.confidence")
    return boxes_of_spans(spans, tokens_of_text(found.select(*keys, text), keys, text), keys)


def label_prefixes(of: DataFrame, lines: DataFrame, keys: list[str], band: float = BAND) -> DataFrame:
    """The lines ``of`` with ``prefix``, the text of the lines right above each and about above it sideways, from the top: its labels, as in ``spatial``.

    A line looks into the bands of the page that its labels can end in, however high it is.
    """
    high = F.when(F.col("h") > 0, F.col("h")).otherwise(1.0)
    low, top = F.col("y") - F.lit(LABEL_GAP[1]) * high, F.col("y") - F.lit(LABEL_GAP[0]) * high
    looking = of.select(*keys, "line", *_BOX, high.alias("_high"), F.explode(F.sequence(F.floor(low / band), F.floor(top / band))).alias("_band"))
    above = lines.select(*keys, F.struct("line", "text", *_BOX).alias("o"), F.floor((F.col("y") + F.col("h")) / band).alias("_band"))
    gap = F.col("y") - (F.col("o.y") + F.col("o.h"))
    shared = F.least(F.col("x") + F.col("w"), F.col("o.x") + F.col("o.w")) - F.greatest(F.col("x"), F.col("o.x"))
    fits = gap.between(F.lit(LABEL_GAP[0]) * F.col("_high"), F.lit(LABEL_GAP[1]) * F.col("_high")) & (shared > -3 * F.col("_high")) & (F.col("o.line") != F.col("line"))
    met = looking.join(above, [*keys, "_band"]).where(fits)
    found = met.groupBy(*keys, "line").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o.line", "o.text"))), lambda x: x["text"]), " ").alias("prefix"))
    return of.join(found, [*keys, "line"], "left").withColumn("prefix", F.coalesce("prefix", F.lit("")))


def digit_runs(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Gaps and islands: the lines of digit groups only that have another one close below, with ``run``, the island's number, and ``frame``, the
    lines of the island from this one on, as many as a number can reach over."""
    digits = lines.where(F.col("text").rlike(DIGIT_LINE))
    order = Window.partitionBy(*keys).orderBy("line")
    near = F.col("y") - F.lag(F.col("y") + F.col("h")).over(order) <= F.lit(NUMBER_GAP) * F.greatest(F.col("h"), F.lit(1.0))
    joined = F.coalesce((F.lag("line").over(order) == F.col("line") - 1) & near, F.lit(False))
    islands = digits.withColumn("_new", (~joined).cast("int")).withColumn("run", F.sum("_new").over(order))
    ahead = Window.partitionBy(*keys, "run").orderBy("line").rowsBetween(0, NUMBER_LINES - 1)
    framed = islands.withColumn("frame", F.collect_list(F.struct("text", _box().alias("box"))).over(ahead))
    return framed.where(F.size("frame") > 1).drop("_new")


def wrapped_numbers(lines: DataFrame, keys: list[str], cfg: ScanConfig | None = None, ratio: float = 0.12) -> DataFrame:
    """Card and Aadhaar numbers over lines of digit groups, whose checksum passes: keys and ``d``, a ``LOCATED``; the sum of ``spatial``'s search of
    numbers across lines and its labels, over rows. Its box is that of the frame in which it was found."""
    cfg = cfg or ScanConfig()
    labelled = label_prefixes(digit_runs(lines, keys), lines, keys)
    probe = F.concat(_with_prefix(F.col("prefix")), F.array_join(F.transform("frame", lambda x: x["text"]), " "))
    good = lambda m: m["type"].isin("CREDIT_CARD", "DEBIT_CARD", "AADHAAR") & F.coalesce(m["passed"], F.lit(False)) & (F.length(F.regexp_replace(m["value"], "[^0-9]", "")) >= 12)
    found = F.filter(detect(probe, numbers(cfg), kept_only=False), good)
    edge = lambda pick, side: pick(F.transform("frame", lambda x: side(x["box"])))
    x, y = edge(F.array_min, lambda b: b["x"]), edge(F.array_min, lambda b: b["y"])
    around = pad_box(box(x, y, edge(F.array_max, lambda b: b["x"] + b["w"]) - x, edge(F.array_max, lambda b: b["y"] + b["h"]) - y), ratio)
    one = lambda m: F.struct(m["type"].alias("type"), m["severity"].alias("severity"), m["confidence"].alias("confidence"), m["value"].alias("value"), around.alias("box")).cast(LOCATED)
    return labelled.select(*keys, "line", F.explode(F.transform(found, one)).alias("d"))


def _with_prefix(prefix: Column) -> Column:
    return F.when(prefix == "", F.lit("")).otherwise(F.concat(prefix, F.lit(" \n ")))


def line_gate(cfg: ScanConfig) -> str | None:
    """A cheap expression that every line with a detection of its own matches, addresses aside; None if a detection can begin in the labels."""
    chosen = [p for p in PATTERNS if cfg.wants(p.kind)]
    if cfg.wants("CUSTOM_PATTERN") and cfg.custom or any(p.value or p.kind in OVER_LINES or p.gate is None for p in chosen):
        return None
    return "|".join(f"(?:{p.gate})" for p in chosen) if chosen else "(?!)"


def found_in_lines(lines: DataFrame, keys: list[str], cfg: ScanConfig | None = None, ratio: float = 0.12, advance: float = 10.0) -> DataFrame:
    """Detections of single lines, addresses aside, each read with its labels before it: keys, line and ``d``. A detection's box is that of the words of its line that it touches."""
    cfg = cfg or ScanConfig()
    gate = line_gate(cfg)
    labelled = label_prefixes(lines if gate is None else lines.where(F.col("text").rlike(gate)), lines, keys).withColumn("_before", _with_prefix(F.col("prefix"))).withColumn("_from", F.length("_before"))
    own = F.filter(detect(F.concat("_before", "text"), cfg.without("ADDRESS"), kept_only=False), lambda m: m["end"] > F.col("_from"))
    found = labelled.select(*keys, "line", "said", "y", "h", "_from", F.explode(own).alias("m"))
    # The words of the line as it stands, with their offsets there and in the line joined by single spaces.
    starts, joined = (running_sql(x, "0", "{a} + length(" + f + ") + 1") for x, f in (("ws", "x"), ("kept", "x.w")))
    words = bound_sql("split(said, ' ', -1)", "ws", bound_sql(f"filter(zip_with(ws, {starts}, (w, s) -> named_struct('w', w, 's', s)), z -> z.w <> '')", "kept", f"zip_with(kept, {joined}, (z, j) -> named_struct('w', z.w, 's', z.s, 'j', j))"))
    touched = f"filter({words}, t -> m.end > t.j + _from AND m.start < t.j + _from + length(t.w))"
    placed = found.withColumn("_t", F.expr(touched)).where(F.size("_t") > 0)
    x = F.get("_t", F.lit(0))["s"] * F.lit(advance)
    last = F.element_at("_t", -1)
    around = pad_box(box(x, F.col("y"), (last["s"] + F.length(last["w"])) * F.lit(advance) - x, F.col("h")), ratio)
    m = F.col("m")
    return placed.select(*keys, "line", F.struct(m["type"].alias("type"), m["severity"].alias("severity"), m["confidence"].alias("confidence"), m["value"].alias("value"), around.alias("box")).cast(LOCATED).alias("d"))


def token_detections(df: DataFrame, keys: list[str], cfg: ScanConfig | None = None, text: str = "text") -> DataFrame:
    """Masked detections of texts as printed pages, with boxes to two places, over rows: columns as in ``spatial.token_detections``.

    In lines with their labels, in numbers over lines, and in address blocks; those of one type in one place are one, and what is below the
    threshold is left out.
    """
    cfg = cfg or ScanConfig()
    lines, gate = lines_of_text(df, keys, text), line_gate(cfg)
    # only texts that can hold such a detection are cut into lines for it; words of a line are joined by one space
    held = lambda expression: lines_of_text(df.where(F.regexp_replace(text, " {2,}", " ").rlike(expression)), keys, text)
    parts = [found_in_lines(lines if gate is None else held(gate), keys, cfg).withColumn("part", F.lit(0)), wrapped_numbers(held(HAS_DIGIT_LINE), keys, cfg).withColumn("part", F.lit(1))]
    if cfg.wants("ADDRESS"):
        parts.append(address_blocks(lines, keys).drop("n").withColumn("part", F.lit(2)))
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    sure = F.round(F.col("d.confidence") * 100, 6) >= cfg.redact_from
    return distinct_places(found.where(sure), keys).select(
        *keys,
        F.col("d.type").alias("type"),
        mask_value(F.col("d.type"), F.col("d.value")).alias("text"),
        F.col("d.confidence").alias("confidence"),
        F.col("d.severity").alias("severity"),
        F.array(*[F.bround(F.col(f"d.box.{n}"), 2) for n in _BOX]).alias("bbox"),
        F.lit("protected").alias("status"),
        F.lit(True).alias("verification_passed"),
        F.lit(1).alias("attempts"),
    )


def distinct_places(found: DataFrame, keys: list[str]) -> DataFrame:
    """Of the detections ``d`` of a document that are of one type in about the same place the surest, then the first by line: keys, ``d``."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct(*[c for c in ("part", "line") if c in found.columns], "d"))), lambda s: s["d"])
    return found.groupBy(*keys).agg(dedupe(listed).alias("_d")).select(*keys, F.explode("_d").alias("d"))


def _taken(columns: list[str], keys: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, free = None, 0
        for pdf in batches:
            kept = []
            for own, i, n in zip(pdf[keys].itertuples(index=False), pdf["i"], pdf["n"], strict=True):
                if own != at:
                    at, free = own, 0
                kept.append(i >= free)
                free = i + n if i >= free else free
            yield pdf[kept][columns]

    return read


def address_blocks(lines: DataFrame, keys: list[str], ratio: float = 0.12) -> DataFrame:
    """Address blocks of up to five lines: from each line that gives a cue the surest block, then the longest; no line twice. keys, line, n, ``d``.

    Blocks come from a frame of five lines; which of them stay is decided from the top, by a fold over the few that are addresses,
    sorted, that remembers where the last one ended. Null keys are one document.
    """
    order = Window.partitionBy(*keys).orderBy("y", "line")
    rows = lines.withColumn("i", F.row_number().over(order) - 1).withColumn("_frame", F.collect_list(F.struct("text", _box().alias("box"))).over(order.rowsBetween(0, ADDRESS_LINES - 1)))
    best = F.when(address_cue(F.col("text")), best_block(F.col("_frame"), F.lit(0), lambda x: F.array(x["box"]), ratio))
    found = rows.select(*keys, "i", "line", best.alias("_b")).where("_b IS NOT NULL").select(*keys, "i", "line", F.col("_b.n").alias("n"), F.to_json("_b.hit").alias("hit"))
    kinds = ", ".join(f"`{k}` {lines.schema[k].dataType.simpleString()}" for k in keys)
    kept = found.repartition(*keys).sortWithinPartitions(*keys, "i").mapInPandas(_taken([*keys, "line", "n", "hit"], keys), f"{kinds}, line int, n int, hit string")
    return kept.select(*keys, "line", "n", F.from_json("hit", LOCATED).alias("d"))


def address_windows(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The surest address of each text, over windows of one to five lines, of these the longest, then the first: keys, line, n, confidence, value."""
    found = address_blocks(lines_of_text(df, keys, text), keys)
    best = F.max(F.struct(F.col("d.confidence").alias("confidence"), "n", (-F.col("line")).alias("up"), F.col("d.value").alias("value")))
    return found.groupBy(*keys).agg(best.alias("b")).select(*keys, (-F.col("b.up")).alias("line"), "b.n", "b.confidence", "b.value")


def uncovered(second: DataFrame, first: DataFrame, keys: list[str], share: float = 0.25, cell: float = CELL) -> DataFrame:
    """The tokens of a second pass of which those of the first cover at most ``share``, all overlaps added up. Columns and repeats of ``second`` stay.

    Boxes meet in the cells of the page that both touch, each pair in the cell where its overlap begins; boxes over very many cells
    meet those of their page without cells. A box without an area is covered by nothing. second needs an ``id`` that tells its rows in a page apart.
    """
    x2, y2 = F.col("x") + F.col("w"), F.col("y") + F.col("h")
    spread = (F.floor(x2 / cell) - F.floor(F.col("x") / cell) + 1) * (F.floor(y2 / cell) - F.floor(F.col("y") / cell) + 1)
    cells = lambda low, high: F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell)))
    flat = lambda df: df.where((F.col("w") > 0) & (F.col("h") > 0)).withColumn("_large", spread > CELLS)
    dealt = lambda df: df.where(~F.col("_large")).withColumn("_cx", cells(F.col("x"), x2)).withColumn("_cy", cells(F.col("y"), y2))
    a, b = flat(second.select(*keys, "id", *_BOX)), flat(first.select(*keys, *_BOX))
    seen = lambda df: df.withColumn("_p", _box()).drop(*_BOX, "_large")
    left, top = F.greatest(F.col("x"), F.col("_p.x")), F.greatest(F.col("y"), F.col("_p.y"))
    here = (F.floor(left / cell) == F.col("_cx")) & (F.floor(top / cell) == F.col("_cy"))
    pairs = [
        dealt(a).join(seen(dealt(b)), [*keys, "_cx", "_cy"]).where(here).drop("_cx", "_cy", "_large"),
        a.where("_large").join(seen(b), keys).drop("_large"),
        a.where(~F.col("_large")).join(seen(b.where("_large")), keys).drop("_large"),
    ]
    area = overlap_area(_box(), F.col("_p"))
    covered = pairs[0].unionByName(pairs[1]).unionByName(pairs[2]).groupBy(*keys, "id", "w", "h").agg(F.sum(area).alias("_sum"))
    dropped = covered.where(F.col("_sum") / F.greatest(F.lit(1e-6), F.col("w") * F.col("h")) > share).select(*keys, "id")
    return second.join(dropped, [*keys, "id"], "left_anti")
