"""Detection over positioned tokens, inside the row: lines, label context, numbers and addresses that span lines, boxes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ScanConfig
from ..functions.geometry import iou, pad_box, union_box, y_overlap
from ..functions.masks import mask_value
from ..functions.text import let
from .detect import address_match, detect
from .scoring import address_cue

TOKEN = "struct<text:string,x:double,y:double,w:double,h:double>"
LOCATED = "struct<type:string,severity:string,confidence:double,value:string,box:struct<x:double,y:double,w:double,h:double>>"
#: Heights of a line that a label may stand above it, that a wrapped number's lines may be apart, and those of an address.
LABEL_GAP, NUMBER_GAP, ADDRESS_GAP = (-0.5, 2.5), 1.6, 1.8
#: Lines of an address at most, and the overlap from which two boxes of a type are one detection.
ADDRESS_LINES, SAME_BOX = 5, 0.6


def tokens_of_request(tokens: Column) -> Column:
    """Tokens given as (text, bbox) with four numbers; others are left out."""
    good = F.filter(tokens, lambda t: F.size(t["bbox"]) == 4)
    return F.transform(good, lambda t: F.struct(t["text"].alias("text"), *[F.get(t["bbox"], F.lit(i)).alias(n) for i, n in enumerate("xywh")]).cast(TOKEN))


def group_lines(tokens: Column, overlap: float = 0.5) -> Column:
    """Tokens as lines from the top, each from the left: a token joins the first line whose first token it overlaps enough."""
    order = F.transform(F.sort_array(F.transform(tokens, lambda t, i: F.struct(t["y"].alias("y"), t["x"].alias("x"), i.alias("i"), t.alias("t")))), lambda s: s["t"])

    def place(lines: Column, t: Column) -> Column:
        at = F.array_position(F.transform(lines, lambda line: y_overlap(F.get(line, F.lit(0)), t) >= overlap), True)
        return F.when(at == 0, F.concat(lines, F.array(F.array(t)))).otherwise(F.transform(lines, lambda line, i: F.when(i == at - 1, F.concat(line, F.array(t))).otherwise(line)))

    lines = F.aggregate(order, F.array().cast(f"array<array<{TOKEN}>>"), place)
    left = lambda line: F.transform(F.sort_array(F.transform(line, lambda t, i: F.struct(t["x"].alias("x"), i.alias("i"), t.alias("t")))), lambda s: s["t"])
    return F.transform(lines, left)


def _joined(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: t["text"]), " ")


def _described(tokens: Column) -> Column:
    """Lines with their box, text, and each token's offset in the text."""

    def line(toks: Column) -> Column:
        before = lambda k: F.aggregate(F.slice(toks, F.lit(1), k), F.lit(0), lambda a, x: a + F.length(x["text"]) + 1)
        placed = F.transform(toks, lambda t, k: F.struct(t["text"].alias("text"), *[t[n].alias(n) for n in "xywh"], before(k).alias("at")))
        return F.struct(placed.alias("toks"), union_box(toks).alias("box"), _joined(toks).alias("text"))

    return F.transform(group_lines(tokens), line)


def label_prefix(lines: Column, line: Column, i: Column) -> Column:
    """The text of the lines right above a line and about above it sideways: its labels."""
    b = line["box"]
    high = F.when(b["h"] > 0, b["h"]).otherwise(1.0)

    def above(o: Column, j: Column) -> Column:
        gap, shared = b["y"] - (o["box"]["y"] + o["box"]["h"]), F.least(b["x"] + b["w"], o["box"]["x"] + o["box"]["w"]) - F.greatest(b["x"], o["box"]["x"])
        return (i != j) & gap.between(LABEL_GAP[0] * high, LABEL_GAP[1] * high) & (shared > -3 * high)

    return F.array_join(F.transform(F.filter(lines, above), lambda o: o["text"]), " ")


def _with_prefix(prefix: Column) -> Column:
    return F.when(prefix == "", F.lit("")).otherwise(F.concat(prefix, F.lit(" \n ")))


def _located(m: Column, boxes: Column, ratio: float, width: Column | None, height: Column | None) -> Column:
    return F.struct(m["type"].alias("type"), m["severity"].alias("severity"), m["confidence"].alias("confidence"), m["value"].alias("value"), pad_box(union_box(boxes), ratio, width, height).alias("box")).cast(LOCATED)


def _in_lines(lines: Column, cfg: ScanConfig, ratio: float, width: Column | None, height: Column | None) -> Column:
    def one(line: Column, i: Column) -> Column:
        def found(prefix: Column) -> Column:
            offset = F.length(prefix)
            own = F.filter(detect(F.concat(prefix, line["text"]), cfg.without("ADDRESS"), kept_only=False), lambda m: m["end"] > offset)

            def boxed(m: Column) -> Column:
                touched = F.filter(line["toks"], lambda t: (m["end"] > t["at"] + offset) & (m["start"] < t["at"] + offset + F.length(t["text"])))
                return F.when(F.size(touched) > 0, _located(m, touched, ratio, width, height))

            return F.array_compact(F.transform(own, boxed))

        return let(_with_prefix(label_prefix(lines, line, i)), found)

    return F.flatten(F.transform(lines, one))


def numbers(cfg: ScanConfig) -> ScanConfig:
    """What is looked for in numbers: all types but addresses and users' patterns, as others may stand in the way of a number."""
    return replace(cfg, custom=()).without("ADDRESS")


def _across_lines(lines: Column, cfg: ScanConfig, ratio: float, width: Column | None, height: Column | None) -> Column:
    """Card and Aadhaar numbers wrapped over lines of digit groups only; their checksum must pass."""
    groups = lambda line: F.forall(line["toks"], lambda t: F.trim(t["text"]).rlike("(?U)^\\d{3,8}$"))
    plain_cfg = numbers(cfg)

    def run_length(i: Column) -> Column:
        def step(s: Column, line: Column) -> Column:
            near = s["below"].isNull() | (line["box"]["y"] - s["below"] <= NUMBER_GAP * F.greatest(line["box"]["h"], F.lit(1.0)))
            go = s["go"] & groups(line) & near
            return F.struct(go.alias("go"), (s["n"] + F.when(go, 1).otherwise(0)).alias("n"), (line["box"]["y"] + line["box"]["h"]).alias("below"))

        zero = F.struct(F.lit(True).alias("go"), F.lit(0).alias("n"), F.lit(None).cast("double").alias("below"))
        return F.aggregate(F.slice(lines, i + 1, F.size(lines)), zero, step, lambda s: s["n"])

    def one(line: Column, i: Column) -> Column:
        def of_run(n: Column) -> Column:
            toks = F.flatten(F.transform(F.slice(lines, i + 1, n), lambda x: x["toks"]))
            probe = F.concat(_with_prefix(label_prefix(lines, line, i)), _joined(toks))
            good = lambda m: m["type"].isin("CREDIT_CARD", "DEBIT_CARD", "AADHAAR") & F.coalesce(m["passed"], F.lit(False)) & (F.length(F.regexp_replace(m["value"], "[^0-9]", "")) >= 12)
            found = F.transform(F.filter(detect(probe, plain_cfg, kept_only=False), good), lambda m: _located(m, toks, ratio, width, height))
            return F.when(n >= 2, found).otherwise(F.array().cast(f"array<{LOCATED}>"))

        return let(run_length(i), of_run)

    return F.flatten(F.transform(lines, one))


def best_block(rows: Column, i: Column, boxes: Callable[[Column], Column], ratio: float, width: Column | None = None, height: Column | None = None) -> Column:
    """Of the blocks of up to five lines that begin with line i, which follow each other closely, the surest as an address, then the longest: (sure, n, hit), or null."""

    def linked(k: Column) -> Column:
        this, last = F.get(rows, k)["box"], F.get(rows, k - 1)["box"]
        return this["y"] - (last["y"] + last["h"]) <= ADDRESS_GAP * F.greatest(this["h"], F.lit(1.0))

    def block(n: int) -> Column:
        part = F.slice(rows, i + 1, F.lit(n))
        whole = (i + n <= F.size(rows)) & (F.forall(F.sequence(i + 1, i + n - 1), linked) if n > 1 else F.lit(True))
        m = address_match(F.array_join(F.transform(part, lambda x: x["text"]), "\n"), F.lit(n > 1))
        return let(m, lambda a: F.when(whole & a.isNotNull(), F.struct(a["confidence"].alias("sure"), F.lit(n).alias("n"), _located(a, F.flatten(F.transform(part, boxes)), ratio, width, height).alias("hit"))))

    return F.array_max(F.array_compact(F.array(*[block(n) for n in range(1, ADDRESS_LINES + 1)])))


def _addresses(lines: Column, ratio: float, width: Column | None, height: Column | None) -> Column:
    """Address blocks of up to five lines: from each line that gives a cue, the surest block, then the longest; no line twice."""
    top = lambda x: F.array_min(F.transform(x["toks"], lambda t: t["y"]))
    ordered = F.transform(F.sort_array(F.transform(lines, lambda x, i: F.struct(top(x).alias("y"), i.alias("i"), x.alias("line")))), lambda s: s["line"])

    def over(rows: Column) -> Column:
        best = F.transform(rows, lambda x, i: F.when(address_cue(x["text"]), best_block(rows, i, lambda x: x["toks"], ratio, width, height)))

        def take(s: Column, x: Column) -> Column:
            use = (s["at"] >= s["free"]) & x.isNotNull()
            return F.struct((s["at"] + 1).alias("at"), F.when(use, s["at"] + x["n"]).otherwise(s["free"]).alias("free"), F.when(use, F.concat(s["out"], F.array(x["hit"]))).otherwise(s["out"]).alias("out"))

        zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("free"), F.array().cast(f"array<{LOCATED}>").alias("out"))
        return F.aggregate(best, zero, take, lambda s: s["out"])

    return let(ordered, over)


def dedupe(found: Column) -> Column:
    """Of detections of one type in about the same place the surest stays, then the first; result by confidence."""
    order = F.transform(F.sort_array(F.transform(found, lambda d, i: F.struct((-d["confidence"]).alias("c"), i.alias("i"), d.alias("d")))), lambda s: s["d"])
    same = lambda a, b: (a["type"] == b["type"]) & (iou(a["box"], b["box"]) >= SAME_BOX)
    return F.aggregate(order, F.array().cast(f"array<{LOCATED}>"), lambda out, d: F.when(F.exists(out, lambda k: same(k, d)), out).otherwise(F.concat(out, F.array(d))))


def locate(tokens: Column, cfg: ScanConfig | None = None, width: Column | None = None, height: Column | None = None, ratio: float = 0.12) -> Column:
    """All located detections of a row of tokens, also those below the threshold, surest first."""
    cfg = cfg or ScanConfig()

    def over(lines: Column) -> Column:
        parts = [_in_lines(lines, cfg, ratio, width, height), _across_lines(lines, cfg, ratio, width, height)]
        if cfg.wants("ADDRESS"):
            parts.append(_addresses(lines, ratio, width, height))
        return dedupe(F.concat(*parts))

    return let(_described(tokens), over)


def token_detections(df: DataFrame, keys: list[str], cfg: ScanConfig | None = None, tokens: str = "tokens", width: str | None = None, height: str | None = None) -> DataFrame:
    """Masked detections of rows of tokens, boxes to two places; what is below the threshold is left out."""
    cfg = cfg or ScanConfig()
    found = locate(F.coalesce(F.col(tokens), F.array().cast(f"array<{TOKEN}>")), cfg, F.col(width) if width else None, F.col(height) if height else None)
    rows = df.select(*keys, F.explode(found).alias("d")).where(F.round(F.col("d.confidence") * 100, 6) >= cfg.redact_from)
    return rows.select(
        *keys,
        F.col("d.type").alias("type"),
        mask_value(F.col("d.type"), F.col("d.value")).alias("text"),
        F.col("d.confidence").alias("confidence"),
        F.col("d.severity").alias("severity"),
        F.array(*[F.bround(F.col(f"d.box.{n}"), 2) for n in "xywh"]).alias("bbox"),
        F.lit("protected").alias("status"),
        F.lit(True).alias("verification_passed"),
        F.lit(1).alias("attempts"),
    )


def tokens_from_text(text: Column, advance: float = 10.0, line_height: float = 24.0, height: float = 20.0) -> Column:
    """Extension: tokens of a plain text as if it were printed in a fixed pitch, one line per line of text."""

    def line(row: Column, number: Column) -> Column:
        words = F.split(row, " ", -1)
        at = lambda k: F.aggregate(F.slice(words, F.lit(1), k), F.lit(0), lambda a, w: a + F.length(w) + 1)
        every = F.transform(words, lambda w, k: F.struct(w.alias("text"), (at(k) * advance).alias("x"), (number * line_height).alias("y"), (F.length(w) * advance).alias("w"), F.lit(height).alias("h")).cast(TOKEN))
        return F.filter(every, lambda t: t["text"] != "")

    return F.flatten(F.transform(F.split(text, "\n", -1), line))
