"""Queries of images whose regions need one, two or three attempts, with the pixels of every attempt worked out in SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ScanConfig
from ..functions.text import bound
from ..operators import images, scan, spatial
from ..sources.tables import dealt, read_images

#: Pixels of the region in a row, pixels on each side of it that must stay, and their grey.
_WIDE, _MARGIN, _GREY = 12, 2, 200
#: What a customer's image is, in both dialects: black and white columns, mode, severity, whether it is read again, type of the region.
_BITS = "(((c_custkey * 40503) % 65536) >> 4)"
_PICK = {
    "mode": ("pixelate", "blur", "frosted", "redact", "c_custkey % 4"),
    "severity": ("low", "medium", "high", "critical", "(c_custkey >> 2) % 4"),
    "reads": ("no", "yes", "(c_custkey >> 4) % 2"),
    "type": ("CUSTOM_PATTERN", "EMAIL", "EMAIL", "(c_custkey >> 5) % 3"),
}
_CHOSEN = {name: f"CASE {at} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END" for name, (*values, at) in _PICK.items()}
#: Contrast from which the reader of the query makes out what stood there.
_LEGIBLE = 64


def _read(pixels: np.ndarray) -> str:
    return "mail u1@shop.example" if int(pixels.max()) - int(pixels.min()) >= _LEGIBLE else "nothing"


def image_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image of each customer in all modes and severities, read again or judged by its detail, until its region is safe: what is left of it."""
    grey = f"{_GREY:02X}" * 3
    side, whole = grey * _MARGIN, grey * (_WIDE + 2 * _MARGIN)
    inner = F.expr(f"array_join(transform(sequence(0, {_WIDE - 1}), i -> CASE WHEN ({_BITS} >> i) % 2 = 1 THEN 'FFFFFF' ELSE '000000' END), '')")
    row = F.concat(F.lit(side), inner, F.lit(side))
    chosen = {name: F.expr(sql) for name, sql in _CHOSEN.items()}
    box = F.struct(*[F.lit(float(v)).alias(n) for n, v in zip("xywh", (_MARGIN, 1, _WIDE, 6), strict=True)])
    found = F.array(F.struct(F.col("type"), F.col("severity"), F.lit(1.0).alias("confidence"), F.lit("").alias("value"), box.alias("box"))).cast(f"array<{spatial.LOCATED}>")
    data = F.unhex(F.concat(F.lit(whole), F.repeat(row, 6), F.lit(whole)))
    rows = dealt(spark, sf_dir, "customer", "c_custkey").select("c_custkey", data.alias("data"), F.lit(8).alias("height"), F.lit(_WIDE + 2 * _MARGIN).alias("width"), *[c.alias(n) for n, c in chosen.items()]).withColumn("regions", found)
    done = [
        images.protect_regions(rows.where((F.col("mode") == mode) & (F.col("reads") == reads)), ScanConfig.of(["email"], mode=mode), _read if reads == "yes" else None)
        for mode in _PICK["mode"][:-1]
        for reads in _PICK["reads"][:-1]
    ]
    line = f"transform(sequence(0, 7), r -> array_join(transform(sequence(0, {_WIDE + 2 * _MARGIN - 1}), x -> substring(h, (r * {_WIDE + 2 * _MARGIN} + x) * 6 + 1, 2)), ''))"
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    lines = out.withColumn("lines", bound(F.hex("data"), "h", line))
    return lines.select(
        "c_custkey", "mode", "severity", "reads", "type", F.col("attempts")[0].alias("attempts"), F.col("verified")[0].alias("verified"),
        F.col("lines")[3].alias("pixels"), F.size(F.array_distinct("lines")).alias("kinds_of_lines"),
    )


def _attempts_sql() -> str:
    last = _WIDE - 1
    chosen = ", ".join(f"{sql} AS {name}" for name, sql in _CHOSEN.items())
    base = "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in images.RADIUS.items()) + " END"
    radii = sorted({1.0, images.FROST} | {round(r * (1 + images.GROWTH * a), 6) for r in images.RADIUS.values() for a in range(images.ATTEMPTS)})
    detail = lambda p: f"SELECT s.c_custkey, avg(abs(p.v - s.v)) AS detail FROM (SELECT p.c_custkey, k.x, sum(k.w * p.v) AS v FROM {p} p JOIN k ON k.radius = 1 AND k.y = p.x GROUP BY ALL) s JOIN {p} p USING (c_custkey, x) GROUP BY ALL"
    steps = [
        f"""i AS (SELECT c_custkey, {chosen} FROM customer),
        c AS (SELECT *, CASE WHEN severity = 'critical' OR mode = 'frosted' THEN 'frost' ELSE mode END AS act, {base} AS base FROM i),
        o AS (SELECT CAST(radius AS DOUBLE) AS radius, unnest(range(-greatest(1, CAST(floor(3 * radius) AS BIGINT)), greatest(1, CAST(floor(3 * radius) AS BIGINT)) + 1)) AS o FROM (VALUES {", ".join(f"({r})" for r in radii)}) t(radius)),
        n AS (SELECT radius, o, exp(-0.5 * (o / radius) * (o / radius)) / sum(exp(-0.5 * (o / radius) * (o / radius))) OVER (PARTITION BY radius) AS w FROM o),
        k AS (SELECT radius, x, greatest(0, least({last}, x + o)) AS y, sum(w) AS w FROM n, range({_WIDE}) t(x) GROUP BY ALL),
        p0 AS (SELECT c_custkey, x, CAST(({_BITS} >> x) % 2 * 255 AS DOUBLE) AS v FROM customer, range({_WIDE}) t(x)),
        d0 AS ({detail("p0")})"""
    ]
    for a in range(1, images.ATTEMPTS + 1):
        strength = 1 + images.GROWTH * (a - 1)
        cell = f"CAST(floor(x * {max(2, int(images.BLOCKS / strength))} / {_WIDE}) AS INT)"
        before = "p0" if a == 1 else f"u{a - 1}"
        steps.append(
            f"""b{a} AS (SELECT p.c_custkey, k.x, sum(k.w * p.v) AS v FROM {before} p JOIN c USING (c_custkey) JOIN k ON k.y = p.x AND k.radius = CASE act WHEN 'frost' THEN {images.FROST} ELSE round(base * {strength}, 6) END GROUP BY ALL),
        e{a} AS (SELECT c_custkey, x, act, severity, p.v AS was, CASE act WHEN 'redact' THEN {images.INK[0]} WHEN 'frost' THEN b.v * (1 - 90 / 255) + 90 ELSE b.v END AS v FROM {before} p JOIN b{a} b USING (c_custkey, x) JOIN c USING (c_custkey)),
        p{a} AS (SELECT c_custkey, x, CAST(round_even(CASE WHEN act = 'pixelate' THEN avg(was) OVER g WHEN act = 'frost' AND severity = 'critical' AND {a} > 1 THEN avg(v) OVER g ELSE v END, 0) AS DOUBLE) AS v FROM e{a} WINDOW g AS (PARTITION BY c_custkey, {cell})),
        d{a} AS ({detail(f"p{a}")}),
        s{a} AS (SELECT c_custkey, CASE WHEN reads = 'yes' AND type <> 'CUSTOM_PATTERN' THEN spread < {_LEGIBLE} ELSE d0.detail <= 1e-6 OR d.detail <= greatest({images.DETAIL_LEFT}, {images.DETAIL_PART} * d0.detail) END AS safe
            FROM d{a} d JOIN d0 USING (c_custkey) JOIN c USING (c_custkey) JOIN (SELECT c_custkey, max(v) - min(v) AS spread FROM p{a} GROUP BY ALL) USING (c_custkey)),
        u{a} AS (SELECT p.* FROM p{a} p JOIN s{a} USING (c_custkey) WHERE NOT safe)"""
        )
    ends = " UNION ALL ".join(f"SELECT c_custkey, x, v, {a} AS attempts, safe FROM p{a} JOIN s{a} USING (c_custkey)" + (" WHERE safe" if a < images.ATTEMPTS else "") for a in range(1, images.ATTEMPTS + 1))
    margin = f"{_GREY:02X}" * _MARGIN
    return f"""WITH {", ".join(steps)}, ended AS ({ends})
        SELECT c_custkey, mode, severity, reads, type, attempts, safe AS verified, '{margin}' || string_agg(printf('%02X', CAST(v AS INT)), '' ORDER BY x) || '{margin}' AS pixels,
            CASE WHEN count_if(v <> {_GREY}) = 0 THEN 1 ELSE 2 END AS kinds_of_lines
        FROM ended JOIN c USING (c_custkey) GROUP BY ALL"""


#: What stands in the image of a customer and how well each pass reads it (0: it fails); a credential is kept however badly it is read.
_WORD = "CASE WHEN c_custkey % 7 = 2 THEN concat('ghp_', lpad(CAST(c_custkey AS STRING), 36, 'a')) ELSE concat('u', CAST(c_custkey AS STRING), '@shop.example') END"
_SURE = ((90, 90), (25, 25), (5, 5), (10, 10), (90, 0), (0, 90))


def _read_word(image: np.ndarray, scale: float) -> list[dict]:
    """The characters in the first row of an image, read as well as its second row says for each pass."""
    sure = int(image[1, int(scale) - 1, 0])
    if not sure:
        raise ValueError("cannot be read")
    word = bytes(c for c in image[0, :, 0].tolist() if c).decode("ascii")
    return [{"text": word, "conf": sure} | {n: v * scale for n, v in zip(("left", "top", "width", "height"), (8.0, 4.0, 40.0, 10.0), strict=True)}]


def ocr_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with an image that a reader reads in two passes, or fails to, or with a text alone, from pixels to the answer."""
    pixel = lambda at: f"concat({at}, '0000')"
    k = F.col("c_custkey") % 7
    first = F.rpad(F.expr(f"array_join(transform(split({_WORD}, ''), c -> {pixel('hex(c)')}), '')"), 64 * 6, "0")
    sure = F.coalesce(*[F.when(k == i, "".join(f"{v:02X}0000" for v in passes)) for i, passes in enumerate(_SURE)])
    data = F.unhex(F.rpad(F.concat(first, sure), 64 * 20 * 6, "0"))
    tokens = F.expr("CAST(null AS array<struct<text:string,bbox:array<double>>>)").alias("tokens")
    rows = dealt(spark, sf_dir, "customer", "c_custkey").select("c_custkey", tokens, F.lit("SSN 123-45-6789").alias("text"), F.lit(20).alias("height"), F.lit(64).alias("width"), data.alias("data"))
    read = read_images(rows, _read_word)
    done = scan.responses(read, ["c_custkey", "ocr_status"], ScanConfig.of(["email", "ssn", "access_token"], mode="redact"))
    shown = done.select("c_custkey", "ocr_status", "status", "total_detections", F.explode_outer("detections").alias("d"))
    return shown.select("c_custkey", "ocr_status", "status", "total_detections", "d.type", "d.text", *[F.col("d.bbox")[i].alias(n) for i, n in enumerate("xywh")], F.col("d.verification_passed").alias("verified"))


_OCR_SQL = f"""WITH r AS (SELECT c_custkey, {_WORD.replace("AS STRING", "AS VARCHAR")} AS word, c_custkey % 7 AS k FROM customer),
    p AS (SELECT *, {", ".join(f"CASE k {' '.join(f'WHEN {i} THEN {v[n]}' for i, v in enumerate(_SURE))} END AS {name}" for n, name in enumerate(("one", "two")))} FROM r),
    s AS (SELECT *, CASE WHEN k = 6 THEN NULL WHEN one = 0 THEN 'failed' WHEN two = 0 THEN 'partly read' ELSE 'read' END AS ocr_status,
        CASE WHEN k = 6 THEN 'SSN' WHEN one >= 30 OR (one > 0 AND (two >= 20 OR (two > 0 AND word LIKE 'ghp~_%' ESCAPE '~'))) THEN CASE WHEN word LIKE 'ghp%' THEN 'ACCESS_TOKEN' ELSE 'EMAIL' END END AS type FROM p)
    SELECT c_custkey, ocr_status, 'completed' AS status, CASE WHEN type IS NULL THEN 0 ELSE 1 END AS total_detections, type,
        CASE type WHEN 'SSN' THEN 'XXX-XX-6789' WHEN 'EMAIL' THEN 'u•••@s••.•••' WHEN 'ACCESS_TOKEN' THEN 'ghp_' || repeat('•', 12) END AS text,
        CASE WHEN k = 6 THEN CAST(0 AS DOUBLE) WHEN type IS NOT NULL THEN 8 - 10 * 0.12 END AS x, CASE WHEN k = 6 THEN CAST(0 AS DOUBLE) WHEN type IS NOT NULL THEN 4 - 10 * 0.12 END AS y,
        CASE WHEN k = 6 THEN CAST(0 AS DOUBLE) WHEN type IS NOT NULL THEN 40 + 20 * 0.12 END AS w, CASE WHEN k = 6 THEN CAST(0 AS DOUBLE) WHEN type IS NOT NULL THEN 10 + 20 * 0.12 END AS h,
        CASE WHEN type IS NOT NULL THEN true END AS verified
    FROM s"""

QUERIES = {"image_attempts": image_attempts, "ocr_requests": ocr_requests}
ORACLES = {"image_attempts": _attempts_sql(), "ocr_requests": _OCR_SQL}
