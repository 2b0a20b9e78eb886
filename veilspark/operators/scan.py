"""Scans of tables of texts, and the reports made from them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ScanConfig
from ..functions.masks import mask_value
from ..functions.text import between, let
from ..sources.tables import scan_input, spread
from . import images, scoring, spatial
from .catalog import RESIDUAL, RISK
from .detect import detect, fits, unfinished


def with_matches(df: DataFrame, cfg: ScanConfig | None = None, text: str = "text", name: str = "matches", explain: bool = False, fit: Column | None = None) -> DataFrame:
    """df with its detections as an array; null text has none, nor has a text that ``failed``. Raw values are in it: keep it out of sinks."""
    read = F.when(failed(F.col(text)), F.lit("")).otherwise(F.coalesce(F.col(text), F.lit("")))
    cfg = cfg or ScanConfig()
    if not cfg.wants("ADDRESS"):
        return df.withColumn(name, detect(read, cfg, explain, fit=fit))
    said = df.withColumn("_said", scoring.address_words(read))
    return said.withColumn(name, detect(read, cfg, explain, words=F.col("_said"), fit=fit)).drop("_said")


def failed(text: Column) -> Column:
    """Whether a text cannot be scanned: bytes that are no UTF-8. Such a row is set apart and the others go on."""
    return ~F.coalesce(F.is_valid_utf8(text), F.lit(True))


def detections(df: DataFrame, keys: list[str], cfg: ScanConfig | None = None, text: str = "text") -> DataFrame:
    """One row per detection with its masked text: keys, type, text, confidence, severity, bbox, status, verification_passed, attempts."""
    # explode_outer: under a plain explode the optimizer asks for rows with matches first, and so detects twice more in a filter.
    found = with_matches(spread(df.select(*keys, text)), cfg, text, "_matches").select(*keys, F.explode_outer("_matches").alias("_m"))
    return found.where("_m IS NOT NULL").select(
        *keys,
        F.col("_m.type").alias("type"),
        mask_value(F.col("_m.type"), F.col("_m.value")).alias("text"),
        F.col("_m.confidence").alias("confidence"),
        F.col("_m.severity").alias("severity"),
        F.array(*[F.lit(0.0)] * 4).alias("bbox"),
        F.lit("protected").alias("status"),
        F.lit(True).alias("verification_passed"),
        F.lit(1).alias("attempts"),
    )


def _regions(tokens: Column, text: Column, cfg: ScanConfig, width: Column | None = None, height: Column | None = None) -> Column:
    """Detections in tokens, or else in a text, where they have no box; those below the threshold are left out."""
    sure = F.filter(spatial.locate(F.coalesce(tokens, F.array().cast(f"array<{spatial.TOKEN}>")), cfg, width, height), lambda d: F.round(d["confidence"] * 100, 6) >= cfg.redact_from)
    nowhere = F.struct(*[F.lit(0.0).alias(n) for n in "xywh"])
    read = F.transform(detect(F.coalesce(text, F.lit("")), cfg), lambda m: F.struct(m["type"].alias("type"), m["severity"].alias("severity"), m["confidence"].alias("confidence"), m["value"].alias("value"), nowhere.alias("box")))
    return F.when(tokens.isNotNull(), sure).otherwise(read.cast(f"array<{spatial.LOCATED}>"))


def request_detections(df: DataFrame, keys: list[str], cfg: ScanConfig | None = None) -> DataFrame:
    """The composed scan of requests: tokens that were given, else those read from the image, else the text; columns as in ``detections``.

    df has ``tokens``, an array of (text, bbox), ``ocr``, an array of ``spatial.TOKEN``, and ``text``; each may be null. A request
    without any of them, or whose text cannot be scanned, has no rows.
    """
    tokens, text = scan_input(spatial.tokens_of_request(F.col("tokens")), F.col("ocr"), F.col("text"))
    rows = df.select(*keys, tokens.alias("_tokens"), F.when(failed(text), None).otherwise(text).alias("_text"))
    found = _regions(F.col("_tokens"), F.col("_text"), cfg or ScanConfig())
    return rows.select(*keys, F.explode_outer(found).alias("_d")).where("_d IS NOT NULL").select(
        *keys,
        F.col("_d.type").alias("type"),
        mask_value(F.col("_d.type"), F.col("_d.value")).alias("text"),
        F.col("_d.confidence").alias("confidence"),
        F.col("_d.severity").alias("severity"),
        F.array(*[F.bround(F.col(f"_d.box.{n}"), 2) for n in "xywh"]).alias("bbox"),
        F.lit("protected").alias("status"),
        F.lit(True).alias("verification_passed"),
        F.lit(1).alias("attempts"),
    )


def responses(df: DataFrame, keys: list[str], cfg: ScanConfig | None = None, read: Callable[[np.ndarray], str] | None = None) -> DataFrame:
    """The whole answer to each request, one row: keys, status, detections, total_detections, critical_count, protected_count, privacy_score, height, width, data.

    df is as in ``request_detections``, with height, width int and ``data`` binary (RGB, row by row). Regions of an image are obfuscated
    as ``cfg.mode`` says and read again by ``read`` (see ``images.protect_regions``); ``data`` is the image after that. Null data, or of
    another size than stated, is no image: tokens that were given are used then, or the text, but no words. With an image the text is not
    read. detections is an array of
    (type, text, confidence, severity, bbox, status, verification_passed, attempts), masked. Where a text cannot be scanned, or a user's
    pattern would take too long over it, status is failed and the score 50 at most.
    """
    cfg = cfg or ScanConfig()
    whole = F.coalesce(F.length("data") == F.col("height").cast("long") * F.col("width") * 3, F.lit(False))
    tokens, text = scan_input(spatial.tokens_of_request(F.col("tokens")), F.when(whole, F.coalesce("ocr", F.array().cast(f"array<{spatial.TOKEN}>"))), F.col("text"))
    bad, slow = F.coalesce(failed(text), F.lit(False)), unfinished(fits(text, cfg))
    given = [F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]
    rows = df.select(*given, "height", "width", F.when(whole, F.col("data")).alias("data"), tokens.alias("_tokens"), F.when(~bad, text).alias("_text"), (bad | slow).alias("_failed"))
    size = (F.nullif(n.cast("double"), F.lit(0.0)) for n in (F.col("width"), F.col("height")))
    done = images.protect_regions(rows.withColumn("regions", _regions(F.col("_tokens"), F.col("_text"), cfg, *size)), cfg, read)

    def shown(r: Column, i: Column) -> Column:
        return F.struct(
            r["type"].alias("type"), mask_value(r["type"], r["value"]).alias("text"), r["confidence"].alias("confidence"), r["severity"].alias("severity"),
            F.array(*[F.bround(r["box"][n], 2) for n in "xywh"]).alias("bbox"), F.lit("protected").alias("status"),
            F.get("verified", i).alias("verification_passed"), F.get("attempts", i).alias("attempts"),
        )

    n = F.size("regions")
    weights = F.aggregate("regions", F.lit(0), lambda a, r: a + severity_weight(r["severity"]))
    return done.select(
        *[F.col(f"_key{i}").alias(k) for i, k in enumerate(keys)],
        F.when(F.col("_failed"), "failed").otherwise("completed").alias("status"),
        F.transform("regions", shown).alias("detections"),
        n.alias("total_detections"),
        F.size(F.filter("regions", lambda r: r["severity"] == "critical")).alias("critical_count"),
        n.alias("protected_count"),
        privacy_score(weights, n, F.col("_failed")).alias("privacy_score"),
        "height",
        "width",
        "data",
    )


def severity_weight(severity: Column) -> Column:
    return F.coalesce(*[F.when(severity == k, v) for k, v in RISK.items()], F.lit(8))


def privacy_score(weights: Column, n: Column, failed: Column | None = None) -> Column:
    """100 less what protected detections leave of their weights; at most 50 where detection failed. weights: their whole sum."""
    score = F.bround(F.greatest(F.lit(0.0), F.lit(100.0) - weights * F.lit(RESIDUAL)), 1)
    score = F.when(n == 0, F.lit(100.0)).otherwise(score)
    return score if failed is None else F.when(failed, F.least(score, F.lit(50.0))).otherwise(score)


def client_score(weights: Column, n: Column) -> Column:
    """The client's score: it never shows more than 99 unless nothing was found."""
    return F.when(n == 0, F.lit(100)).otherwise(F.least(F.lit(99), F.lit(100) - F.greatest(F.lit(2), F.floor(weights * F.lit(RESIDUAL) + 0.5)))).cast("int")


def summaries(df: DataFrame, keys: list[str], cfg: ScanConfig | None = None, text: str = "text") -> DataFrame:
    """One row per document, also without detections; computed in the row. A text that cannot be scanned, or over which a user's pattern
    would take too long, has status failed and 50 at most; in the latter all other patterns are found."""
    cfg = cfg or ScanConfig()
    m, bad = F.col("_matches"), F.col("_bad")
    weights = F.aggregate(m, F.lit(0), lambda a, x: a + severity_weight(x["severity"]))
    rows = spread(df.select(*keys, text)).withColumn("_fit", fits(F.col(text), cfg))
    found = with_matches(rows, cfg, text, "_matches", fit=F.col("_fit")).withColumn("_bad", failed(F.col(text)) | unfinished(F.col("_fit")))
    return found.select(
        *keys,
        F.when(bad, "failed").otherwise("completed").alias("status"),
        F.size(m).alias("total_detections"),
        F.size(F.filter(m, lambda x: x["severity"] == "critical")).alias("critical_count"),
        F.size(m).alias("protected_count"),
        privacy_score(weights, F.size(m), bad).alias("privacy_score"),
        client_score(weights, F.size(m)).alias("client_score"),
    )


def report_by_type(found: DataFrame) -> DataFrame:
    """Detections by type: count, best confidence, protected ones."""
    return found.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence"), F.count_if(F.col("status") == "protected").alias("protected"))


def report_totals(found: DataFrame) -> DataFrame:
    """One row: total, protected, exposed and the mean confidence in whole percent, halves up."""
    return found.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "protected").alias("protected"),
        F.count_if(F.col("status") != "protected").alias("exposed"),
        F.coalesce(F.floor(F.sum((F.col("confidence") * 10000).cast("long")) / F.count(F.lit(1)) / 100 + 0.5), F.lit(0)).cast("long").alias("avg_confidence"),
    )


def redact_text(text: Column, cfg: ScanConfig) -> Column:
    """Extension: the text with each detection, addresses aside, replaced by its mask."""
    found = detect(text, cfg.without("ADDRESS"))

    def rewrite(m: Column) -> Column:
        at = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(m, i - 1)["end"])
        kept = F.transform(m, lambda x, i: F.concat(between(text, at(i), x["start"]), mask_value(x["type"], x["value"])))
        return F.concat(F.array_join(kept, ""), between(text, at(F.size(m)), F.length(text)))

    return let(found, rewrite)
