"""Where texts, tokens and images come from, and where results go."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import overlap_area
from ..operators.spatial import TOKEN

#: Least confidence of an OCR token, how much an enlarged second pass may be below it, and the enlargement.
MIN_CONFIDENCE, SECOND_PASS_LESS, ENLARGED = 30.0, 10.0, 2.0
#: Largest upload and its formats.
MAX_UPLOAD, UPLOADS = 10 * 1024 * 1024, ("png", "jpg", "jpeg", "webp")
#: Fixed value: beginnings of credentials, which are kept whatever the OCR thinks of them.
CREDENTIAL = r"^(?:sk-|pk-|rk_|xox[baprs]-|ghp_|gho_|ghu_|ghs_|ghr_|github_pat_|AKIA|ASIA|eyJ)[A-Za-z0-9._\-\]/+]{6,}"
#: Part of a second-pass token that known tokens may cover.
COVERED = 0.25
#: Tasks at least for each core, and for each split of a table, when a table is spread.
TASKS_OF_CORE, TASKS_OF_SPLIT = 4, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table dealt out evenly to tasks that grow in number with its splits, as a scan costs far more than a shuffle of what it reads: a split may
    hold all rows of a file, and how many splits there are says nothing of that."""
    if df.isStreaming:
        return df
    return df.repartition(max(TASKS_OF_CORE * df.sparkSession.sparkContext.defaultParallelism, TASKS_OF_SPLIT * df.rdd.getNumPartitions()))


def dealt(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table, spread: for rows from which much is composed or found."""
    return spread(table(spark, sf_dir, name).select(*columns))


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """Image files that may be scanned: by format and size, both checked before the content is read."""
    files = spark.read.format("binaryFile").load(path)
    return files.where((F.col("length") <= MAX_UPLOAD) & F.lower(F.substring_index("path", ".", -1)).isin(*UPLOADS))


def decode_image(data: Column) -> Column:
    """Bytes of a base64 image with or without its data-URL head; null if it is no base64."""
    return F.try_to_binary(F.regexp_replace(data, r"^data:[^,]*,", ""), F.lit("base64"))


def encode_image(data: Column) -> Column:
    return F.concat(F.lit("data:image/png;base64,"), F.regexp_replace(F.base64(data), r"\s", ""))


def ocr_tokens(raw: Column, threshold: float = MIN_CONFIDENCE, scale: float = 1.0, rescue: bool = False) -> Column:
    """Raw OCR words (text, conf, left, top, width, height) as tokens in the image's own scale."""
    sure = lambda r: F.coalesce(r["conf"].try_cast("double"), F.lit(-1.0)) >= threshold
    word = lambda r: F.regexp_replace(F.coalesce(r["text"], F.lit("")), r"(?U)^\s+|\s+$", "")
    keep = F.filter(raw, lambda r: (word(r) != "") & (sure(r) | (word(r).rlike(CREDENTIAL) if rescue else F.lit(False))) & (r["width"] > 0) & (r["height"] > 0))
    return F.transform(keep, lambda r: F.struct(word(r).alias("text"), *[(r[c].cast("double") / scale).alias(n) for c, n in zip(("left", "top", "width", "height"), "xywh", strict=True)]).cast(TOKEN))


def merge_tokens(first: Column, second: Column) -> Column:
    """Tokens of the first pass, and those of the second that the first has hardly covered."""
    covered = lambda t: F.aggregate(first, F.lit(0.0), lambda a, p: a + overlap_area(t, p)) / F.greatest(F.lit(1e-6), t["w"] * t["h"])
    return F.concat(first, F.filter(second, lambda t: covered(t) <= COVERED))


def two_pass_tokens(first: Column, second: Column) -> Column:
    """Tokens of a plain pass and an enlarged one, which is read more leniently and rescues credentials."""
    lenient = max(0.0, MIN_CONFIDENCE - SECOND_PASS_LESS)
    return merge_tokens(ocr_tokens(first), ocr_tokens(second, lenient, ENLARGED, rescue=True))


def read_images(df: DataFrame, ocr: Callable[[np.ndarray, float], list[dict]] | None) -> DataFrame:
    """df with ``ocr``, the tokens read from its images in two passes, and ``ocr_status``; columns of these names are replaced.

    df: height, width int, data binary (RGB, row by row). ocr reads an image and is told the scale by which to enlarge it; it returns words
    (text, conf, left, top, width, height) in the enlarged image. ocr_status is ``read``, ``partly read`` where the second pass failed (the
    tokens of the first stay), ``failed`` where the first did, ``unavailable`` without a reader, and null without an image, which null
    data is, or data of another size than stated. Tokens are null without an image and else empty where nothing was read; a reader that
    fails on one image leaves the others as they are.
    """
    words = "array<struct<text:string,conf:string,left:double,top:double,width:double,height:double>>"

    def one(height: float, width: float, data: bytes | None) -> tuple:
        if data is None:
            return None, None, None
        if ocr is None:
            return [], [], "unavailable"
        image, passes = np.frombuffer(data, np.uint8).reshape(int(height), int(width), 3), []
        try:
            for scale in (1.0, ENLARGED):
                passes.append([w | {"conf": str(w["conf"])} for w in ocr(image, scale)])
        except Exception:  # what the caller's reader raises is its own; the row says that it did
            return (passes or [[]])[0], [], "partly read" if passes else "failed"
        return *passes, "read"

    def run(height: pd.Series, width: pd.Series, data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(*row) for row in zip(height, width, data, strict=True)], columns=["first", "second", "status"])

    # opaque to the optimizer, which might otherwise read an image once for each use of its words
    seen = F.pandas_udf(run, f"first {words}, second {words}, status string").asNondeterministic()
    whole = F.coalesce(F.length("data") == F.col("height").cast("long") * F.col("width") * 3, F.lit(False))
    read = df.withColumn("_words", seen("height", "width", F.when(whole, F.col("data"))))
    tokens = F.when(F.col("_words.status").isNotNull(), two_pass_tokens(F.col("_words.first"), F.col("_words.second")))
    return read.withColumns({"ocr": tokens, "ocr_status": F.col("_words.status")}).drop("_words")


def scan_input(tokens: Column, ocr: Column, text: Column) -> tuple[Column, Column]:
    """What is scanned, of which only one is used: tokens given, else those of the image, be there any or not, else the text. Returns (tokens, text)."""
    given, read = F.coalesce(F.size(tokens) > 0, F.lit(False)), ocr.isNotNull()
    return F.when(given, tokens).when(read, ocr), F.when(~given & ~read, text)
