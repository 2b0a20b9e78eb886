"""The corpus pipeline: quality rules, exact and near deduplication, removal of personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. ``docs`` has the columns of documents,
doc_id, text, lang, source, n_chars and any others, and all stages but the last return them; the last returns the packed pieces.

What holds for every stage: an empty table gives no rows; nulls in any column are allowed, and a null text is read as an empty one; texts
are read whole, however long; other columns are carried along whatever their names, but for ``_veilspark_row``; rows that repeat are
rows of their own. What a stage does with such rows is said at the stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import exact_dedup, near_dedup, packing, pii, quality
from veilspark.llm.common import ROW, keyed, stored, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _only(rows: DataFrame, stay: DataFrame, columns: list[str]) -> DataFrame:
    """The rows whose key is in ``stay``."""
    return rows.join(stay.select(ROW), ROW, "left_semi").select(*[F.col(f"`{c}`") for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the base rule or a risk-controlled rule of its language rejects.

    Null, empty and short texts fail the base rule. Repeated rows have the same verdict; labels of a repeated or null id count as
    ``quality.judge`` says; a null language is a stratum of its own; without labels the base rule alone decides.
    """
    rows = keyed(docs)
    verdict = quality.judge(rows, table(spark, sf_dir, "labels"), keep=(ROW,))
    return _only(rows, verdict.where("kept"), docs.columns)


def exact_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of equal texts; half of the ids stand for batches that are indexed already.

    The largest doc_id stays, a null one is smaller than any other, and of rows that repeat it one stays. Null and empty texts
    are one group.
    """
    rows = keyed(docs)
    groups = exact_dedup.exact_groups(rows, F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0, keep=(ROW,))
    return _only(rows, groups.where("kept"), docs.columns)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by similar sets of five-word shingles.

    The smallest doc_id stays, a null one only where all are null, and of rows that repeat it one stays. Null texts and texts
    without words are linked with nothing and stay.
    """
    rows = keyed(docs)
    groups = near_dedup.near_groups(rows, width=5, percent=80, key=ROW)
    return _only(rows, groups.where("stays").withColumnRenamed("_row", ROW), docs.columns)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every span of personal data by its kind; n_chars follows the text, and is null for a null text, which stays null."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences of 2048 tokens. A null or empty text is a document of the end id alone; ids may repeat or be null."""
    return packing.pack_documents(docs, TOKENIZER, capacity=2048, end_id=1)


STAGES = [
    ("quality rules", quality_rules),
    ("exact deduplication", exact_deduplication),
    ("near deduplication", near_deduplication),
    ("personal data", remove_personal_data),
    ("packing", pack),
]

#: No SQL: binomial cutoffs, similarity components and BPE ids are held against brute force in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each result is written as Parquet to the shared folder and read again by the next stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
