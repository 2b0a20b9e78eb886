"""Token-count rollups kept up to date by signed deltas, committed batch by batch and at most once."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import byte_bpe

KEYS = ("source", "lang", "tokenizer_version")
TOTALS = ("n_docs", "n_tokens", "n_bytes")


def count_tokens(docs: DataFrame, tokenizer_path: str, version: str) -> DataFrame:
    """Count the BPE ids of every whole text: ``doc_id, source, lang, tokenizer_version, n_tokens, n_bytes``.

    Null and empty texts count 0. Repeated rows are counted each; null ids, sources and languages stay null; other columns are
    ignored; an empty table gives no rows.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = byte_bpe(tokenizer_path)
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            yield pdf[["doc_id", "source", "lang"]].assign(n_tokens=[len(encode(t)) for t in texts], n_bytes=[len(t.encode()) for t in texts])

    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text")
    counted = cut.mapInPandas(count, "doc_id long, source string, lang string, n_tokens long, n_bytes long")
    return counted.select("doc_id", "source", "lang", F.lit(version).alias("tokenizer_version"), "n_tokens", "n_bytes")


def inserts(counts: DataFrame) -> DataFrame:
    """Changes that add each counted document once."""
    return counts.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), "n_tokens", "n_bytes")


def deletes(counts: DataFrame) -> DataFrame:
    """Changes that take back what ``inserts`` added for the same rows."""
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"), (-F.col("n_bytes")).alias("n_bytes"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes that replace the counts of documents by revised ones, also across keys."""
    return deletes(old).unionByName(inserts(new))


class Rollup:
    """Additive totals by source, language and tokenizer version in a folder that all executors share.

    Each batch becomes one file set ``batch=<id>`` of summed deltas. Every attempt writes to a folder of its own and renames it into
    place, which only one attempt can do, so a batch exists whole or not at all; a batch id that exists is not applied again, which
    makes replays and rival committers harmless, and a write that died is simply repeated. Totals are sums: order does not matter.
    ``fold`` sums what is there into a snapshot, after which totals read the snapshot and the batches since. Null sources and
    languages are groups of their own; keys whose documents are all gone vanish from ``totals``; without batches there are none.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("_").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, prefix: str) -> list[str]:
        fs, root = self._fs(), self._path("_").getParent()
        found = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(n.removeprefix(prefix) for n in found if n.startswith(prefix))

    def _publish(self, rows: DataFrame, name: str) -> bool:
        """Write rows and give them their name; false, and no trace of them, if another attempt has given it first."""
        fs, staged = self._fs(), f"_staged/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{staged}")
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        only_new = gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
        only_new[0] = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").NONE
        target = self._path(name)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(self._path(staged), target, only_new)
        except (Py4JJavaError, PySparkException):
            fs.delete(self._path(staged), True)
            if not fs.exists(target):
                raise
            return False
        return True

    def committed(self, batch_id: str) -> bool:
        return self._fs().exists(self._path(f"batch={batch_id}"))

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Commit a batch of changes; false if it was committed before or by another committer meanwhile."""
        if self.committed(batch_id):
            return False
        return self._publish(changes.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in TOTALS]), f"batch={batch_id}")

    def _state(self) -> tuple[DataFrame, set[str]]:
        """The sums up to now, zeros too, and the batches in them."""
        shape = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long, n_bytes long"
        batches, snapshots = set(self._names("batch=")), self._names("snapshot=")
        parts, tail = [self.spark.createDataFrame([], shape)], batches
        if snapshots:
            held = self.spark.read.parquet(f"{self.folder}/snapshot={snapshots[-1]}")
            tail = batches - {r[0] for r in held.where("batch IS NOT NULL").select("batch").collect()}
            parts.append(held.where("batch IS NULL").drop("batch"))
        if tail:
            parts.append(self.spark.read.schema(shape).parquet(*[f"{self.folder}/batch={b}" for b in sorted(tail)]))
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in TOTALS]), batches

    def fold(self) -> bool:
        """Sum all batches into a new snapshot, which also lists them; false if another one folded meanwhile."""
        sums, batches = self._state()
        listed = self.spark.createDataFrame([(b,) for b in sorted(batches)], "batch string")
        rows = sums.withColumn("batch", F.lit(None).cast("string")).unionByName(listed, allowMissingColumns=True)
        return self._publish(rows, f"snapshot={len(self._names('snapshot=')):08d}")

    def totals(self) -> DataFrame:
        return self._state()[0].where("n_docs <> 0 OR n_tokens <> 0 OR n_bytes <> 0")

    def remove(self) -> None:
        self._fs().delete(self._path("_").getParent(), True)
