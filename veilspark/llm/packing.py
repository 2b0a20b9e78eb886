"""Packing of token sequences: first-fit decreasing with a tournament tree of bin capacities, in random groups of documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable
from .tokens import byte_bpe

#: Remainder pieces that a group holds on average; bounds a task's memory and sets how much padding is left.
GROUP_PIECES = 4096

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, full_at long"
_PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class BinTree:
    """A tournament tree over bins in opening order; each inner node keeps the largest free room below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [0] * self.leaves + [capacity] * bins + [0] * (self.leaves - bins)
        for i in range(self.leaves - 1, 0, -1):
            self.room[i] = max(self.room[2 * i], self.room[2 * i + 1])

    def put(self, length: int) -> tuple[int, int]:
        """Put a piece into the first bin with room; the bin and the room it had before."""
        room, i = self.room, 1
        while i < self.leaves:
            i *= 2
            if room[i] < length:
                i += 1
        had = room[i]
        room[i] = had - length
        bin_ = i - self.leaves
        while i > 1:
            i //= 2
            top = max(room[2 * i], room[2 * i + 1])
            if room[i] == top:
                break
            room[i] = top
        return bin_, had


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; ties in length keep their order. Bins are numbered from 0 without gaps."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree = BinTree(max(1, len(lengths)), capacity)
    for i in np.argsort(-lengths, kind="stable").tolist():
        bin_, had = tree.put(int(lengths[i]))
        bins[i], offsets[i] = bin_, capacity - had
    return bins, offsets


def _cut(path: str, capacity: int, end_id: int):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, full = byte_bpe(path), 0
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), strict=True):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    whole = len(piece) == capacity
                    rows.append((doc, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), full if whole else -1))
                    full += whole
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "full_at"])
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    return cut


def _pack(capacity: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("piece", kind="stable")
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), capacity)
        out = pdf[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]]
        return out.assign(doc_id=out["doc_id"].astype("Int64"), sequence_id=2 * ((pdf["group"].to_numpy() << 24) + bins), offset=offsets)

    return pack


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    A document is its BPE ids and then ``end_id``; a null text is an empty one. It is cut into full pieces, each of which is a
    sequence, and one shorter piece. Shorter pieces go to random groups of about ``GROUP_PIECES``, and each group is packed
    by first-fit decreasing alone, so no task grows with the input. The group is drawn from the piece's stored place, not
    from its document, so rows that repeat a doc_id spread as well. Of equal lengths the piece stored first is put first.

    Returns per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``. sequence_id is even for packed
    sequences (group, bin) and odd for full pieces (partition, count). An empty table gives no rows.
    """
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_cut(tokenizer_path, capacity, end_id), _PIECES)
    pieces = durable(cut.withColumn("part", F.spark_partition_id())).withColumn("piece", F.monotonically_increasing_id())
    short = pieces.where("full_at < 0")
    groups = max(1, -(-short.count() // GROUP_PIECES))
    placed = short.withColumn("group", F.pmod(F.xxhash64("piece"), F.lit(groups))).groupBy("group").applyInPandas(_pack(capacity), _PLACED)
    full = pieces.where("full_at >= 0").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.shiftleft(F.col("part").cast("long"), 34) + F.col("full_at") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return placed.unionByName(full)
