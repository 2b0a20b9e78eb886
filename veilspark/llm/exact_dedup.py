"""Exact deduplication through a minimal perfect hash over the distinct digests of earlier batches.

The index is cut into small buckets by digest prefix. A bucket is one row: the levels of its minimal perfect hash and, per
slot, the full 32-byte digest, the locator of the group's winner (document id and row id) and the group's size. A lookup
computes the slot, then compares all 32 bytes; only a byte-equal hit is a member. Digests that are no members form groups of
their own. Both sides are grouped by digest before they meet, so a text that fills a third of the table is one row there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, join_counted, numbered

#: Digests expected in a bucket of the index; bounds the memory of a build and of a lookup.
BUCKET_DIGESTS = 4096
#: Bits per remaining key in each level of the hash.
GAMMA = 2.0
#: Levels tried before the rest goes into a sorted list.
MAX_LEVELS = 48

_INDEX = "bucket long, sizes binary, bits binary, rest binary, digests binary, ids binary, id_null binary, rows binary, counts binary"
_GROUPS = "digest binary, member boolean, slot long, keep_id long, keep_row long, group_size long"


def _words(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw = np.ascontiguousarray(digests).view(np.uint64).reshape(len(digests), 4)
    return raw[:, 0] ^ raw[:, 2], raw[:, 1] | np.uint64(1)


def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    x = a + b * np.uint64(2 * level + 1)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash of distinct 32-byte digests: slots are 0 to n - 1."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.ranks = np.concatenate([[0], np.cumsum(bits)])

    @classmethod
    def build(cls, digests: np.ndarray) -> PerfectHash:
        left, sizes, bits = np.arange(len(digests)), [], []
        a, b = _words(digests)
        for level in range(MAX_LEVELS):
            if not len(left):
                break
            size = int(GAMMA * len(left)) + 1
            at = _place(a[left], b[left], level, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            left = left[~alone[at]]
        rest = np.sort(digests[left].view("S32").ravel()) if len(left) else np.empty(0, "S32")
        return cls(np.array(sizes, np.int64), np.concatenate(bits) if bits else np.empty(0, bool), rest)

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 where it surely is no key; a nonmember can get a member's slot."""
        out, left = np.full(len(digests), -1, np.int64), np.arange(len(digests))
        a, b = _words(digests)
        for level, size in enumerate(self.sizes):
            at = self.starts[level] + _place(a[left], b[left], level, int(size))
            hit = self.bits[at]
            out[left[hit]] = self.ranks[at[hit]]
            left = left[~hit]
        if len(self.rest) and len(left):
            keys = digests[left].view("S32").ravel()
            at = np.minimum(np.searchsorted(self.rest, keys), len(self.rest) - 1)
            hit = self.rest[at] == keys
            out[left[hit]] = self.ranks[-1] + at[hit]
        return out


def _matrix(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, digests)), np.uint8).reshape(-1, 32)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    digests = _matrix(pdf["digest"])
    mph = PerfectHash.build(digests)
    order = np.argsort(mph.slots(digests))
    ids = pdf["keep_id"]
    return pd.DataFrame(
        {
            "bucket": [int(pdf["bucket"].iloc[0])],
            "sizes": [mph.sizes.tobytes()],
            "bits": [np.packbits(mph.bits).tobytes()],
            "rest": [mph.rest.astype("S32").tobytes()],
            "digests": [digests[order].tobytes()],
            "ids": [ids.fillna(0).astype("int64").to_numpy()[order].tobytes()],
            "id_null": [ids.isna().to_numpy()[order].tobytes()],
            "rows": [pdf["keep_row"].to_numpy("int64")[order].tobytes()],
            "counts": [pdf["group_size"].to_numpy("int64")[order].tobytes()],
        }
    )


def _open(row: pd.Series) -> tuple[PerfectHash, np.ndarray, pd.DataFrame]:
    sizes = np.frombuffer(row["sizes"], np.int64)
    bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8))[: int(sizes.sum())].astype(bool)
    rest = np.frombuffer(row["rest"], "S32")
    digests = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
    ids = pd.Series(np.frombuffer(row["ids"], np.int64)).astype("Int64").mask(np.frombuffer(row["id_null"], bool))
    slots = pd.DataFrame({"keep_id": ids, "keep_row": np.frombuffer(row["rows"], np.int64), "group_size": np.frombuffer(row["counts"], np.int64)})
    return PerfectHash(sizes, bits, rest), digests, slots


def _lookup(index: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
    """Every group of a bucket: those in the index, with what the batch adds, then the batch's nonmembers."""
    out = []
    new = batch.assign(keep_id=batch["keep_id"].astype("Int64")) if len(batch) else batch
    member = np.zeros(len(new), bool)
    if len(index):
        mph, digests, slots = _open(index.iloc[0])
        if len(new):
            wanted = _matrix(new["digest"])
            slot = mph.slots(wanted)
            member = slot >= 0
            member[member] = (digests[slot[member]] == wanted[member]).all(axis=1)
            at, add = slot[member], new[member]
            size = slots["group_size"].to_numpy().copy()
            size[at] += add["group_size"].to_numpy("int64")
            old_id, old_row = slots["keep_id"].iloc[at].fillna(-(2**63)).to_numpy("int64"), slots["keep_row"].to_numpy()[at]
            new_id, new_row = add["keep_id"].fillna(-(2**63)).to_numpy("int64"), add["keep_row"].to_numpy("int64")
            wins = (new_id > old_id) | ((new_id == old_id) & (new_row > old_row))
            ids, rows = slots["keep_id"].copy(), slots["keep_row"].to_numpy().copy()
            ids.iloc[at[wins]] = add["keep_id"].to_numpy()[wins]
            rows[at[wins]] = new_row[wins]
            slots = pd.DataFrame({"keep_id": ids, "keep_row": rows, "group_size": size})
        out.append(slots.assign(digest=[d.tobytes() for d in digests], member=True, slot=np.arange(len(slots))))
    if len(new) and not member.all():
        out.append(new[~member].assign(member=False, slot=-1))
    columns = ["digest", "member", "slot", "keep_id", "keep_row", "group_size"]
    return pd.concat(out)[columns] if out else pd.DataFrame(columns=columns)


def digests(docs: DataFrame, history: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """A checkpointed row per document: ``doc_id, _row, digest`` (SHA-256 of the whole text, null read as empty), ``_old``, and ``keep``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return numbered(durable(docs.select(*keep, F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.coalesce(history, F.lit(False)).alias("_old"))))


def _grouped(rows: DataFrame, buckets: int) -> DataFrame:
    best = F.max(F.struct("doc_id", "_row"))
    groups = rows.groupBy("digest").agg(best.alias("_best"), F.count(F.lit(1)).alias("group_size"))
    prefix = F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long")
    return groups.select("digest", F.col("_best.doc_id").alias("keep_id"), F.col("_best._row").alias("keep_row"), "group_size", (prefix % buckets).alias("bucket"))


def build_index(rows: DataFrame, buckets: int) -> DataFrame:
    """The index of the distinct digests of ``rows`` (see ``digests``), one row per bucket."""
    return _grouped(rows, buckets).groupBy("bucket").applyInPandas(_build, _INDEX)


def exact_groups(docs: DataFrame, history: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Find groups of equal texts.

    docs: has doc_id and text; other columns are ignored. history: boolean Column, true for rows of earlier batches, over
    which the perfect hash is built; the others are looked up in it. keep: columns of docs to carry along.

    Returns one row per row of docs: ``keep`` and ``doc_id, keep_id, group_size, kept, text_sha256, in_history``. The row with
    the largest doc_id stays (a null doc_id is smaller than any other; of rows that repeat it the last stored one stays).
    Null text counts as empty; an empty table gives no rows.
    """
    rows = digests(docs, history, keep)
    buckets = max(1, -(-rows.count() // BUCKET_DIGESTS))
    index = build_index(rows.where("_old"), buckets)
    groups = index.groupBy("bucket").cogroup(_grouped(rows.where("NOT _old"), buckets).groupBy("bucket")).applyInPandas(_lookup, _GROUPS)
    joined = join_counted(rows, durable(groups), "digest", "group_size")
    return joined.select(
        *keep,
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("_row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.col("member").alias("in_history"),
    )
