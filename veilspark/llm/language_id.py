"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter has slices over the same positions: a probe reads the words at an n-gram's positions, ANDs them and so gets
all languages that contain the n-gram at once. Every language has two slices: one for all n-grams it contains, however rare, and one for
those typical of it, the most used ones that make up all but ``TAIL`` of its own uses; what other languages use does not matter. A
text's language is the one with the largest part of the text's n-grams, the mean of both slices, after each count is corrected by the
false-positive rate of its slice.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

#: Positions of the filter at least, for each n-gram of the language with most of them, and probes per n-gram.
POSITIONS, SPACE, PROBES = 1 << 20, 8, 4
#: Bytes that the filter is broadcast with at most. Beyond, it has fewer positions: no n-gram stays out, false positives grow, and the
#: counts are corrected for them.
FILTER_BYTES = 256 << 20
#: Cells of the filter that one task builds.
BLOCK = 1 << 16
#: The part of a language's uses of n-grams that is not typical of it: foreign words, names and slips.
TAIL = 0.02
#: Characters that are turned into arrays at once.
CHUNK = 1 << 20

_SPACE = 32


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter trigrams of lower-cased texts with word edges as a space: (text number, packed code points), in order."""
    codes = np.frombuffer("\n".join(["", *texts, ""]).lower().encode("utf-32-le"), np.uint32)
    return _grams(codes, len(texts))


def _grams(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    owner = np.cumsum(codes == 10) - 1
    letter = _letters()[codes]
    stay = letter | np.r_[True, letter[:-1]]
    codes, owner, letter = np.where(letter, codes, _SPACE)[stay].astype(np.int64), owner[stay], letter[stay]
    if len(codes) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    good = letter[1:-1]
    packed = (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]
    return owner[1:-1][good], packed[good]


def _chunks(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Runs of rows of about ``CHUNK`` characters."""
    size = pdf["text"].str.len().fillna(0).to_numpy()
    run = (np.cumsum(size) // CHUNK).astype(np.int64)
    for _, part in pdf.groupby(run, sort=False):
        yield part


def _plain(texts: pd.Series) -> list[str]:
    """Line ends separate texts in ``grams``, so they become spaces here."""
    return [(t or "").replace("\n", " ") for t in texts]


def count_grams(docs: DataFrame) -> DataFrame:
    """``lang, gram, n`` over all texts with a language; partial counts leave a task, bounded in number."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def out() -> Iterator[pd.DataFrame]:
            for lang, (g, n) in held.items():
                yield pd.DataFrame({"lang": lang, "gram": g, "n": n})
            held.clear()

        for pdf in batches:
            for part in _chunks(pdf):
                for lang, own in part.groupby("lang", sort=False):
                    g, n = np.unique(grams(_plain(own["text"]))[1], return_counts=True)
                    if lang in held:
                        both, where = np.unique(np.r_[held[lang][0], g], return_inverse=True)
                        g, n = both, np.bincount(where, weights=np.r_[held[lang][1], n]).astype(np.int64)
                    held[lang] = g, n
            if sum(len(g) for g, _ in held.values()) > 1_000_000:
                yield from out()
        yield from out()

    partial = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInPandas(count, "lang string, gram long, n long")
    return partial.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _positions(gram: np.ndarray, positions: int) -> Iterator[np.ndarray]:
    x = gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    a, b = x >> np.uint64(32), (x & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    for i in range(PROBES):
        yield ((a + np.uint64(i) * b) % np.uint64(positions)).astype(np.int64)


def cells(slices: np.ndarray, gram: np.ndarray, positions: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells, ``position * words + word``, and the bits in them that each gram sets in its slice."""
    bits = np.uint64(1) << (slices % 64).astype(np.uint64)
    return np.concatenate([at * words + slices // 64 for at in _positions(gram, positions)]), np.tile(bits, PROBES)


class LanguageFilter:
    """The bit-sliced filter: ``table[position, word]`` has bit s of word w set when slice 64 w + s has a gram there.

    Slice l tells what language l contains, slice ``len(langs) + l`` what is typical of it. The filter is sized for ``most`` grams of one
    language, within ``FILTER_BYTES``; words are as wide as the slices need.
    """

    def __init__(self, langs: list[str], usual: int, most: int):
        self.langs, self.usual = langs, usual
        width = next((t for t in (np.uint8, np.uint16, np.uint32) if 2 * len(langs) <= t(0).itemsize * 8), np.uint64)
        words = -(-2 * len(langs) // 64)
        positions = max(POSITIONS, 1 << (SPACE * most - 1).bit_length())
        while positions > 1 and positions * words * width(0).itemsize > FILTER_BYTES:
            positions //= 2
        self.table = np.zeros((positions, words), width)

    def fill(self, first: int, block: bytes) -> None:
        """Put a built block of cells in its place."""
        part = np.frombuffer(block, self.table.dtype)
        self.table.reshape(-1)[first : first + len(part)] = part
        self.__dict__.pop("false_rate", None)

    def add(self, slices: np.ndarray, gram: np.ndarray) -> None:
        at, bits = cells(slices, gram, *self.table.shape)
        np.bitwise_or.at(self.table.reshape(-1), at, bits.astype(self.table.dtype))
        self.__dict__.pop("false_rate", None)

    @functools.cached_property
    def false_rate(self) -> np.ndarray:
        """The part of foreign grams that each slice says it has."""
        return np.array([np.count_nonzero(self.table[:, i // 64] & self.table.dtype.type(1 << i % 64)) / len(self.table) for i in range(2 * len(self.langs))]) ** PROBES

    def masks(self, gram: np.ndarray) -> np.ndarray:
        """The slices containing each gram, as bit masks."""
        return functools.reduce(np.bitwise_and, (self.table[at] for at in _positions(gram, len(self.table))))

    def decide(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; the score is the winner's part of all corrected shares."""
        owner, gram = grams(texts)
        mask, n = self.masks(gram), np.bincount(owner, minlength=len(texts))[: len(texts)]
        bit = lambda i: (mask[:, i // 64] >> self.table.dtype.type(i % 64)) & self.table.dtype.type(1)
        hits = np.stack([np.bincount(owner, weights=bit(i), minlength=len(texts))[: len(texts)] for i in range(2 * len(self.langs))], axis=1)
        shares = np.clip((hits / np.maximum(n, 1)[:, None] - self.false_rate) / np.maximum(1 - self.false_rate, 1e-9), 0, 1)
        share = (shares[:, : len(self.langs)] + shares[:, len(self.langs) :]) / 2
        total = share.sum(axis=1)
        best = np.where(total > 0, share.argmax(axis=1), self.usual)
        score = np.where(total > 0, share.max(axis=1) / np.maximum(total, 1e-300), 0.0)
        return [self.langs[i] if k else "und" for i, k in zip(best, n, strict=True)], np.where(n > 0, score, 0.0)


def held_out(doc_id: Column) -> Column:
    """True for a third of the ids, by their checksum; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def typical(counts: DataFrame) -> dict[str, int]:
    """For every language how often a gram is used at least that is typical of it, from ``lang, gram, n``.

    The bound is found on how many grams have each count, a small table by language, so no language's grams meet in one task.
    Grams used equally often are all typical or all not.
    """
    masses = counts.groupBy("lang", "n").agg(F.sum("n").alias("mass"))
    rarer = Window.partitionBy("lang").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("lang")
    kept = masses.select("lang", "n", (F.sum("mass").over(rarer) > TAIL * F.sum("mass").over(whole)).alias("kept")).where("kept")
    return {r["lang"]: r["n"] for r in kept.groupBy("lang").agg(F.min("n").alias("n")).collect()}


def train(docs: DataFrame) -> LanguageFilter | None:
    """Learn from every text with a language. The filter holds every gram of every language.

    Tasks set the bits, which are merged by cell and packed into blocks of ``BLOCK`` cells; the driver sees a row by language and the
    blocks, at most ``FILTER_BYTES`` in all.
    """
    counts = durable(count_grams(docs))
    totals = {r["lang"]: (r["n"], r["grams"]) for r in counts.groupBy("lang").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("grams")).collect()}
    if not totals:
        return None
    langs, least = sorted(totals), typical(counts)
    number = {lang: i for i, lang in enumerate(langs)}
    model = LanguageFilter(langs, number[max(langs, key=lambda x: (totals[x][0], x))], max(n for _, n in totals.values()))
    (positions, words), kind, n_langs = model.table.shape, model.table.dtype, len(langs)

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own, gram = pdf["lang"].map(number).to_numpy(np.int64), pdf["gram"].to_numpy(np.int64)
            usual = pdf["n"].to_numpy() >= pdf["lang"].map(least).to_numpy()
            at, bits = cells(np.r_[own, own[usual] + n_langs], np.r_[gram, gram[usual]], positions, words)
            yield pd.DataFrame({"cell": at, "bits": bits.view(np.int64)})

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        first = int(part["block"].iloc[0]) * BLOCK
        block = np.zeros(min(BLOCK, positions * words - first), kind)
        block[part["cell"].to_numpy() - first] = part["bits"].to_numpy(np.int64).view(np.uint64).astype(kind)
        return pd.DataFrame({"first": [first], "cells": [block.tobytes()]})

    marked = counts.mapInPandas(mark, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits"))
    blocks = marked.withColumn("block", F.expr(f"cell div {BLOCK}")).groupBy("block").applyInPandas(pack, "first long, cells binary")
    for r in durable(blocks).toLocalIterator():
        model.fill(r["first"], r["cells"])
    model.false_rate  # noqa: B018  # counted once, here, and sent along
    return model


def identify(docs: DataFrame) -> DataFrame:
    """Predict the language of every whole text: ``doc_id, held_out, lang_pred, score``.

    Learns from text and non-null lang of the documents that are not held out (nor without id); a prediction reads the text
    alone. Null texts, texts without a letter, and all texts where nothing could be learned are "und" with score 0. A text
    none of whose n-grams is known gets the most used language and score 0. Ties go to the language that sorts first. Repeated rows
    count as often as they occur and each get a prediction; other columns are ignored; an empty table gives no rows. Long texts are
    read whole, in runs of about ``CHUNK`` characters.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    model = train(rows.where("doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for pdf in batches:
            for part in _chunks(pdf):
                langs, scores = model.decide(_plain(part["text"])) if model else (["und"] * len(part), np.zeros(len(part)))
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "held_out": part["held_out"], "lang_pred": langs, "score": scores})

    return rows.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInPandas(predict, "doc_id long, held_out boolean, lang_pred string, score double")
