"""SentencePiece encoding and decoding with a batched numpy Viterbi.

Words of equal length form a matrix of code points and advance together, one position at a time. Prefix hashes give the hash
of any substring, which is looked up among the sorted keys of the pieces; the best predecessor of every position is kept as a
backpointer. For a unigram model the best path has the largest sum of scores. For a BPE model sums of scores are not what
the library's merges produce, so a path there may only join neighbours that merging keeps apart: a sequence of pieces is the
BPE result exactly when each neighbouring pair is (van Antwerpen and Neubeck), which leaves one path.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The mark that stands for a space (U+2581).
MARK = "▁"
#: Words up to this length advance in batches; longer ones, and lengths with few words, go one by one.
BATCH_LENGTH, BATCH_WORDS = 40, 8
#: Words remembered by a Python worker; characters whose words are encoded at once.
KNOWN_WORDS, RUN = 1_500_000, 8_000_000
#: Size of the table of decided pairs, as a power of two.
PAIR_BITS = 22

_BASE = 0x9E3779B97F4A7C15 | 1
_START, _UNKNOWN = -2, -1


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a protocol-buffer message: number and value."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, raw[at : at + size]
            at += size


class Pieces:
    """A model's pieces: vocabulary, scores, bytes for decoding, and whether it is a BPE model."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: dict[int, int], unknown: int, plain: list[bool], bpe: bool, dummy_prefix: bool = True):
        self.vocab = {p: i for i, p in enumerate(pieces) if plain[i]}
        self.scores, self.byte_ids, self.unknown, self.bpe, self.dummy_prefix = np.array(scores), byte_ids, unknown, bpe, dummy_prefix
        self.pieces, self.score_of = pieces, {p: float(scores[i]) for p, i in self.vocab.items()}
        self.longest = max(map(len, self.vocab), default=1)
        self.unknown_score = min((scores[i] for i in self.vocab.values()), default=0.0) - 10.0
        self.bytes = [p.replace(MARK, " ").encode() if plain[i] else b"" for i, p in enumerate(pieces)]
        for byte, i in byte_ids.items():
            self.bytes[i] = bytes([byte])
        self.bytes[unknown] = b" \xe2\x81\x87 "
        inside = any(MARK in p.lstrip(MARK) for p in self.vocab)
        self.words = re.compile(".+" if inside else f"{MARK}*[^{MARK}]+|{MARK}+", re.S)
        keys = np.array([self._hash(p) for p in self.vocab], np.uint64)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.array(list(self.vocab.values()), np.int64)[order]
        self.powers = np.array([pow(_BASE, n, 1 << 64) for n in range(self.longest + 1)], np.uint64)
        self.present = np.zeros(1 << 20, bool)
        self.present[(keys & np.uint64(0xFFFFF)).astype(np.int64)] = True
        self.pairs = np.full(1 << PAIR_BITS, -2, np.int64)
        self.asked: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str) -> Pieces:
        """Read a model file; its normalizer must be the identity."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            parts = dict(x for x in _fields(f.read()) if x[0] != 1)
        trainer, normalizer = dict(_fields(parts.get(2, b""))), dict(_fields(parts.get(3, b"")))
        if normalizer.get(2) or normalizer.get(4, 1):
            raise ValueError("only models with the identity normalizer that keep all white space")
        ids = range(sp.get_piece_size())
        byte_ids = {int(sp.id_to_piece(i)[3:5], 16): i for i in ids if sp.is_byte(i)}
        plain = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in ids]
        return cls([sp.id_to_piece(i) for i in ids], [sp.get_score(i) for i in ids], byte_ids, sp.unk_id(), plain, trainer.get(3, 1) == 2, bool(normalizer.get(3, 1)))

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * _BASE + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def merged(self, text: str) -> list[str]:
        """Merge neighbours by the best piece score, leftmost first."""
        parts, score = list(text), self.score_of.get
        pairs = [score(a + b, -np.inf) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (best := max(pairs)) > -np.inf:
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = score(parts[i - 1] + parts[i], -np.inf)
            if i < len(pairs):
                pairs[i] = score(parts[i] + parts[i + 1], -np.inf)
        return parts

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether merging the text of two pieces gives these two; at a word's start, whether it gives the piece itself."""
        if right == _UNKNOWN or (left == _UNKNOWN and len(self.pieces[right]) == 1):
            return True
        if left == _UNKNOWN:
            left = _START
        parts = [self.pieces[right]] if left == _START else [self.pieces[left], self.pieces[right]]
        return self.merged("".join(parts)) == parts

    def _alone(self, word: str) -> list[int]:
        """Viterbi for one word."""
        n, asked = len(word), self.asked
        if len(asked) > KNOWN_WORDS:
            asked.clear()
        best, back, last = [0.0] + [-np.inf] * n, [0] * (n + 1), [_START] + [_UNKNOWN] * n
        for j in range(1, n + 1):
            for i in range(max(0, j - self.longest), j):
                if best[i] == -np.inf:
                    continue
                piece = self.vocab.get(word[i:j], _UNKNOWN)
                if piece == _UNKNOWN and j - i > 1:
                    continue
                if self.bpe:
                    pair = last[i], piece
                    if pair not in asked:
                        asked[pair] = self.stay_apart(*pair)
                    if asked[pair]:
                        best[j], back[j], last[j] = 0.0, i, piece
                else:
                    score = best[i] + (self.unknown_score if piece == _UNKNOWN else self.scores[piece])
                    if score > best[j]:
                        best[j], back[j], last[j] = score, i, piece
        path, j = [], n
        while j:
            path.append(self._ids(last[j], word[back[j] : j]))
            j = back[j]
        return [i for ids in reversed(path) for i in ids]

    def _ids(self, piece: int, text: str) -> list[int]:
        if piece != _UNKNOWN:
            return [piece]
        return [self.byte_ids[b] for b in text.encode()] if self.byte_ids else [self.unknown]

    def _together(self, words: list[str]) -> list[list[int]]:
        """Viterbi for words of one length."""
        m, n = len(words), len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(m, n).astype(np.uint64) + np.uint64(1)
        h = np.zeros((n + 1, m), np.uint64)
        for j in range(n):
            h[j + 1] = h[j] * np.uint64(_BASE) + codes[:, j]
        best = np.full((n + 1, m), -np.inf)
        back, last = np.zeros((n + 1, m), np.int64), np.full((n + 1, m), _UNKNOWN, np.int64)
        best[0], last[0] = 0.0, _START
        for j in range(1, n + 1):
            starts = range(max(0, j - self.longest), j)
            piece = self._looked_up((h[j] - h[starts[0] : j] * self.powers[j - starts[0] : 0 : -1, None]).ravel()).reshape(len(starts), m)
            can = (best[starts[0] : j] > -np.inf) & (piece != _UNKNOWN)
            can[-1] = best[j - 1] > -np.inf  # a single character may be unknown
            at, rows = np.nonzero(can)
            piece, start = piece[at, rows], at + starts[0]
            if self.bpe:
                good = self._apart(last[start, rows], piece)
                rows, piece, start = rows[good], piece[good], start[good]
                best[j, rows], back[j, rows], last[j, rows] = 0.0, start, piece
            else:
                score = np.full(can.shape, -np.inf)
                score[at, rows] = best[start, rows] + np.where(piece == _UNKNOWN, self.unknown_score, self.scores[piece])
                top, every = score.argmax(axis=0), np.arange(m)
                best[j], back[j] = score[top, every], top + starts[0]
                by = np.full(can.shape, _UNKNOWN, np.int64)
                by[at, rows] = piece
                last[j] = by[top, every]
        out, back, last, vocab = [], back.T.tolist(), last.T.tolist(), self.vocab
        for word, came, by in zip(words, back, last, strict=True):
            path, j, true = [], n, True
            while j:
                i, p = came[j], by[j]
                if p >= 0:
                    path.append((p,))
                    true = true and vocab.get(word[i:j]) == p  # a hash that lies is found here
                else:
                    path.append(self._ids(p, word[i:j]))
                j = i
            out.append([x for ids in reversed(path) for x in ids] if true else self._alone(word))
        return out

    def _looked_up(self, key: np.ndarray) -> np.ndarray:
        """The piece of each substring hash: a table of the hashes' low bits tells most misses before the sorted keys are searched."""
        piece = np.full(len(key), _UNKNOWN, np.int64)
        maybe = np.flatnonzero(self.present[(key & np.uint64(0xFFFFF)).astype(np.int64)])
        if len(maybe):
            wanted = key[maybe]
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            hit = self.keys[at] == wanted
            piece[maybe[hit]] = self.key_ids[at[hit]]
        return piece

    def _apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which pairs of pieces stay apart. Decided pairs lie in a table addressed by their hash; a pair that has lost its place is decided again."""
        key = (left + 2) * (len(self.pieces) + 2) + right
        at = ((key.astype(np.uint64) * np.uint64(_BASE)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        held = self.pairs[at]
        good, new = (held & 1).astype(bool), (held >> 1) != key
        if new.any():
            fresh, first, which = np.unique(key[new], return_index=True, return_inverse=True)
            decided = np.array([self.stay_apart(a, b) for a, b in np.stack([left[new][first], right[new][first]], axis=1).tolist()], bool)
            self.pairs[at[new][first]] = fresh * 2 + decided
            good[new] = decided[which]
        return good

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        return self.words.findall((MARK if self.dummy_prefix else "") + text.replace(" ", MARK))

    def learn(self, words: set[str]) -> None:
        """Encode words not seen before, by length."""
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        lengths: dict[int, list[str]] = {}
        for w in words:
            if w not in self.known:
                lengths.setdefault(len(w), []).append(w)
        for n, group in lengths.items():
            if n > BATCH_LENGTH or len(group) < BATCH_WORDS:
                ids = [self._alone(w) for w in group]
            else:
                ids = [x for k in range(0, len(group), 4096) for x in self._together(group[k : k + 4096])]
            self.known.update({w: struct.pack(f"<{len(x)}I", *x) for w, x in zip(group, ids, strict=True)})

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        split = [self.split(t) for t in texts]
        self.learn(set().union(*split))
        return [b"".join(map(self.known.__getitem__, words)) for words in split]

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces.load(path)


def _runs(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Runs of rows of about ``RUN`` characters: enough words to advance together, and bounded memory."""
    run = np.cumsum(pdf["text"].str.len().fillna(0).to_numpy()) // RUN
    for _, part in pdf.groupby(run, sort=False):
        yield part


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, ids`` (binary, little-endian unsigned 32-bit) of every whole text; a null text has no ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = pieces(model_path)
        for pdf in batches:
            for part in _runs(pdf):
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "ids": model.encode([t or "" for t in part["text"]])})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give an empty text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = pieces(model_path)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "text": [model.decode(bytes(x or b"")) for x in pdf["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """Encode and decode every whole text: ``doc_id, n_ids, ids_crc32, decoded_crc32, exact``.

    exact says that decoding gives the text back; it can only be false for texts with the mark itself or such that begin with
    it. Null texts count as empty; repeated rows are repeated.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = pieces(model_path)
        for pdf in batches:
            for part in _runs(pdf):
                texts = [t or "" for t in part["text"]]
                ids = model.encode(texts)
                back = [model.decode(x) for x in ids]
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].astype("Int64"),
                        "n_ids": [len(x) // 4 for x in ids],
                        "ids_crc32": [zlib.crc32(x) for x in ids],
                        "decoded_crc32": [zlib.crc32(b.encode()) for b in back],
                        "exact": [b == t for b, t in zip(back, texts, strict=True)],
                    }
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, n_ids long, ids_crc32 long, decoded_crc32 long, exact boolean")
