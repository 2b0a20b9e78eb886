"""Byte-level BPE ids of whole texts, as the ``tokenizers`` library gives them for a vocabulary file."""

from __future__ import annotations

import functools
import json
import re

#: Splits text before the merges; the public pattern of byte-level BPE vocabularies of this kind.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters on whose classes every Unicode version and both libraries agree.
_SETTLED = re.compile(r"[^\t\n\r\x20-\x7e\xa1-ȳ‐-‧‰-⁞₠-₿]")


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of every byte: bytes that print stand for themselves, the others follow from code point 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    """Encodes texts. The ids are those of ``tokenizers`` for the file at ``path``, special tokens not added.

    ``tiktoken`` merges the same vocabulary about five times as fast, so it takes every text whose characters both libraries
    class alike; a text with any other character, or with the string of a special token, goes through ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = {t["content"] for t in spec.get("added_tokens", [])}
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in added}
        self.special = tuple(added)
        self.fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if _SETTLED.search(text) or any(s in text for s in self.special):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@functools.lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    """One encoder for each file and Python worker."""
    return ByteBpe(path)
