"""Ids of a byte-level BPE tokenizer file, as the tokenizers library gives them, by a memo of words.

Most texts hold only characters of a fixed set for which the standard library's regular expressions split words
like the tokenizer's own pattern; the rest is encoded whole.
"""

from __future__ import annotations

import json
import re

import tiktoken

from knownthen.llm.memo import Memo

#: The pattern by which byte-level BPE of this kind splits words; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTERS, DIGITS = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼½¾"
UNCOMMON = re.compile(r"[^\t\n\x0b\x0c\r -~\xa0-ſ‐-‧‹›€]")
COMMON = re.compile(rf" ?[{LETTERS}]+| ?[{DIGITS}]+|'(?:[stmd]|re|ve|ll)| ?[^\s{LETTERS}{DIGITS}]+|\s+(?!\S)|\s+")


def byte_alphabet() -> dict[str, int]:
    """The printable character of byte-level vocabularies for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteBpe:
    """`encode(text)`: little-endian unsigned 32-bit ids as bytes, special strings as their ids."""

    def __init__(self, path: str, limit: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
        self.model = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = {s: i.to_bytes(4, "little") for s, i in special.items()}
        self.cut = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or r"(?!)")
        self.words = Memo(self._word, limit)

    def _ids(self, ids: list[int]) -> bytes:
        return b"".join([i.to_bytes(4, "little") for i in ids])

    def _word(self, word: str) -> bytes:
        return self._ids(self.model.encode_single_piece(word) if hasattr(self.model, "encode_single_piece")
                         else self.model._encode_single_piece(word))

    def _plain(self, text: str) -> bytes:
        if UNCOMMON.search(text):
            return self._ids(self.model.encode_ordinary(text))
        return b"".join(map(self.words.__getitem__, COMMON.findall(text)))

    def encode(self, text: str) -> bytes:
        at, out = 0, []
        for m in self.cut.finditer(text):
            out += [self._plain(text[at:m.start()]), self.special[m[0]]]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])]) if at else self._plain(text)
