"""Token counts at every prefix of a text, by dynamic programming over prefixes.

The last token of a prefix's encoding is the one token that is a suffix of the prefix and stands beside the last token of
what comes before it without being merged with it. So one pass from left to right knows, for every prefix, its last token and
its count: count(prefix) = count(prefix without the last token) + 1. A budget ("how much fits into n tokens?") or a truncation
("how many tokens has this prefix?") is then read off, without encoding anything again.

Pieces of the vocabulary hold spaces only in front, and characters outside it are byte tokens of their own, so a text falls into
chunks that share no token; the table of each distinct chunk is kept in a bounded memo.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from knownthen.llm.memo import Memo, slices

LIMIT = 4096
SPACE = "▁"


class PrefixCounter:
    """Counts of a score-ordered BPE model with byte fallback, identity normalisation and a space put in front."""

    def __init__(self, path: str, limit: int = 900_000):
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = model.SentencePiece
        spec = model.normalizer_spec
        if (model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or spec.precompiled_charsmap
                or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or not spec.escape_whitespaces):
            raise ValueError("only BPE models with byte fallback and identity normalisation are supported")
        self.score = {p.piece: p.score for p in model.pieces if p.type in (kinds.NORMAL, kinds.USER_DEFINED, kinds.UNUSED)}
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("pieces with inner spaces are not supported")
        #: lengths of the pieces of two and more characters by their last two, the longest first
        ends: dict[str, set[int]] = {}
        for p in self.score:
            if len(p) > 1:
                ends.setdefault(p[-2:], set()).add(len(p))
        self.ends = {c: (*sorted(n, reverse=True), 1) for c, n in ends.items()}
        known = "".join(re.escape(c) for c in sorted(c for c in self.score if len(c) == 1 and c != SPACE))
        #: chunks: spaces and then characters of the vocabulary, or one character outside it
        self.chunk = re.compile(f"{SPACE}*[{known}]+|{SPACE}+|[^{known}{SPACE}]")
        self.beside = lru_cache(300_000)(self._beside)
        self.tables = Memo(self._table, limit)
        #: the last token of prefixes of chunks seen so far; chunks share their beginnings
        self.last: dict[str, str] = {}
        self.limit = limit

    def _beside(self, left: str, right: str) -> bool:
        """Whether `left + right` is encoded as these two tokens."""
        parts = list(left + right)
        while len(parts) > 1:
            best = max(range(len(parts) - 1), key=lambda i: (self.score.get(parts[i] + parts[i + 1], float("-inf")), -i))
            if parts[best] + parts[best + 1] not in self.score:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return parts == [left, right]

    def _table(self, chunk: str) -> bytes:
        """How the count changes with each character of a chunk (signed bytes)."""
        if chunk[0] not in self.score:
            return bytes([len(chunk.encode())])
        if len(self.last) > self.limit:
            self.last.clear()
        memo = self.last if len(chunk) <= self.tables.longest else {}
        score, ends, beside, single = self.score, self.ends, self.beside, (1,)
        last, count, out = [""], [0], bytearray()
        for i in range(1, len(chunk) + 1):
            prefix = chunk[:i] if memo is self.last else ""
            piece = memo.get(prefix)
            if piece is None:
                for n in ends.get(chunk[i - 2:i], single) if i > 1 else single:
                    if n <= i:
                        piece = chunk[i - n:i]
                        if piece in score and (n == i or beside(last[i - n], piece)):
                            break
                if prefix:
                    memo[prefix] = piece
            last.append(piece)
            count.append(count[i - len(piece)] + 1)
            out.append((count[i] - count[i - 1]) & 255)
        return bytes(out)

    def deltas(self, text: str) -> bytes:
        """One signed byte per code point: how much the count of the prefix that ends there differs from the one before.
        The space put in front belongs to the first character."""
        if not text:
            return b""
        out = b"".join(map(self.tables.__getitem__, self.chunk.findall(SPACE + text.replace(" ", SPACE))))
        first = (int.from_bytes(out[:1], signed=True) + int.from_bytes(out[1:2], signed=True)) & 255
        return bytes([first]) + out[2:]


@lru_cache(1)
def counter_of(path: str) -> PrefixCounter:
    """The counter of a worker process, whose memos outlast a task."""
    return PrefixCounter(path)


def counts_at(deltas: bytes) -> np.ndarray:
    """Token counts of the prefixes of 1, 2, ... code points."""
    return np.cumsum(np.frombuffer(deltas, np.int8), dtype=np.int64)


def fitting_chars(deltas: bytes, budget: int) -> int:
    """Length of the longest prefix of at most `budget` tokens, in code points."""
    fits = np.flatnonzero(counts_at(deltas) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def prefix_counts(docs: DataFrame, model: str | None = None, limit: int = LIMIT, text: str = "text") -> DataFrame:
    """`docs` without the text, with n_bytes, n_tokens, over_limit, limit_chars (the longest prefix within the limit) and
    prefix_deltas, from which `counts_at` and `fitting_chars` answer any other question.

    Null text counts as empty, with no tokens. Rows are counted each; columns named like the new ones are replaced.
    """
    path = model or public_tokenizers.path("piece_bpe_32k.model")
    new = [("n_bytes", "long", pa.int64()), ("n_tokens", "long", pa.int64()), ("over_limit", "boolean", pa.bool_()),
           ("limit_chars", "long", pa.int64()), ("prefix_deltas", "binary", pa.binary())]
    keep = [c for c in docs.columns if c != text and c not in [n for n, _, _ in new]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        for batch in batches:
            for part in slices(batch):
                rows = []
                for t in part.column(len(keep)).to_pylist():
                    d = counter.deltas(t or "")
                    n = int(np.frombuffer(d, np.int8).sum(dtype=np.int64))
                    rows.append((len((t or "").encode()), n, n > limit, len(d) if n <= limit and len(d) <= limit else fitting_chars(d, limit), d))
                made = [pa.array(c, k) for c, (_, _, k) in zip(zip(*rows), new)]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + made, names=keep + [n for n, _, _ in new])

    fields = docs.select(*keep).schema
    for name, kind, _ in new:
        fields = fields.add(name, kind)
    return docs.select(*keep, text).mapInArrow(run, fields)
