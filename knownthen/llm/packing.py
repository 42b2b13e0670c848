"""Vector bin packing of documents into training sequences.

A sequence has limits on tokens, segments and loss-bearing tokens. The dot-product heuristic puts into the open
sequence the piece whose demand fits and has the largest dot product with what is left of the limits. Where nothing
fits, a piece is cut so that its head fills the sequence. Each task packs what it reads, in rounds, so nothing is
shuffled and memory is bounded; what a task has at its end goes into sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame

from knownthen.llm.byte_bpe import ByteBpe
from knownthen.llm.memo import slices

TOKENS, SEGMENTS, END_ID = 2048, 64, 1
#: A round packs when this many tokens wait.
ROUND_TOKENS = 2_000_000
#: Sequence ids are the task's partition times this, plus a counter.
PER_TASK = 1 << 40


class Packer:
    """Packs the pieces given to it; `out` gets (document, start, length, sequence, offset)."""

    def __init__(self, tokens: int, segments: int, loss: int, first: int):
        self.caps, self.next, self.out = np.array([tokens, segments, loss], float), first, []
        self.waiting = defaultdict(list)  # (length, loss-bearing) -> pieces of that demand
        self.total = 0

    def add(self, doc: int, start: int, end: int, quiet: int) -> None:
        """quiet: so many leading tokens of the document bear no loss."""
        while end - start >= self.caps[0] and self._loss(start, start + int(self.caps[0]), quiet) <= self.caps[2]:
            start = self._place(doc, start, int(self.caps[0]), self._open(), 0)
        if start < end:
            self.waiting[end - start, self._loss(start, end, quiet)].append((doc, start, end, quiet))
            self.total += end - start

    def _loss(self, start: int, end: int, quiet: int) -> int:
        return max(0, end - max(start, quiet))

    def _open(self) -> int:
        self.next += 1
        return self.next - 1

    def _place(self, doc, start, length, sequence, offset) -> int:
        self.out.append((doc, start, length, sequence, offset))
        return start + length

    def pack(self, least: int) -> None:
        """Fill sequences until fewer than `least` tokens wait."""
        kinds = sorted(self.waiting)
        demand = np.array([(n, 1, loss) for n, loss in kinds], float).reshape(-1, 3)
        alive = np.ones(len(kinds), bool)
        while self.total >= max(least, 1):
            left, sequence, offset = self.caps.copy(), self._open(), 0
            if self.total < self.caps[0]:  # the end: powers of two
                left[0] = 1 << (self.total.bit_length() - 1)
            while left[0] >= 1 and left[1] >= 1 and self.total:
                fits = alive & (demand <= left).all(1)
                if fits.any():
                    k = int(np.argmax(np.where(fits, (demand / self.caps) @ (left / self.caps), -1)))
                    doc, start, end, quiet = self.waiting[kinds[k]].pop()
                    head = end - start
                else:  # cut the longest
                    k = int(np.argmax(np.where(alive, demand[:, 0], -1)))
                    doc, start, end, quiet = self.waiting[kinds[k]][-1]
                    head = int(min(left[0], end - start, max(0, quiet - start) + left[2]))
                    if head < 1:
                        break
                    self.waiting[kinds[k]].pop()
                if not self.waiting[kinds[k]]:
                    del self.waiting[kinds[k]]
                    alive[k] = False
                left -= (head, 1, self._loss(start, start + head, quiet))
                self.total -= head
                mid = self._place(doc, start, head, sequence, offset)
                offset += head
                if mid < end:
                    kind = (end - mid, self._loss(mid, end, quiet))
                    self.waiting[kind].append((doc, mid, end, quiet))
                    same = np.flatnonzero((demand[:, 0] == kind[0]) & (demand[:, 2] == kind[1]))
                    if len(same):
                        alive[same[0]] = True
                    else:
                        kinds.append(kind)
                        demand, alive = np.vstack([demand, (kind[0], 1, kind[1])]), np.append(alive, True)


def packed(docs: DataFrame, tokenizer: str | None = None, tokens: int = TOKENS, segments: int = SEGMENTS,
           loss_tokens: int = TOKENS, end_id: int = END_ID, quiet: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    docs: doc_id, text, and, if `quiet` names it, the number of leading tokens without loss (prompts). Null text is empty
    and still has the end id; rows that share a doc_id are packed each; an empty table gives no rows.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    columns = ["doc_id", "text"] + ([quiet] if quiet else [])
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
              ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(path)
        context = TaskContext.get()
        packer = Packer(tokens, segments, loss_tokens, (context.partitionId() if context else 0) * PER_TASK)
        held: dict[int, tuple] = {}  # documents with pieces that wait or were placed in this round
        n = 0

        def flush(least: int) -> pa.RecordBatch:
            packer.pack(least)
            rows = [(held[d][0], at, m, zlib.crc32(held[d][1][4 * at:4 * (at + m)]), len(held[d][1]) // 4, s, o)
                    for d, at, m, s, o in packer.out]
            packer.out = []
            wait = {p[0] for ps in packer.waiting.values() for p in ps}
            for d in [d for d in held if d not in wait]:
                del held[d]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows) if rows else [[]] * 7, fields)],
                                              names=[f for f, _ in fields])

        for batch in batches:
            for part in slices(batch):
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                quiets = part.column(2).to_pylist() if quiet else [0] * len(ids)
                for doc, text, q in zip(ids, texts, quiets):
                    data = bpe.encode(text or "") + end
                    held[n] = (doc, data)
                    packer.add(n, 0, len(data) // 4, min(max(q or 0, 0), len(data) // 4))
                    n += 1
                if packer.total >= ROUND_TOKENS or len(packer.out) >= 4096:
                    yield flush(tokens)
        yield flush(1)

    return docs.select(*columns).mapInArrow(run, ", ".join(f"{f} long" for f, _ in fields))
