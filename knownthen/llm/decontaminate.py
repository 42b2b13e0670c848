"""Benchmark decontamination by suffix arrays over shards of the training documents.

Each task builds suffix arrays, in words, over shards of what it reads and binary-searches every suffix of the benchmark in
them. Words that no benchmark item has, and document ends, are separators: no match crosses one, so only runs of known words
as long as the shortest window enter a suffix array. The benchmark is read in blocks of bounded size; each is one pass
of the same stage, and nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from knownthen.llm.memo import slices

WINDOW = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words of benchmark text in a block, and in a piece of one item; blocks are collected and sent to the tasks.
BLOCK_WORDS, PIECE_WORDS = 1_000_000, 100_000
SHARD_BYTES = 8 << 20
#: Lower-cases A-Z and turns every other ASCII character that is no letter or digit into a space.
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_KEEP).split()


class Block:
    """Pieces of benchmark items as one array of word numbers, with all their windows."""

    def __init__(self, rows: list[tuple[str | None, list[str]]], window: int):
        self.vocabulary, text, starts, lengths, owners = {}, [], [], [], []
        self.items = [r[0] for r in rows]
        for k, (_, words) in enumerate(rows):
            ids = [self.vocabulary.setdefault(w.encode(), len(self.vocabulary) + 1) for w in words]
            n = min(window, len(ids))
            if n:
                at = range(len(text), len(text) + len(ids) - n + 1)
                starts += at
                lengths += [n] * len(at)
                owners += [k] * len(at)
                text += [*ids, 0]
        self.text = np.array(text + [0] * window, np.int32)
        self.starts, self.lengths, self.owners = (np.array(x, np.int64) for x in (starts, lengths, owners))
        #: window words as rows; what lies beyond a shorter window is never compared
        self.keys = self.text[self.starts[:, None] + np.arange(window)] if len(starts) else np.zeros((0, window), np.int32)
        self.inside = np.arange(window) < self.lengths[:, None]
        self.shortest = int(self.lengths.min()) if len(starts) else 0


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by prefix doubling; a zero ends a suffix and is smaller than any word."""
    rank = text.astype(np.int64)
    order, step = np.argsort(rank, kind="stable"), 1
    while step < len(text):
        later = np.zeros(len(text), np.int64)
        later[:-step] = rank[step:]
        later[text == 0] = 0
        pair = rank * (int(rank.max()) + 1) + np.where(rank > 0, later, 0)
        order = np.argsort(pair, kind="stable")
        sorted_pair = pair[order]
        fresh = np.empty(len(text), np.int64)
        fresh[order] = np.cumsum(np.r_[False, sorted_pair[1:] != sorted_pair[:-1]])
        fresh += 1 - (fresh[text == 0].max() + 1 if (text == 0).any() else 0)
        fresh[text == 0] = 0
        if (fresh == rank).all():
            break
        rank, step = fresh, step * 2
    return order


def bounds(text: np.ndarray, order: np.ndarray, keys: np.ndarray, inside: np.ndarray, after: bool) -> np.ndarray:
    """For each key the first suffix that is not smaller (after: that is greater), by binary search."""
    low, high = np.zeros(len(keys), np.int64), np.full(len(keys), len(order), np.int64)
    span = np.arange(keys.shape[1])
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) // 2
        found = text[order[mid][:, None] + span]
        differs = (found != keys[open_]) & inside[open_]
        first = differs.argmax(1)
        r = np.arange(len(open_))
        smaller = np.where(differs.any(1), found[r, first] < keys[open_][r, first], after)
        low[open_] = np.where(smaller, mid + 1, low[open_])
        high[open_] = np.where(smaller, high[open_], mid)
    return low


def search(ids: np.ndarray, block: Block, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All places where a benchmark suffix meets a shard: place in the shard, window of the block, words that agree."""
    empty = np.zeros(0, np.int64)
    edge = np.flatnonzero(np.diff(np.r_[0, (ids > 0).astype(np.int8), 0]))
    begin, end = edge[::2], edge[1::2]
    long = end - begin >= block.shortest
    begin, end = begin[long], end[long]
    if not len(begin) or not block.shortest:
        return empty, empty, empty
    size = end - begin + 1  # with a separator
    place = np.repeat(begin - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
    text = np.where(np.isin(np.arange(size.sum()), np.cumsum(size) - 1), 0, ids[np.minimum(place, len(ids) - 1)]).astype(np.int32)
    order = suffix_array(text)
    padded = np.r_[text, np.zeros(window, np.int32)]
    low = bounds(padded, order, block.keys, block.inside, False)
    high = bounds(padded, order, block.keys, block.inside, True)
    met = np.flatnonzero(high > low)
    if not len(met):
        return empty, empty, empty
    counts = (high - low)[met]
    which = np.repeat(met, counts)
    at = order[np.repeat(low[met] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())]
    length = block.lengths[which].copy()
    go = np.arange(len(at))
    while go.size:  # how far the match goes on
        a, b = at[go] + length[go], block.starts[which[go]] + length[go]
        same = (a < len(text)) & (b < len(block.text))
        same[same] = (text[a[same]] == block.text[b[same]]) & (text[a[same]] > 0)
        go = go[same]
        length[go] += 1
    return place[at], which, length


def _blocks(benchmark: DataFrame, window: int) -> list[Block]:
    """The benchmark in blocks of bounded size; long items are cut into overlapping pieces."""
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, UPPER.lower())
    words = benchmark.select(F.col("item_id").cast("string").alias("item"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)), F.lit(PIECE_WORDS))
    pieces = words.select("item", "w", F.explode(starts).alias("at")).select(
        "item", F.slice("w", F.col("at") + 1, F.lit(PIECE_WORDS + window - 1)).alias("w"))
    total = pieces.agg(F.sum(F.size("w"))).first()[0] or 0
    n = max(1, math.ceil(total / BLOCK_WORDS))
    number = F.pmod(F.xxhash64("item", "w"), F.lit(n))
    return [Block([(r.item, r.w) for r in pieces.filter(number == k).collect()], window) for k in range(n)]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """`docs` with n_words, n_hit, n_items, items_sha256, contaminated, longest_match, hit_spans and item_ids.

    A word is hit that lies in an occurrence of `window` consecutive words of an item, or of a whole shorter item.
    hit_spans holds start and end of maximal hit stretches, in words; longest_match is the longest verbatim match with an item.
    Null texts have no words; items without words match nothing; an empty benchmark hits nothing. Repeated rows are
    judged each, repeated items count once, an item without id hits but is not listed. Columns named like
    the new ones are replaced.
    """
    new = [("n_words", "bigint", pa.int64()), ("n_hit", "bigint", pa.int64()), ("n_items", "bigint", pa.int64()),
           ("items_sha256", "string", pa.string()), ("contaminated", "boolean", pa.bool_()), ("longest_match", "bigint", pa.int64()),
           ("hit_spans", "array<bigint>", pa.list_(pa.int64())), ("item_ids", "array<string>", pa.list_(pa.string()))]
    keep = [c for c in docs.columns if c == text or c not in [n for n, _, _ in new]]
    out, where = docs.select(*keep), keep.index(text)
    blocks = _blocks(benchmark, window)
    for number, block in enumerate(blocks):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, first=number == 0) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                waiting, size = [], 0
                for part in slices(batch):
                    waiting.append(part)
                    size += part.column(where).get_total_buffer_size() * part.num_rows // max(1, batch.num_rows)
                    if size >= SHARD_BYTES:
                        yield from shard(waiting, sent.value, first)
                        waiting, size = [], 0
                if waiting:
                    yield from shard(waiting, sent.value, first)

        def shard(parts: list[pa.RecordBatch], block: Block, first: bool) -> Iterator[pa.RecordBatch]:
            arrays, begins = [], [0]
            get = block.vocabulary.get
            for part in parts:
                for t in part.column(where).to_pylist():
                    w = words_of(t)
                    arrays += [np.fromiter(map(get, w, repeat(0)), np.int32, len(w)), np.zeros(1, np.int32)]
                    begins.append(begins[-1] + len(w) + 1)
            begins = np.array(begins)
            place, which, length = search(np.concatenate(arrays), block, window)
            doc = np.searchsorted(begins, place, "right") - 1
            turn = np.argsort(doc, kind="stable")
            doc, place, which, length = doc[turn], place[turn], which[turn], length[turn]
            edges = np.searchsorted(doc, np.arange(len(begins)))
            row = 0
            for part in parts:
                before = [part.column(len(keep) + 6).to_pylist(), part.column(len(keep) + 7).to_pylist(),
                          part.column(len(keep) + 5).to_pylist()] if not first else None
                rows = []
                for k in range(part.num_rows):
                    a, b = edges[row], edges[row + 1]
                    n = int(begins[row + 1] - begins[row] - 1)
                    at = place[a:b] - begins[row]
                    spans = [(int(x), int(x + y)) for x, y in zip(at, block.lengths[which[a:b]])]
                    items = {block.items[i] for i in set(block.owners[which[a:b]].tolist())} - {None}
                    longest = int(length[a:b].max()) if b > a else 0
                    if before:
                        old = before[0][k]
                        spans += list(zip(old[::2], old[1::2]))
                        items |= set(before[1][k])
                        longest = max(longest, before[2][k])
                    merged: list[int] = []
                    for x, y in sorted(set(spans)):
                        if merged and x <= merged[-1]:
                            merged[-1] = max(merged[-1], y)
                        else:
                            merged += [x, y]
                    hit = sum(merged[1::2]) - sum(merged[::2])
                    names = sorted(items)
                    rows.append((n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0, longest, merged, names))
                    row += 1
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(keep))] + [pa.array(c, t) for c, (_, _, t) in zip(zip(*rows), new)],
                    names=keep + [n for n, _, _ in new])

        schema = StructType(docs.select(*keep).schema.fields + StructType.fromDDL(", ".join(f"{n} {k}" for n, k, _ in new)).fields)
        out = out.mapInArrow(run, schema)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any hit word, with their own columns."""
    renamed = docs.withColumnsRenamed({c: f"_{i}" for i, c in enumerate(docs.columns)})
    found = contamination(renamed, benchmark, window, text=f"_{docs.columns.index('text')}")
    return found.filter(~F.col("contaminated")).select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])
