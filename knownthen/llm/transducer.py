"""What each of several document filters removes, alone and in every order of application.

The text measures come from one pass of a finite-state transducer over UTF-8 bytes, whose whole behaviour is in two tables: STEP
gives the class of a byte, EMIT what leaves the machine on that class in a state. The state, inside a word or not, depends on the last
byte only, so a block of bytes is stepped through at once. The spans of words it emits go into an open-addressing hash
table that compares the bytes of a span with those of the slot's owner, so equal hashes alone never make two words one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

#: bytes stepped through at once, about
BLOCK = 1 << 20
#: longer words are hashed and compared one by one
LONG = 128

# Classes of bytes, as bits.
WORD, CAPITAL, POINT, SYMBOL = 1, 2, 4, 8
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#$%&*|"


def _step() -> np.ndarray:
    """Class of each byte: part of a word, A-Z, first byte of a code point, symbol."""
    table = np.zeros(256, np.uint8)
    for byte in range(256):
        table[byte] = ((byte not in SPACES) * WORD | (65 <= byte <= 90) * CAPITAL
                       | (byte & 0xC0 != 0x80) * POINT | (byte in SYMBOLS) * SYMBOL)
    return table


# Events, as bits; the states are 0 outside and 1 inside a word.
BEGIN, END = 1, 2


def _emit() -> np.ndarray:
    """Event of each (state, class): a word begins, or one has ended before this byte."""
    table = np.zeros((2, 16), np.uint8)
    for kind in range(16):
        table[0, kind] = BEGIN if kind & WORD else 0
        table[1, kind] = 0 if kind & WORD else END
    return table


STEP, EMIT = _step(), _emit()
PROFILE = [("n_words", "long"), ("n_distinct", "long"), ("n_capitals", "long"), ("n_points", "long"), ("n_symbols", "long")]


class SpanTable:
    """Spans of a buffer, hashed by their bytes and the document they belong to; each is found equal to an earlier one or new."""

    def __init__(self, data: np.ndarray):
        self.data = data
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        self.eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
        self.slots = np.full(64, -1, np.int64)
        self.start = self.size = self.doc = self.hash = np.zeros(0, np.int64)

    def eights(self, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Eight bytes from `at` on, zero beyond the `left` ones that count."""
        keep = np.minimum(left, 8).astype(np.uint64)
        mask = np.where(keep == 8, np.uint64(2**64 - 1), (np.uint64(1) << (keep * np.uint64(8))) - np.uint64(1))
        return self.eight[at] & mask

    def hashes(self, start: np.ndarray, size: np.ndarray, doc: np.ndarray) -> np.ndarray:
        h = (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ size.astype(np.uint64)
        go, at = np.flatnonzero(size <= LONG), 0
        for i in np.flatnonzero(size > LONG):
            h[i] ^= np.uint64(crc32(self.data[start[i]:start[i] + size[i]].tobytes()))
        while go.size:
            h[go] = (h[go] ^ self.eights(start[go] + at, size[go] - at)) * np.uint64(0xFF51AFD7ED558CCD)
            h[go] ^= h[go] >> np.uint64(32)
            at += 8
            go = go[size[go] > at]
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        return (h ^ (h >> np.uint64(29))).astype(np.int64)

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Are spans a and b of one document and the same bytes?"""
        same = (self.hash[a] == self.hash[b]) & (self.doc[a] == self.doc[b]) & (self.size[a] == self.size[b])
        go, at = np.flatnonzero(same & (self.size[a] <= LONG)), 0
        for i in np.flatnonzero(same & (self.size[a] > LONG)):
            x, y, n = self.start[a[i]], self.start[b[i]], self.size[a[i]]
            same[i] = np.array_equal(self.data[x:x + n], self.data[y:y + n])
        while go.size:
            left = self.size[a[go]] - at
            fits = self.eights(self.start[a[go]] + at, left) == self.eights(self.start[b[go]] + at, left)
            same[go[~fits]] = False
            at += 8
            go = go[fits & (left > 8)]
        return same

    def insert(self, start: np.ndarray, size: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Which of the spans no earlier span of their document equals."""
        first = len(self.start)
        self.hash = np.concatenate([self.hash, self.hashes(start, size, doc)])
        self.start, self.size, self.doc = np.concatenate([self.start, start]), np.concatenate([self.size, size]), np.concatenate([self.doc, doc])
        if 2 * len(self.start) > len(self.slots):
            held = np.sort(self.slots[self.slots >= 0])
            self.slots = np.full(1 << (4 * len(self.start)).bit_length(), -1, np.int64)
            self._place(held, False)
        fresh = np.zeros(len(start), bool)
        fresh[self._place(np.arange(first, len(self.start)), True) - first] = True
        return fresh

    def _place(self, spans: np.ndarray, verify: bool) -> np.ndarray:
        """Give each span a slot unless it equals the owner of one it meets; the spans that own one now."""
        mask, owners, probe = len(self.slots) - 1, [], 0
        slot = self.hash[spans] & mask
        while spans.size:
            free = np.flatnonzero(self.slots[slot] < 0)[::-1]
            self.slots[slot[free]] = spans[free]  # of several that meet here the first is written last and stays
            owner = self.slots[slot]
            mine = owner == spans
            owners.append(spans[mine])
            rest = ~mine
            if verify:
                met = np.flatnonzero(rest)
                rest[met[self.equal(spans[met], owner[met])]] = False
            probe += 1
            spans, slot = spans[rest], (slot[rest] + probe) & mask
        return np.concatenate(owners) if owners else spans


def run_machine(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all bytes, and starts and ends of the words; no word goes over the begin of a document."""
    kinds = STEP[data]
    state = np.zeros(len(data), np.uint8)
    state[1:] = kinds[:-1] & WORD
    state[begins[begins < len(data)]] = 0
    events = EMIT[state, kinds]
    start = np.flatnonzero(events & BEGIN)
    # a word ends where one was left, or where its document ends
    last = np.zeros(len(data) + 1, bool)
    last[:-1] = events & END > 0
    cut = begins[(begins > 0) & (begins <= len(data))]
    last[cut] |= kinds[cut - 1] & WORD > 0
    last[len(data)] |= len(data) > 0 and bool(kinds[-1] & WORD)
    return kinds, start, np.flatnonzero(last)


def profiles(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The five measures of each document of a buffer; document i lies in data[begins[i]:begins[i + 1]].

    Documents are stepped through together in blocks; a longer one is cut at spaces and its blocks share a hash table.
    """
    out = np.zeros((len(begins) - 1, 5), np.int64)
    first = 0
    while first < len(begins) - 1:
        last = max(first + 1, int(np.searchsorted(begins, begins[first] + BLOCK, "right")) - 1)
        low, high = int(begins[first]), int(begins[last])
        inside = begins[first:last + 1] - low
        table = SpanTable(data[low:high])
        for a, b in pieces(table.data):
            edges = np.clip(inside, a, b) - a
            kinds, start, end = run_machine(table.data[a:b], edges[:-1])
            doc = np.searchsorted(edges, start, "right") - 1
            fresh = table.insert(start + a, end - start, doc)
            counts = [np.bincount(doc, minlength=last - first), np.bincount(doc[fresh], minlength=last - first)]
            for bit in (CAPITAL, POINT, SYMBOL):
                upto = np.searchsorted(np.flatnonzero(kinds & bit), edges)
                counts.append(np.diff(upto))
            out[first:last] += np.stack(counts, 1)
        first = last
    return out


def pieces(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Blocks of a buffer that end with a space, or at its end."""
    at, stop = 0, len(data)
    while at < stop:
        end = at + BLOCK
        while end < stop:
            spaces = np.flatnonzero((STEP[data[end - 1:end + BLOCK]] & WORD) == 0)
            if spaces.size:
                end += int(spaces[0])
                break
            end += BLOCK
        yield at, min(end, stop)
        at = min(end, stop)


def profiled(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` without the text, with the measures of `PROFILE`: words (maximal runs without space and tab to carriage return), different
    words, characters A-Z, code points, and characters of `#$%&*|`.

    A null or empty text has zeros; each row is measured for itself. Texts of any length are stepped through in blocks. Columns
    named like the new ones are replaced.
    """
    keep = [c for c in docs.columns if c != text and c not in [n for n, _ in PROFILE]]
    fields = docs.select(*keep).schema
    for name, kind in PROFILE:
        fields = fields.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(keep))
            if column.null_count:
                column = column.fill_null(b"")
            wide = column.cast(pa.large_binary())
            _, offsets, data = wide.buffers()
            begins = np.frombuffer(offsets, np.int64)[wide.offset:wide.offset + len(wide) + 1] if len(wide) else np.zeros(1, np.int64)
            bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            made = profiles(bytes_, begins)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(c) for c in made.T], names=fields.names)

    return docs.select(*keep, F.col(text).cast("binary").alias(text)).mapInArrow(run, fields)


# --- the audit -------------------------------------------------------------------------


def failures(conditions: list[Column]) -> Column:
    """A number whose bit i is set where condition i holds; a null condition does not."""
    return sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions)), F.lit(0))


def interactions(cells: DataFrame, names: str, part: str = "part", mask: str = "mask", marks: tuple[str, ...] = ()) -> DataFrame:
    """What each filter does in every order of application, per part.

    `cells` has rows (part, mask, n, marks...): n documents that fail the filters of the mask, and of them so many with each mark. One row per
    part, order of the letters `names` and step: kept, removed, redundant, unique_fails, lost_<mark> and shapley.
    A filter removes a document in the share of orders in which none of the others that it fails comes first, one in as many as it
    fails; so its Shapley value is summed from the cells. No cell or part is paired with another: a part has at most
    2^filters masks, which are gathered into arrays.
    """
    k, size = len(names), 1 << len(names)
    values = ("n", *marks)
    grouped = cells.groupBy(part).pivot(mask, list(range(size))).agg(*[F.sum(v).cast("long").alias(v) for v in values])
    column = (lambda m, v: f"`{m}_{v}`") if marks else (lambda m, v: f"`{m}`")
    tall = grouped.select(part, *[F.array(*[F.coalesce(F.col(column(m, v)), F.lit(0).cast("long")) for m in range(size)]).alias(f"_{v}") for v in values])
    orders = ["".join(p) for p in permutations(names)]
    steps = (tall.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders))))
             .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k)))))
    bit = f"shiftleft(1, locate(substr(filter_order, {{}}, 1), '{names}') - 1)"
    steps = steps.withColumns({"_b": F.expr(bit.format("step")), "_p": F.expr(
        f"aggregate(sequence(1, {k}), 0, (s, i) -> s | if(i < step, {bit.format('i')}, 0))")})

    def total(condition: str, value: str = "n", times: str = "") -> Column:
        return F.expr(f"aggregate(sequence(0, {size - 1}), 0L, (s, m) -> s + if({condition}, _{value}[m]{times}, 0L))")

    removed = "m & _b <> 0 AND m & _p = 0"
    out = {"kept": total("m & (_p | _b) = 0"), "removed": total(removed), "redundant": total("m & _b <> 0 AND m & _p <> 0"),
           "unique_fails": total("m = _b"), **{f"lost_{v}": total(removed, v) for v in marks},
           "shapley": total("m & _b <> 0", times=f" * ({factorial(k)}L div bit_count(m))")}
    return steps.select(part, "filter_order", "step", *[c.alias(n) for n, c in out.items()])


def audit_cells(docs: DataFrame, conditions: list[Column], marks: list[str], *, key: str, part: str, twin: str) -> DataFrame:
    """The cells of `interactions`: documents counted by part, failed filters and marks; the last filter, after `conditions`, is failed by a
    row whose text is found under a smaller key.

    `twin` is a column that tells texts apart, such as a digest. Rows of one text are counted per part, mask and marks before
    they meet, so that a text of a third of all rows is no larger a group than there are parts and masks. Rows that share the
    smallest key of their text have no smaller one, and a row without a key is failed by no other.
    """
    by = [part, "_mask", *marks]
    rows = docs.select(part, failures(conditions).alias("_mask"), *marks, F.col(twin).alias("_text"), F.col(key).alias("_key"))
    single = rows.groupBy("_key", "_text", *by).agg(F.count(F.lit(1)).alias("_n"))
    groups = single.groupBy("_text", *by).agg(
        F.sum("_n").alias("_all"), F.min(F.when(F.col("_key").isNotNull(), F.struct("_key", "_n"))).alias("_head"),
        F.sum(F.when(F.col("_key").isNull(), F.col("_n")).otherwise(0)).alias("_keyless"))
    least = F.min("_head._key").over(Window.partitionBy("_text"))
    spared = F.col("_keyless") + F.when(F.col("_head._key") == F.col("_least"), F.col("_head._n")).otherwise(0)
    both = F.array(F.struct(F.col("_mask").alias("mask"), spared.alias("n")),
                   F.struct((F.col("_mask") + (1 << len(conditions))).alias("mask"), (F.col("_all") - spared).alias("n")))
    cells = groups.withColumn("_least", least).select(part, *marks, F.explode(both).alias("c")).select(part, *marks, "c.*")
    return cells.groupBy(part, "mask").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col(m), F.col("n")).otherwise(0)).alias(m) for m in marks])
