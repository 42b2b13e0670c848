"""Hard negatives by an inverted multi-index over vectors of integers.

Each vector is cut into two halves, and each half has a codebook; a pair of codes is a cell. The score of an anchor with any vector of
a cell is at most the sum of two half-scores: of the anchor's half with the code, and its length times the radius of the
code. A search keeps the two lists of half-bounds in order and takes cells from a heap by their sum (multi-sequence); it
stops where no cell left can hold anything that belongs to the result, so the result is exact.

The index is a table in the shared folder, range-partitioned by cell, and a frequent cell or vector over several partitions. Anchors come in
blocks of bounded size against all of it: each block is one job per pass, each task searches its own part and returns the few best
per anchor, which Spark then cuts to the best of all parts.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from knownthen.llm.memo import slices
from knownthen.sources.shared import fresh_dir, written

#: rows that the codebooks and first thresholds come from, those with the smallest hashes of their ids
SAMPLE = 4096
CODES = 16
ROUNDS = 8
#: anchors that are searched together and broadcast
ANCHORS = 2048
#: rows a task searches at once, and rows of a partition of the index, about
SLAB, PART = 16_384, 16_384
#: cells an anchor takes from its heap before their vectors are compared
VISITS = 8
POSITIVES, NEGATIVES = 5, 5
LOW, HIGH, OF = 80, 100, 100
#: scores stay below this, so that they are exact as doubles, and with the place in a slab still a long
EXACT = 2.0**46
NONE, NO_KEY = -(1 << 47), np.iinfo(np.int64).max


def integers(rows: DataFrame, scale: int = 256, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """key, label and q: floor(scale * x) of each component, as long.

    Rows with a null key, label or vector, or a component that is null or not finite, take no part. Of rows that share a key, the one with the
    smallest (label, q) counts. A vector that is shorter than others has zeros at its end.
    """
    usable = F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & ~F.exists(
        vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    q = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return (rows.filter(usable).select(F.col(key).alias("key"), F.col(label).cast("long").alias("label"), q.alias("q"))
            .groupBy("key").agg(F.min(F.struct("label", "q")).alias("r")).select("key", "r.label", "r.q"))


@dataclass(frozen=True)
class Codebooks:
    """Centres of the first and second halves of vectors of `dim` components."""

    dim: int
    half: int
    centres: tuple[np.ndarray, np.ndarray]

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return nearest(x[:, :self.half], self.centres[0]), nearest(x[:, self.half:], self.centres[1])


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1) - 2 * (x @ centres.T), 1) if len(x) else np.zeros(0, np.int64)


def centres_of(x: np.ndarray, codes: int) -> np.ndarray:
    """Lloyd's rounds from distinct rows spread over the sample; a code that loses all its rows keeps its place."""
    if not x.size:
        return np.zeros((1, x.shape[1]))
    x = np.unique(x, axis=0)
    centres = x[np.linspace(0, len(x) - 1, min(codes, len(x))).astype(int)]
    for _ in range(ROUNDS):
        of = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        n = np.bincount(of, minlength=len(centres))[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


@dataclass(frozen=True)
class Rows:
    """A few rows of the table: the sample."""

    keys: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray


def fit(table: DataFrame, sample: int = SAMPLE, codes: int = CODES) -> tuple[Codebooks, Rows, int]:
    """Codebooks from at most `sample` rows of `integers`, these, and the number of all rows, which also give the number of components and the
    largest length."""
    size = table.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("q")).alias("dim"), F.max(F.aggregate(
        "q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("norm")).first()
    if (size["norm"] or 0) >= EXACT:
        raise ValueError("vectors are too long for exact scores: choose a smaller scale")
    rows = table.orderBy(F.xxhash64("key"), "key").limit(sample).collect()
    dim = size["dim"] or 0
    x = padded([r.q for r in rows], dim)
    half = dim // 2
    return (Codebooks(dim, half, (centres_of(x[:, :half], codes), centres_of(x[:, half:], codes))),
            Rows(np.array([r.key for r in rows], np.int64), np.array([r.label for r in rows], np.int64), x), size["n"])


def padded(vectors: list, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    """A list column as rows of `dim` doubles."""
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes == dim).all():
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return padded(column.to_pylist(), dim)


def indexed(table: DataFrame, books, rows: int) -> DataFrame:
    """The rows with the codes of their cell, as a table ordered by cell; equal cells are told apart by the hash of the key, so none is
    larger than a partition need be. `books` is a broadcast `Codebooks`, `rows` the number of rows."""
    schema = "key long, label long, q array<long>, a int, b int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = books.value.codes(matrix(batch.column(2), books.value.dim))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["key", "label", "q", "a", "b"])

    coded, cores = table.mapInArrow(run, schema), table.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-rows // PART), min(cores, -(-rows // 1024)))
    return written(coded.repartitionByRange(parts, "a", "b", F.xxhash64("key")).sortWithinPartitions("a", "b", "key"), "index")


# --- searching a part of the index ---------------------------------------------------------


@dataclass(frozen=True)
class Wanted:
    """What a block of anchors looks for: the `best` rows of each list, with scores in [low, high] and a label that is the anchor's own, or
    not. `floor` is a score that the last row of a full list has at least, from rows already seen."""

    keys: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    own: bool
    best: int
    low: np.ndarray  # anchors x lists
    high: np.ndarray
    floor: np.ndarray


class Lists:
    """The best rows found so far: scores and keys by anchor, list and rank."""

    def __init__(self, wanted: Wanted):
        shape = (*wanted.low.shape, wanted.best)
        self.wanted = wanted
        self.scores, self.keys = np.full(shape, NONE, np.int64), np.full(shape, NO_KEY, np.int64)

    def needed(self) -> np.ndarray:
        """The score below which nothing can enter any list of an anchor."""
        last = np.maximum(np.maximum(self.scores[:, :, -1], self.wanted.floor), self.wanted.low)
        return np.where(self.wanted.low <= self.wanted.high, last, NO_KEY).min(1)

    def add(self, who: np.ndarray, keys: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> None:
        """Rows of one cell, by ascending key, with their scores for the anchors `who`."""
        w = self.wanted
        usable = (labels[None, :] == w.labels[who, None]) == w.own
        if w.own:
            usable &= keys[None, :] != w.keys[who, None]
        for k in range(w.low.shape[1]):
            bar = np.maximum(self.scores[who, k, -1], np.maximum(w.low[who, k], w.floor[who, k]))
            fits = usable & (scores >= bar[:, None]) & (scores <= w.high[who, k, None])
            some = np.flatnonzero(fits.any(1))
            if not some.size:
                continue
            found = np.where(fits[some], scores[some], NONE)
            if found.shape[1] > w.best:  # rows are in order of key, so of equal scores the first are wanted
                place = found * found.shape[1] - np.arange(found.shape[1])
                top = np.argpartition(-place, w.best - 1, 1)[:, :w.best]
                found, ids = np.take_along_axis(found, top, 1), keys[top]
            else:
                ids = np.broadcast_to(keys, found.shape)
            ids = np.where(found == NONE, NO_KEY, ids)
            at = who[some]
            both, names = np.hstack([self.scores[at, k], found]), np.hstack([self.keys[at, k], ids])
            turn = np.argsort(names, 1, kind="stable")
            both, names = np.take_along_axis(both, turn, 1), np.take_along_axis(names, turn, 1)
            turn = np.argsort(-both, 1, kind="stable")[:, :w.best]
            self.scores[at, k], self.keys[at, k] = np.take_along_axis(both, turn, 1), np.take_along_axis(names, turn, 1)


class Cells:
    """The cells of some rows, and what bounds the scores in them."""

    def __init__(self, books: Codebooks, keys: np.ndarray, labels: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray):
        order = np.lexsort((keys, b, a))
        self.keys, self.labels, self.x = keys[order], labels[order], x[order]
        a, b = a[order], b[order]
        edges = np.flatnonzero(np.r_[True, (np.diff(a) != 0) | (np.diff(b) != 0), True]) if len(a) else np.zeros(1, int)
        self.rows = {(int(a[s]), int(b[s])): slice(s, e) for s, e in zip(edges[:-1], edges[1:])}
        self.halves = []
        for codes, part, centres in ((a, self.x[:, :books.half], books.centres[0]), (b, self.x[:, books.half:], books.centres[1])):
            met = np.unique(codes)
            far = np.sqrt(((part - centres[codes]) ** 2).sum(1))
            radius = np.zeros(len(centres))
            np.maximum.at(radius, codes, far)
            self.halves.append((met, centres[met], radius[met]))

    def bounds(self, side: int, anchors: np.ndarray) -> np.ndarray:
        """No half of a row with a code scores higher with an anchor's half; a little is added for rounding."""
        _, centres, radius = self.halves[side]
        most = anchors @ centres.T + np.sqrt((anchors * anchors).sum(1))[:, None] * radius
        return most + 1e-6 + 1e-9 * np.abs(most)


def sequence(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """Pairs (i, j) by descending first[i] + second[j]: a heap of pairs whose predecessors have been given."""
    rows, cols = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    heap = [(-(first[rows[0]] + second[cols[0]]), 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, int(rows[i]), int(cols[j])
        if j + 1 < len(cols):
            heapq.heappush(heap, (-(first[rows[i]] + second[cols[j + 1]]), i, j + 1))
        if j == 0 and i + 1 < len(rows):
            heapq.heappush(heap, (-(first[rows[i + 1]] + second[cols[0]]), i + 1, 0))


def search(cells: Cells, books: Codebooks, lists: Lists) -> None:
    """Visit the cells of each anchor by descending bound until its lists are certified: until the next bound is under what they need.

    Anchors take a few cells each in turn, and the rows of a cell are compared with all anchors that took it together.
    """
    if not cells.rows:
        return
    anchors, visits = lists.wanted.vectors, VISITS
    first, second = cells.bounds(0, anchors[:, :books.half]), cells.bounds(1, anchors[:, books.half:])
    needed = lists.needed()
    names = cells.halves[0][0], cells.halves[1][0]
    going = {int(i): sequence(first[i], second[i]) for i in np.flatnonzero(first.max(1) + second.max(1) >= needed)}
    while going:
        taken = defaultdict(list)
        for i, cells_left in list(going.items()):
            n = 0
            for bound, p, q in cells_left:
                if bound < needed[i]:
                    del going[i]
                    break
                cell = (int(names[0][p]), int(names[1][q]))
                if cell in cells.rows:
                    taken[cell].append(i)
                    n += 1
                if n == visits:
                    break
            else:
                del going[i]
        for cell, who in taken.items():
            rows, who = cells.rows[cell], np.array(who)
            scores = (anchors[who] @ cells.x[rows].T).astype(np.int64)
            lists.add(who, cells.keys[rows], cells.labels[rows], scores)
        needed, visits = lists.needed(), 2 * visits


FOUND = "anchor_id long, list int, score long, found_id long"


def searched(index: DataFrame, books, wanted) -> DataFrame:
    """The best rows of each anchor and list over the whole index: anchor_id, list, rank, score, found_id. `books` and `wanted` are
    broadcast."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, lists = books.value, Lists(wanted.value)

        def slab(held):
            keys, labels, a, b = (np.concatenate([h.column(c).to_numpy(zero_copy_only=False) for h in held]) for c in (0, 1, 3, 4))
            x = np.concatenate([matrix(h.column(2), book.dim) for h in held])
            search(Cells(book, keys, labels, x, a, b), book, lists)

        held, n = [], 0
        for batch in batches:
            for piece in slices(batch, SLAB // 4):
                held.append(piece)
                n += piece.num_rows
                if n >= SLAB:
                    slab(held)
                    held, n = [], 0
        if n:
            slab(held)
        who, which, rank = np.nonzero(lists.scores > NONE)
        if len(who):
            yield pa.RecordBatch.from_arrays([pa.array(wanted.value.keys[who]), pa.array(which, pa.int32()), pa.array(lists.scores[who, which, rank]),
                                              pa.array(lists.keys[who, which, rank])], names=["anchor_id", "list", "score", "found_id"])

    order = Window.partitionBy("anchor_id", "list").orderBy(F.col("score").desc(), "found_id")
    return index.mapInArrow(run, FOUND).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= wanted.value.best)


def with_floors(rows: Rows, wanted: Wanted) -> Wanted:
    """The same with the last of the best rows of the sample as floor: the index holds at least these."""
    lists, order = Lists(wanted), np.argsort(rows.keys, kind="stable")
    for s in range(0, len(order), 1024):
        some = order[s:s + 1024]
        scores = (wanted.vectors @ rows.vectors[some].T).astype(np.int64)
        lists.add(np.arange(len(wanted.keys)), rows.keys[some], rows.labels[some], scores)
    return replace(wanted, floor=lists.scores[:, :, -1])


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(table: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   low: int = LOW, high: int = HIGH, codes: int = CODES, sample: int = SAMPLE, block: int = ANCHORS) -> DataFrame:
    """For each row of `integers` that fulfils `anchors`: its best `positives` other rows of the same label, and for each of
    these the best `negatives` rows of other labels whose score lies between `low` and `high` percent of the positive's.

    Higher inner products come first, ties by the smaller key; fewer rows than asked for are all returned. Scores are exact, and
    so are the lists: radii hold for the rows a task has at hand, thresholds only rise. An anchor without positives or
    windows gives no row; an empty table gives none. Of a table whose scores could pass 2^52 nothing is returned but an error.

    To the driver go the sample (at most `sample` rows), codebooks, and one block of at most `block` anchors at a time
    with their positives; the same is broadcast. Blocks are read off the anchors in order of cell, so that near anchors share one.
    """
    spark, out = table.sparkSession, fresh_dir(table.sparkSession, "negatives")
    table = written(table, "vectors")
    books, seen, rows = fit(table, sample, codes)
    sent = spark.sparkContext.broadcast(books)
    index = indexed(table, sent, rows)
    chosen, n = index.filter(anchors), 0
    for part in anchor_parts(chosen, chosen.count(), block):
        for some in local_blocks(part, block):
            wanted = block_wanted(some, books.dim, positives)
            result = mined(index, sent, seen, wanted, negatives, low, high)
            result.write.mode("overwrite").parquet(f"{out}/block={n}")
            n += 1
    return spark.read.schema(RESULT).parquet(out).drop("block") if n else spark.createDataFrame([], RESULT)


def anchor_parts(chosen: DataFrame, total: int, block: int) -> Iterator[DataFrame]:
    """The anchors in parts of about `block`, by ranges of cells."""
    if total <= block:
        yield chosen
        return
    parts = chosen.repartitionByRange(-(-total // block), "a", "b", "key").withColumn("part", F.spark_partition_id())
    parts = written(parts, "anchors")
    for row in parts.select("part").distinct().orderBy("part").collect():
        yield parts.filter(F.col("part") == row.part)


def local_blocks(rows: DataFrame, block: int) -> Iterator[list]:
    """The rows of one block on the driver, in slices of at most `block`: range partitions are only about equal."""
    held = []
    for r in rows.toLocalIterator():
        held.append(r)
        if len(held) == block:
            yield held
            held = []
    if held:
        yield held


def block_wanted(some: list, dim: int, positives: int) -> Wanted:
    """The positives of a block of anchors: one list each, of any score."""
    none = np.full((len(some), 1), NONE, np.int64)
    return Wanted(np.array([r.key for r in some], np.int64), np.array([r.label for r in some], np.int64), padded([r.q for r in some], dim),
                  True, positives, none, -none, none)


def mined(index: DataFrame, books, seen: Rows, first: Wanted, negatives: int, low: int, high: int) -> DataFrame:
    """The result for one block of anchors, whose positives are found first and written."""
    context = index.sparkSession.sparkContext
    near = written(searched(index, books, context.broadcast(with_floors(seen, first))), "positives")
    score = np.full((len(first.keys), first.best), NONE, np.int64)
    place = {k: i for i, k in enumerate(first.keys.tolist())}
    for r in near.select("anchor_id", "rank", "score").collect():
        score[place[r.anchor_id], r.rank - 1] = r.score
    known = score > NONE
    lowest = np.where(known, -((-low * score) // OF), 1)  # rounded up; where there is no positive the window is empty
    highest = np.where(known, high * score // OF, 0)
    second = replace(first, own=False, best=negatives, low=lowest, high=highest, floor=np.full(score.shape, NONE, np.int64))
    found = searched(index, books, context.broadcast(with_floors(seen, second)))
    ids = near.select("anchor_id", (F.col("rank") - 1).alias("list"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(ids, ["anchor_id", "list"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
