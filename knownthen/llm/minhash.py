"""Near-duplicates by MinHash with sequential Bayesian verification.

Signatures of 320 hashes, eight bits each, are cut into 64 bands of five. Documents with the same shingle set are one class, and
only classes go on. Candidates share a band. Their signatures are compared batch by batch, and a pair is pruned once the
posterior probability that its similarity reaches the threshold is below a chosen miss probability; what survives is verified
on full shingle sets.

No bucket is expanded into all pairs. First each class of a bucket meets the bucket's smallest. Then only classes that
are still in different components are compared with each other, in blocks of bounded size, and a pair leaves its block only if it
survives there, and only in the first band it shares. The survivors of a block are verified together, so each shingle set goes
there once, however many pairs it is in.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from knownthen.llm.components import components
from knownthen.llm.memo import slices
from knownthen.sources.shared import written

SHINGLE, PERCENT = 5, 75
BANDS, ROWS = 64, 5
HASHES = BANDS * ROWS
#: Sizes of the signature prefix after each batch, and the chance to lose a pair of the threshold's similarity at each.
BATCHES, MISS = (32, 64, 128, 192, HASHES), 1e-7
#: A block holds about so many classes and so many shingles, whichever is reached first.
BLOCK, BLOCK_SHINGLES = 512, 500_000

_rng = np.random.default_rng(20240229)
_MULTIPLY = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_ODD = [np.uint64(int(x) | 1) for x in _rng.integers(1 << 62, 1 << 63, SHINGLE + 1, dtype=np.uint64)]


class Shingler:
    """Distinct hashed shingles of a text, sorted: words split at ASCII white space, A-Z in lower case."""

    def __init__(self, size: int = SHINGLE):
        self.size = size

    def all(self, text: str | None) -> np.ndarray:
        """One hash per position; a text with fewer words than a shingle has one for the whole."""
        words = (text or "").encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        x = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        n = min(self.size, len(words))
        at = len(words) - n + 1
        s = x[:at] * _ODD[0] + np.uint64(n)
        for i in range(1, n):
            s = (s ^ (s >> np.uint64(29))) * _ODD[i] + x[i:at + i]
        s ^= s >> np.uint64(32)
        s *= _ODD[-1]
        return s ^ (s >> np.uint64(29))

    def distinct(self, text: str | None) -> np.ndarray:
        return np.unique(self.all(text))


def signature(shingles: np.ndarray) -> np.ndarray:
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 512):
        np.minimum(least, (low[at:at + 512, None] * _MULTIPLY + _ADD).min(0), out=least)
    return ((least ^ (least >> np.uint32(15))) & np.uint32(255)).astype(np.uint8)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A band's number and its bytes as one number."""
    key = np.arange(BANDS, dtype=np.int64)
    for i in range(ROWS):
        key = (key << 8) | sig.reshape(BANDS, ROWS)[:, i]
    return key


def least_matches(n: int, percent: int, miss: float) -> int:
    """The fewest matches of n hashes with which the posterior probability of a similarity of `percent` is not below `miss`
    (uniform prior; eight-bit hashes also agree by chance)."""
    t = percent / 100
    t += (1 - t) / 256
    total = 0.0
    for m in range(n + 1):
        total += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(t)
                          + (n + 1 - m) * math.log1p(-t)) if t < 1 else 0.0
        if total >= miss:
            return m
    return n


def signatures(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, the set's fingerprint (null if empty), signature and band keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for part in slices(batch):
                n, prints, sigs, keys = [], [], [], []
                for t in part.column(1).to_pylist():
                    s = shingler.distinct(t)
                    n.append(len(s))
                    if len(s):
                        sig = signature(s)
                        prints.append(xxhash.xxh3_128_digest(s.tobytes()))
                        sigs.append(sig.tobytes())
                        keys.append(band_keys(sig))
                    else:
                        prints.append(None), sigs.append(None), keys.append([])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(sigs, pa.binary()),
                     pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "print", "sig", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(
        run, "doc_id long, n_shingles long, print binary, sig binary, keys array<bigint>")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, HASHES)


def _sizes_fit(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return np.minimum(a, b) * 100 >= np.maximum(a, b) * percent


def pruned(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes whose signatures survive all batches."""
    need = [least_matches(n, percent, MISS) for n in BATCHES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = _matrix(batch.column(2)), _matrix(batch.column(3))
            go = np.flatnonzero(_sizes_fit(batch.column(4).to_numpy(), batch.column(5).to_numpy(), percent))
            done, matches = 0, np.zeros(len(go), np.int64)
            for n, least in zip(BATCHES, need):
                matches += (a[go, done:n] == b[go, done:n]).sum(1)
                alive = matches >= least
                go, matches, done = go[alive], matches[alive], n
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(go)) for i in (0, 1)], names=["a", "b"])

    side = lambda x: reps.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n_shingles").alias(f"n_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sig_a", "sig_b", "n_a", "n_b")
    return both.mapInArrow(run, "a long, b long")


def shingle_sets(asked: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """node, members (the full shingle set) of the documents asked for by doc_id, as a table."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for part in slices(batch):
                made = [shingler.distinct(t).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], names=["node", "members"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).join(asked, "doc_id", "left_semi")
    return written(texts.mapInArrow(sets, "node long, members binary"), "sets")


def similar(x: bytes, y: bytes, percent: int) -> bool:
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def verified(pairs: DataFrame, docs: DataFrame, percent: int, text: str = "text") -> DataFrame:
    """Pairs (a, b) of doc_ids with 100 * intersection >= percent * union of their full shingle sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 512):
                good = [similar(x, y, percent) for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                yield part.select([0, 1]).filter(pa.array(good, pa.bool_()))

    members = shingle_sets(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), docs, text)
    side = lambda x: members.withColumnsRenamed({"node": x, "members": f"set_{x}"})
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b")
    return both.mapInArrow(run, "a long, b long").distinct()


def _across(entries: DataFrame, percent: int) -> DataFrame:
    """A row per block of a bucket: the surviving pairs (arrays a and b) of classes in different components.
    entries: key, node, comp, n_shingles, sig, and blocks of the bucket."""
    need = [least_matches(n, percent, MISS) for n in BATCHES]

    def run(key, table):
        band, first_block, second_block = (k.as_py() for k in key)
        band >>= 8 * ROWS
        node, comp, n, block = (table.column(c).to_numpy() for c in ("node", "comp", "n_shingles", "block"))
        sig = _matrix(table.column("sig"))
        left = np.flatnonzero(block == first_block)
        right = np.flatnonzero(block == second_block)
        i, j = (x.ravel() for x in np.meshgrid(left, right, indexing="ij"))
        go = (comp[i] != comp[j]) & _sizes_fit(n[i], n[j], percent)
        if first_block == second_block:
            go &= i < j
        i, j = i[go], j[go]
        done, matches = 0, np.zeros(len(i), np.int64)
        for size, least in zip(BATCHES, need):
            for at in range(0, len(i), 16384):
                s = slice(at, at + 16384)
                matches[s] += (sig[i[s], done:size] == sig[j[s], done:size]).sum(1)
            alive = matches >= least
            i, j, matches, done = i[alive], j[alive], matches[alive], size
        if len(i):
            shared = (sig[i] == sig[j]).reshape(len(i), BANDS, ROWS).all(2).argmax(1)
            i, j = i[shared == band], j[shared == band]
        a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
        rows = [tuple(k.as_py() for k in key) + (a.tolist(), b.tolist())] if len(a) else []
        pairs = pa.list_(pa.int64())
        kinds = [("key", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("a", pairs), ("b", pairs)]
        return pa.table([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])

    blocks = F.col("blocks")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    dealt = entries.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    return dealt.groupBy("key", "low", "high").applyInArrow(run, "key long, low int, high int, a array<bigint>, b array<bigint>")


def _verified_blocks(jobs: DataFrame, docs: DataFrame, percent: int, text: str) -> DataFrame:
    """The pairs (a, b) of the blocks' arrays whose full shingle sets are similar enough."""
    def run(key, pairs, sets):
        of: dict[int, list[bytes]] = {}
        for node, members in zip(sets.column("node").to_pylist(), sets.column("members").to_pylist()):
            of.setdefault(node, []).append(members)
        good = [(a, b) for x, y in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist()) for a, b in zip(x, y)
                if any(similar(s, t, percent) for s in of.get(a, ()) for t in of.get(b, ()))]
        return pa.table([pa.array([g[k] for g in good], pa.int64()) for k in (0, 1)], names=["a", "b"])

    block = ["key", "low", "high"]
    nodes = jobs.select(*block, F.explode(F.array_distinct(F.concat("a", "b"))).alias("node"))
    members = shingle_sets(nodes.select(F.col("node").alias("doc_id")).distinct(), docs, text)
    held = nodes.join(members, "node").select(*block, "node", "members")
    named = jobs.withColumnsRenamed({c: f"_{c}" for c in block})
    return named.groupBy(*[f"_{c}" for c in block]).cogroup(held.groupBy(*block)).applyInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked whose shingle sets have a Jaccard similarity of `percent` or more; component_id is the smallest doc_id
    that links reach. Texts without words (null, empty, blank) are linked with nothing. Rows that share a doc_id are one vertex: what
    either text links to is reachable from it. A row without doc_id is linked with nothing and has no component_id. An empty
    table gives no rows. Other columns of `docs` are not read.
    """
    docs = docs.select("doc_id", text)
    sigs = written(signatures(docs, text), "signatures")
    real = sigs.filter(F.col("print").isNotNull() & F.col("doc_id").isNotNull())
    classes = real.groupBy("print").agg(F.min("doc_id").alias("node"))
    reps = written(real.join(classes.select("print", F.col("node").alias("doc_id")), ["print", "doc_id"], "left_semi")
                   .select(F.col("doc_id").alias("node"), "n_shingles", "sig", "keys"), "classes")
    banded = reps.select("node", "n_shingles", F.explode("keys").alias("key"))
    buckets = (banded.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("_last"))
               .filter(F.col("pivot") < F.col("_last")).drop("_last"))
    entries = written(banded.join(buckets, "key"), "buckets")
    stars = entries.filter(F.col("node") > F.col("pivot")).select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    tried = written(pruned(stars, reps, percent).distinct(), "stars")
    links = written(verified(tried, docs, percent, text), "links")
    first = components(links)
    labelled = entries.join(first, "node", "left").select("key", "node", "n_shingles", F.coalesce("component", "node").alias("comp")).distinct()
    labelled = written(labelled, "labelled")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    open_ = (labelled.groupBy("key").agg(F.min("comp").alias("_a"), F.max("comp").alias("_b"), blocks.alias("blocks"))
             .filter(F.col("_a") < F.col("_b")).select("key", "blocks"))
    across = labelled.join(open_, "key").join(reps.select("node", "sig"), "node")
    links = links.union(_verified_blocks(written(_across(across, percent), "across"), docs, percent, text))
    # two texts of one doc_id join their classes
    twice = real.groupBy("doc_id").agg(F.min("print").alias("_a"), F.max("print").alias("_b")).filter("_a != _b").select("doc_id")
    same = real.join(twice, "doc_id", "left_semi").join(classes, "print").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    joined = components(links.union(same))
    found = (classes.join(joined, "node", "left")
             .select("print", F.coalesce("component", "node").alias("component_id")))
    alone = sigs.filter(F.col("print").isNull() | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = real.select("doc_id", "n_shingles", "print").join(found, "print").drop("print").union(alone)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """One document of each group, with the columns of `docs`; rows without doc_id stay."""
    kept = near_duplicates(docs, percent, text).filter("kept").select(F.col("doc_id").alias("_kept")).distinct()
    one = docs.join(kept, docs["doc_id"].cast("long") == F.col("_kept"), "left_semi").dropDuplicates(["doc_id"])
    return one.unionByName(docs.filter(F.col("doc_id").isNull()))
