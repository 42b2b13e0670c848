"""Secrets in texts: fixed patterns, and a linear-chain conditional random field over words.

The field tags each word as secret begin, inside or outside from its shape, its neighbours and features of the whole text, and
is decoded by Viterbi. It learns from the words that the patterns mark in a bounded sample of documents, with the neighbours that
give a pattern away hidden in part of the sample, so that it finds values of the same kind where no pattern fits.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from knownthen.llm.memo import Memo, slices

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: Runs shorter than the least length are dropped, which the patterns may say at once.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "crf")

BEGIN, INSIDE, OUTSIDE = range(3)
#: Bounds of the fit: documents sampled, windows of words kept of each sort, words in a window, steps.
SAMPLE_DOCS, WINDOWS, WIDTH, STEPS = 3000, 3000, 15, 80
KEYWORD = re.compile(r"passw|passwd|secret|token|api_?key|credential|bearer|auth|key", re.I | re.A)
NEVER = -1e6


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Matches of the fixed patterns as (start, kind, end), in code points, sorted."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _bucket(n: int) -> int:
    return n.bit_length() if n < 16 else 5 + (n >= 20) + (n >= 24) + (n >= 32) + (n >= 40) + (n >= 64)


def shape(word: str) -> tuple[str, ...]:
    """Features of a word's form; a word's class."""
    core = word.strip(".,;:!?\"'()[]{}")
    value = re.split(r"[:=][\"']?", core, maxsplit=1)[-1] or core
    digits = sum(map(str.isdigit, value))
    features = [f"len{_bucket(len(value))}"]
    if digits:
        flips = sum(a.isdigit() != b.isdigit() for a, b in zip(value, value[1:]))
        features += ["digit", f"share{4 * digits // len(value)}", f"flips{min(flips, 6) // 2}"]
    if value.isascii() and value.isalnum():
        features.append("plain" if not digits else "alnum")
    if not value.isascii():
        features.append("beyond")
    if re.fullmatch(r"[0-9a-fA-F]+", value):
        features.append("hex")
    if re.fullmatch(r"[A-Za-z0-9+/_=-]+", value):
        features.append("base64")
    elif re.search(r"[^\w+/.=-]", value):
        features.append("odd")
    if value[:1].isupper() and value[1:].islower():
        features.append("title")
    elif value.isupper():
        features.append("upper")
    elif not value.islower() and not value.isdigit():
        features.append("mixed")
    if len(value) < len(core):
        features.append("pair")
    if KEYWORD.search(word):
        features.append("keyword")
    if word[-1:] in ":=":
        features.append("colon")
    return tuple(features)


def file_features(text: str, n_words: int) -> tuple[str, ...]:
    marks = text.count("=") + text.count(":") + text.count("{")
    return f"f:marks{min(3, marks * 50 // max(n_words, 1))}", f"f:len{min(n_words, 9999).bit_length() // 3}"


@dataclass
class Field:
    """Weights of a fitted field: features (o: own, p: previous, n: next, f: file) to tags, and transitions between tags."""

    weights: dict[str, np.ndarray]
    moves: np.ndarray
    start: np.ndarray

    def of(self, features) -> np.ndarray:
        zero = np.zeros(3)
        return sum((self.weights.get(x, zero) for x in features), zero)


def _marks(text: str) -> tuple[list[str], np.ndarray]:
    """Words of a text and the tag that the fixed patterns give each."""
    words, tags, spans = [], [], []
    for s, kind, e in base_spans(text):
        m = ASSIGN.match(text, s) if kind == 0 else None
        spans.append((m.start(2), m.end(2)) if m else (s, e))
    spans.sort()
    k, before = 0, -1
    for m in re.finditer(r"\S+", text):
        while k < len(spans) and spans[k][1] <= m.start():
            k += 1
        inside = k < len(spans) and spans[k][0] < m.end()
        tags.append(OUTSIDE if not inside else INSIDE if before == k else BEGIN)
        before = k if inside else -1
        words.append(m[0])
    return words, np.array(tags, np.int64)


def fit(texts: list[str], seed: int = 5) -> Field:
    """Maximum likelihood with a small quadratic penalty, by Adam over windows around marked words and over others."""
    rng = np.random.default_rng(seed)
    near, far = [], []
    for text in texts:
        words, tags = _marks(text)
        if not words:
            continue
        f = file_features(text, len(words))
        hot = np.flatnonzero(tags == BEGIN)
        for at in hot[:20]:
            a = max(0, int(at) - int(rng.integers(2, WIDTH - 2)))
            near.append((words, tags, a, f))
        for at in rng.integers(0, len(words), 3):
            far.append((words, tags, max(0, min(int(at), len(words) - WIDTH)), f))
    pick = lambda xs: [xs[i] for i in rng.permutation(len(xs))[:WINDOWS]]
    windows = pick(near) + pick(far)
    names: dict[str, int] = {}
    rows, gold = [], []
    for words, tags, a, f in windows:
        hide = rng.random() < 0.5  # hidden neighbours leave the form alone to decide
        shapes = [shape(w) for w in words[max(0, a - 1):a + WIDTH + 1]]
        shapes = ([()] if a == 0 else []) + shapes + [()]
        row = []
        for i in range(min(WIDTH, len(words) - a)):
            own = [x for x in shapes[i + 1] if not (hide and x in ("pair", "keyword"))]
            around = [] if hide else [f"p:{x}" for x in shapes[i]] + [f"n:{x}" for x in shapes[i + 2]]
            row.append([names.setdefault(x, len(names)) for x in [f"o:{y}" for y in own] + around + list(f)])
        rows.append(row)
        gold.append(tags[a:a + len(row)])
    n = len(names)
    moves, start = np.zeros((3, 3)), np.zeros(3)
    if not rows:
        return Field({}, moves, start)
    most = max(len(x) for r in rows for x in r)
    x = np.full((len(rows), WIDTH, most), n)
    y = np.full((len(rows), WIDTH), -1)
    for i, (r, g) in enumerate(zip(rows, gold)):
        y[i, :len(g)] = g
        for t, ids in enumerate(r):
            x[i, t, :len(ids)] = ids
    held = y >= 0
    y[:, 0][y[:, 0] == INSIDE] = BEGIN  # a window may start in a secret
    params = np.zeros((n + 1) * 3 + 12)
    m, v = np.zeros_like(params), np.zeros_like(params)
    flat = x.reshape(-1)
    allowed = np.zeros((3, 3))
    allowed[OUTSIDE, INSIDE] = NEVER
    opening = np.array([0, NEVER, 0.0])

    def soft(a, axis):
        top = a.max(axis, keepdims=True)
        return (top + np.log(np.exp(a - top).sum(axis, keepdims=True))).squeeze(axis)

    for step in range(1, STEPS + 1):
        w = params[:(n + 1) * 3].reshape(-1, 3)
        tr, st = params[-12:-3].reshape(3, 3) + allowed, params[-3:] + opening
        e = w[x].sum(2)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = st + e[:, 0]
        for t in range(1, WIDTH):
            alpha[:, t] = np.where(held[:, t, None], soft(alpha[:, t - 1, :, None] + tr, 1) + e[:, t], alpha[:, t - 1])
        for t in range(WIDTH - 2, -1, -1):
            beta[:, t] = np.where(held[:, t + 1, None], soft(tr + (e[:, t + 1] + beta[:, t + 1])[:, None], 2), beta[:, t + 1])
        total = soft(alpha[:, -1], 1)
        p = np.exp(alpha + beta - total[:, None, None]) * held[..., None]
        truth = (y[..., None] == np.arange(3)) * held[..., None]
        error = p - truth
        grad = np.zeros_like(params)
        spread = np.repeat(error.reshape(-1, 3), most, 0)
        grad[:(n + 1) * 3] = np.stack([np.bincount(flat, spread[:, k], n + 1) for k in range(3)], 1).reshape(-1)
        pair = np.zeros((3, 3))
        for t in range(1, WIDTH):
            q = np.exp(alpha[:, t - 1, :, None] + tr + (e[:, t] + beta[:, t])[:, None] - total[:, None, None]) * held[:, t, None, None]
            pair += q.sum(0) - np.einsum("bi,bj->ij", truth[:, t - 1] * held[:, t, None], truth[:, t])
        grad[-12:-3], grad[-3:] = pair.reshape(-1), error[:, 0].sum(0)
        grad = grad / len(rows) + 1e-4 * params
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        params -= 0.2 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        params[n * 3:(n + 1) * 3] = 0
    w = params[:(n + 1) * 3].reshape(-1, 3)
    return Field({k: w[i] for k, i in names.items()}, params[-12:-3].reshape(3, 3) + allowed, params[-3:] + opening)


class Tagger:
    """Viterbi over whole texts. Words of one class share their scores, and words of which no best path can be part are left
    out: where B and I lose more at a word than any change of the transitions and of the next tag could win back, the word is outside."""

    def __init__(self, field: Field):
        self.field, self.classes = field, {}
        self.own, self.before, self.after = [], [], []  # scores of a class at its word, the next and the previous word
        self.number = Memo(self._number, 300_000)
        self.swing, self.swing_inside = self._swings()

    def _swings(self) -> tuple[float, float]:
        """The most that transitions can lose when a word's tag B or I becomes O: where the next tag is not I, and where it is
        and so becomes B (without what the next word's own scores then lose)."""
        t, start, tags = self.field.moves, self.field.start, range(3)
        into = max([t[p, y] - t[p, OUTSIDE] for p in tags for y in (BEGIN, INSIDE)] + [start[BEGIN] - start[OUTSIDE]])
        plain = max([0.0] + [t[y, n] - t[OUTSIDE, n] for y in (BEGIN, INSIDE) for n in (BEGIN, OUTSIDE)])
        inside = max(t[y, INSIDE] - t[OUTSIDE, BEGIN] for y in (BEGIN, INSIDE)) + max([0.0] + [t[INSIDE, n] - t[BEGIN, n] for n in tags])
        return into + plain, into + inside

    def _number(self, word: str) -> int:
        key = shape(word)
        if key not in self.classes:
            self.classes[key] = len(self.classes)
            for scores, prefix in ((self.own, "o"), (self.before, "p"), (self.after, "n")):
                scores.append(self.field.of(f"{prefix}:{x}" for x in key))
            self.tables = tuple(map(np.array, (self.own, self.before, self.after)))
        return self.classes[key]

    def path(self, scores: np.ndarray) -> list[int]:
        best, back = self.field.start + scores[0], []
        for e in scores[1:]:
            reach = best[:, None] + self.field.moves
            back.append(reach.argmax(0))
            best = reach.max(0) + e
        tags = [int(best.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    def emissions(self, text: str, words: list[str]) -> np.ndarray:
        k = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        own, before, after = self.tables
        e = own[k] + self.field.of(file_features(text, len(words)))
        e[1:] += before[k[:-1]]
        e[:-1] += after[k[1:]]
        return e

    def tags(self, text: str) -> tuple[list[tuple[int, int]], int]:
        """Runs of words tagged as one secret, as first word and end, and the number of words."""
        words = text.split()
        if not words or not self.field.weights:
            return [], len(words)
        e = self.emissions(text, words)
        gain = e[:, :2].max(1) - e[:, OUTSIDE]
        repair = np.r_[e[1:, INSIDE] - e[1:, BEGIN], -np.inf]
        possible = gain >= -np.maximum(self.swing, self.swing_inside + repair)
        edge = np.flatnonzero(np.diff(np.r_[0, possible.astype(np.int8), 0]))
        out = []
        for a, b in zip(edge[::2], edge[1::2]):
            lo, hi = max(0, int(a) - 1), min(len(words), int(b) + 1)
            scores = e[lo:hi].copy()
            if lo < a:
                scores[0, :2] = NEVER * 10  # certainly outside
            if hi > b:
                scores[-1, :2] = NEVER * 10
            path = self.path(scores) if lo == 0 else self._inner(scores)
            for i, tag in enumerate(path):
                if tag == BEGIN:
                    out.append([lo + i, lo + i + 1])
                elif tag == INSIDE and out:
                    out[-1][1] = lo + i + 1
        return [tuple(x) for x in out], len(words)

    def _inner(self, scores: np.ndarray) -> list[int]:
        """As `path`, for a stretch that follows a word outside."""
        first = scores.copy()
        first[0] -= self.field.start * (self.field.start > NEVER / 2)
        return self.path(first)

    def spans(self, text: str) -> list[tuple[int, int]]:
        runs, _ = self.tags(text)
        if not runs:
            return []
        places = [m.span() for m in re.finditer(r"\S+", text)]
        out = []
        for a, b in runs:
            s, e = places[a][0], places[b - 1][1]
            m = re.match(r"[\"'(\[{]*[A-Za-z_][A-Za-z0-9_-]*[\"']?[:=]+[\"']?", text[s:places[a][1]])
            if m and s + m.end() < e:
                s += m.end()
            s += len(text[s:e]) - len(text[s:e].lstrip("\"'([{<"))
            e -= len(text[s:e]) - len(text[s:e].rstrip("\"')]}>,;.!?"))
            if s < e:
                out.append((s, e))
        return out


def sample(docs: DataFrame, text: str = "text") -> list[str]:
    """Texts of the documents with the smallest hashes of doc_id: the bounded sample of the fit. Ids are picked first."""
    ids = [r[0] for r in docs.filter(F.col("doc_id").isNotNull()).select("doc_id").distinct()
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).collect()]
    rows = docs.filter(F.col("doc_id").isin(ids) & F.col(text).isNotNull()).select("doc_id", text).collect() if ids else []
    return [r[1] for r in sorted(rows, key=lambda r: (r[0], r[1]))]


def scanned(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """`docs` without the text, with n_assign, n_access, n_hex, n_crf, base_sha256, spans and span_list.

    A null text is empty and has no spans. Spans of the field that overlap a pattern's span are not listed again. Repeated
    rows are scanned each; columns named like the new ones are replaced.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    new = [("n_assign", "bigint", pa.int64()), ("n_access", "bigint", pa.int64()), ("n_hex", "bigint", pa.int64()),
           ("n_crf", "bigint", pa.int64()), ("base_sha256", "string", pa.string()), ("spans", "string", pa.string()),
           ("span_list", "array<struct<kind:string,start:bigint,end:bigint>>", pa.list_(span))]
    keep = [c for c in docs.columns if c != text and c not in [n for n, _, _ in new]]

    def joined(spans):
        return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)

    def scan(tagger: Tagger, text: str) -> tuple:
        base = base_spans(text)
        more = [(s, 3, e) for s, e in tagger.spans(text) if not any(s < y and x < e for x, _, y in base)]
        every = sorted(base + more)
        n = [sum(k == kind for _, kind, _ in every) for k in range(4)]
        return (*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every),
                [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in every])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(field)
        for batch in batches:
            for part in slices(batch):
                rows = [scan(tagger, t or "") for t in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + [pa.array(c, t) for c, (_, _, t) in zip(zip(*rows), new)],
                                                 names=keep + [n for n, _, _ in new])

    schema = StructType(docs.select(*keep).schema.fields + StructType.fromDDL(", ".join(f"{n} {k}" for n, k, _ in new)).fields)
    return docs.select(*keep, text).mapInArrow(run, schema)
