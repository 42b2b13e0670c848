"""Language identification by compression.

Each language has a raw-content dictionary cut from a bounded sample of labelled documents. A text is encoded with every
dictionary, in pieces, and the language whose total is smallest is chosen. Where the second smallest is hardly larger, the text is
rejected as undecided.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from knownthen.llm.memo import slices

#: Bounds of the fit: documents per language, and characters from the middle of each.
SAMPLE_DOCS, SAMPLE_CHARS = 400, 1024
#: Only so many labels are learned, the most frequent ones; rarer ones are never predicted.
MAX_LANGS = 200
#: A label's documents are first ranked in so many groups, then the first of each together.
SALTS = 64
#: No dictionary is longer than this many times the shortest of LEAST_BYTES or more: a longer one alone makes encodings smaller. Labels
#: with less sampled text keep all of it, but do not shorten the others.
MAX_RATIO, LEAST_BYTES = 2, 32768
#: Texts are encoded in pieces of so many characters, so that a long text does not become its own dictionary.
PIECE_CHARS, LEVEL = 2048, 9
#: A text is rejected where the second smallest encoding is larger by less than this share, or by fewer bytes.
MIN_MARGIN, MIN_BYTES = 0.01, 1
UNKNOWN = "und"
#: characters of the Unicode category L; numbers such as ½ are none
LETTER = regex.compile(r"\p{L}")
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """The words of a text in lower case, without digits and marks, which say little about the language."""
    return _OTHER.sub(" ", text.lower())


def learned(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> dict[str, bytes]:
    """Dictionary content per language from columns doc_id, text, lang: the documents of the smallest hashes of doc_id.

    The most frequent language comes first. Languages without any sampled text are left out, and those beyond the `MAX_LANGS` most
    frequent, so what reaches the driver is bounded. Ids are picked first, so texts of others are never sorted or moved, and in two
    steps, so that no task ranks a whole language. Rows that share a doc_id count as one document; parts that repeat count once.
    """
    known = docs.filter(F.col("lang").isNotNull())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(MAX_LANGS).collect()}
    known = known.filter(F.col("lang").isin(list(counts)))
    hashed = known.filter(F.col("doc_id").isNotNull()).select("lang", "doc_id", F.xxhash64("doc_id").alias("_h"))
    some, order = hashed.withColumn("_salt", F.pmod("_h", F.lit(SALTS))), ["_h", "doc_id"]
    for group in (["lang", "_salt"], ["lang"]):
        some = (some.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
                .filter(F.col("_n") <= sample_docs).drop("_n"))
    ids = some.select("doc_id").distinct().collect()
    middle = F.greatest(F.lit(1), (F.length("text") / 2).cast("int") - sample_chars // 2)
    rows = (known.filter(F.col("doc_id").isin([r.doc_id for r in ids]) & F.col("text").isNotNull())
            .select("lang", "doc_id", F.substring("text", middle, F.lit(sample_chars)).alias("part")).collect() if ids else [])
    parts: dict[str, dict[str, None]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.doc_id, r.part)):
        if LETTER.search(r.part):
            parts.setdefault(r.lang, {})[letters(r.part)] = None
    contents = {lang: "\n".join(p).encode() for lang, p in parts.items()}
    most = MAX_RATIO * min((n for n in map(len, contents.values()) if n >= LEAST_BYTES), default=LEAST_BYTES)
    return {lang: contents[lang][:most] for lang in sorted(contents, key=lambda x: (-counts.get(x, 0), x))}


class Classifier:
    def __init__(self, contents: dict[str, bytes]):
        self.encoders = {}
        for lang in contents:
            d = zstandard.ZstdCompressionDict(contents[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.encoders[lang] = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False,
                                                           write_dict_id=False)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, relative margin over the second, and whether the text is rejected."""
        if not text or not self.encoders or not LETTER.search(text):
            return UNKNOWN, 0.0, True
        text = letters(text)
        pieces = [text[i:i + PIECE_CHARS].encode() for i in range(0, len(text), PIECE_CHARS)]
        sizes = sorted(((sum(len(e.compress(p)) for p in pieces), lang) for lang, e in self.encoders.items()), key=lambda x: x[0])
        if len(sizes) == 1:
            return sizes[0][1], 1.0, False
        (best, lang), (second, _) = sizes[:2]
        margin = (second - best) / second
        return lang, margin, margin < MIN_MARGIN or second - best < MIN_BYTES


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predicted(docs: DataFrame, contents: dict[str, bytes], text: str = "text") -> DataFrame:
    """`docs` with lang_pred, score (0 to 1) and rejected.

    `und` with score 0, and rejected: null and empty texts, texts without a letter, all texts if nothing was learned. Equal sizes
    choose the first language of `contents` and are rejected. Columns named like the new ones are replaced.
    """
    new = [("lang_pred", "string", pa.string()), ("score", "double", pa.float64()), ("rejected", "boolean", pa.bool_())]
    keep = [c for c in docs.columns if c == text or c not in [n for n, _, _ in new]]
    where = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(contents)
        for batch in batches:
            for part in slices(batch):
                rows = [model.predict(t) for t in part.column(where).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + [pa.array(c, t) for c, (_, _, t) in zip(zip(*rows), new)],
                                                 names=keep + [n for n, _, _ in new])

    schema = StructType(docs.select(*keep).schema.fields + StructType.fromDDL(", ".join(f"{n} {k}" for n, k, _ in new)).fields)
    return docs.select(*keep).mapInArrow(run, schema)
