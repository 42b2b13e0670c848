"""Web archives: one gzip member per record, written by tasks, read back in byte ranges.

A reading task gets a range of a file. It looks for the gzip magic from the start of its range on, takes a place for a
member if that inflates to a WARC header and further members follow it without a gap to the end of the range, and then goes
from member to member. It owns the records that start inside its range, to whose end it reads on; so each record is
read once, wherever a file is cut.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from knownthen.llm.hot import dealt_join
from knownthen.sources.shared import fresh_dir, written

MAGIC = b"\x1f\x8b\x08"
SPLIT = 32 << 20
CHUNK = 1 << 20
#: an inflated header may be so long
HEADER = 1 << 20
#: tasks that read at most; each takes several ranges where there are more
TASKS = 50_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"
FILES = "path string, bytes long, records long"
RECORDS = ("path string, offset long, length long, record_type string, record_id string, target_uri string, refers_to string, "
           "payload_digest string, payload_bytes long, headers map<string,string>, payload binary")


# --- writing ---------------------------------------------------------------------------


def urn(key: str | None) -> str:
    return f"<{URN}{quote(key, safe='')}>" if key is not None else f"<{URN.rstrip(':')}>"


def member(kind: str, record_id: str, block: bytes, content: str, date: str, more: list[tuple[str, str]]) -> bytes:
    """One record as a gzip member."""
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date), *more,
              ("Content-Type", content), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress(head.encode()) + gz.compress(block) + gz.compress(b"\r\n\r\n") + gz.flush()


def page_record(key: str | None, url: str | None, payload: bytes, digest: str, original: str | None, date: str) -> bytes:
    """A response, or a revisit of the record of page `original`, which leaves the payload out and states its length."""
    more = [] if url is None else [("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~"))]
    more.append(("WARC-Payload-Digest", "sha1:" + digest))
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    content = "application/http; msgtype=response"
    if original is None:
        return member("response", urn(key), head + payload, content, date, more)
    more += [("WARC-Profile", PROFILE), ("WARC-Refers-To", urn(original)), ("WARC-Payload-Length", str(len(payload)))]
    return member("revisit", urn(key), head, content, date, more)


def archived(pages: DataFrame, folder: str | None = None, *, key: str = "page_id", url: str = "url", payload: str = "html",
             least: int = 0, date: str = DATE) -> DataFrame:
    """Write one record per row and return the files: path, bytes, records.

    Of rows with equal payloads of at least `least` bytes, the one with the smallest key is the response, the others revisit
    it; smaller payloads are responses each. A null payload is empty, a null URL is left out, a null key is larger than
    all others and has a record id of its own. Rows that repeat the smallest key of their payload are responses too.
    Only these three columns are read, whatever else the table has; an empty table writes no file.

    Each task writes a file under a new name in `folder` (by default a new one in the shared folder), and the returned
    table, which Spark commits, names those of successful attempts: what a lost executor left is in no list.
    `folder` is a path or a URI that `pyarrow.fs` opens and all executors share. Payloads are hashed by SHA-1 of 160 bits, equal
    hashes count as equal. Only keys of payloads that occur twice are joined, broadcast if they are small, else by salted
    shuffle; one record must fit into a task's memory.
    """
    spark = pages.sparkSession
    folder = folder or fresh_dir(spark, "warc")
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), body.alias("b"), F.sha1(body).alias("sha"))
    twice = (pages.select(F.col(key).alias("k"), body.alias("b")).filter(F.length("b") >= least)
             .groupBy(F.sha1("b").alias("sha")).agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    twice = written(twice, "payloads")
    joined = dealt_join(rows, twice, "sha", "n", F.col("k"))
    revisit = F.col("first").isNotNull() & (F.length("b") >= least) & (F.col("k").isNull() | (F.col("k") != F.col("first")))
    out = joined.select(F.col("k").cast("string"), "u", "b", "sha", F.when(revisit, F.col("first").cast("string")).alias("o"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = pyarrow.fs.FileSystem.from_uri(folder)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        n, sink = 0, None
        for batch in batches:
            for i in range(batch.num_rows):
                if sink is None:
                    fs.create_dir(at, recursive=True)
                    sink = fs.open_output_stream(f"{at}/{name}", compression=None)
                    sink.write(member("warcinfo", f"<urn:uuid:{uuid.uuid4()}>", b"software: knownthen\r\nformat: WARC File Format 1.1\r\n",
                                      "application/warc-fields", date, [("WARC-Filename", name)]))
                k, u, b, sha, o = (batch.column(c)[i].as_py() for c in range(5))
                sink.write(page_record(k, u, b, base64.b32encode(bytes.fromhex(sha)).decode(), o, date))
                n += 1
        if sink is not None:
            size = sink.tell()
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "bytes": pa.array([size], pa.int64()), "records": pa.array([n + 1], pa.int64())})

    return written(out.mapInArrow(run, FILES), "warc-files")


# --- reading ---------------------------------------------------------------------------


class Source:
    """Bytes of a file by position."""

    def __init__(self, path: str):
        fs, at = pyarrow.fs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(at)
        self.size = self.file.size()
        self.path = path

    def at(self, start: int, length: int = CHUNK) -> bytes:
        return self.file.read_at(min(length, max(0, self.size - start)), start)


def inflated(source: Source, start: int, most: int | None = None) -> tuple[bytes, int | None]:
    """What the member at `start` holds and where it ends; with `most`, only its header, or so many bytes, and no end."""
    gz, out, size, at = zlib.decompressobj(31), [], 0, start
    while not gz.eof:
        piece = source.at(at, CHUNK if most is None else 1 << 12)
        if not piece:
            raise zlib.error("the file ends inside a member")
        at += len(piece)
        out.append(gz.decompress(piece))
        size += len(out[-1])
        if most is not None and (size >= most or b"\r\n\r\n" in b"".join(out)):
            return b"".join(out), None
    return b"".join(out), at - len(gz.unused_data)


def header_of(data: bytes) -> tuple[dict[str, str], int] | None:
    """The named fields of a record and where its block begins; names in lower case, the first of repeated ones."""
    end = data.find(b"\r\n\r\n")
    if end < 0 or not data.startswith(b"WARC/"):
        return None
    fields: dict[str, str] = {}
    for line in data[:end].decode("utf-8", "replace").replace("\r\n ", " ").replace("\r\n\t", " ").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields.setdefault(name.strip().lower(), value.strip())
    return (fields, end + 4) if "warc-type" in fields and fields.get("content-length", "").isdigit() else None


def starts_record(source: Source, at: int, end: int) -> bool:
    """Does a member at this place inflate to a WARC header, and so each one after it up to `end`, without a gap?

    A member inside the payload of another one passes as long as others follow it there, but after the last of them comes the rest of
    that payload. Only a payload that holds an archive, uncompressed, over the end of the range is not told apart.
    """
    try:
        while at < min(end, source.size):
            if header_of(inflated(source, at, HEADER)[0]) is None:
                return False
            at = inflated(source, at)[1]
    except zlib.error:
        return False
    return True


def first_record(source: Source, start: int, end: int) -> int | None:
    """Where the first record begins that starts in [start, end). A file begins with one."""
    if start == 0:
        return 0
    at = start
    while at < end:
        piece = source.at(at, min(CHUNK, end - at) + len(MAGIC) - 1)
        found = piece.find(MAGIC)
        while found >= 0:
            if starts_record(source, at + found, end):
                return at + found
            found = piece.find(MAGIC, found + 1)
        at += CHUNK
    return None


def records_of(source: Source, start: int, end: int) -> Iterator[tuple]:
    """The records that start in a range, as rows of `RECORDS`. Anything but a record between two records is an error."""
    at = first_record(source, start, end)
    while at is not None and at < min(end, source.size):
        try:
            data, after = inflated(source, at)
        except zlib.error as e:
            raise ValueError(f"damaged record at {at} of {source.path}: {e}") from e
        parsed = header_of(data)
        if parsed is None or len(data) < parsed[1] + int(parsed[0]["content-length"]):
            raise ValueError(f"no whole record at {at} of {source.path}")
        fields, begin = parsed
        block = data[begin:begin + int(fields["content-length"])]
        if fields.get("content-type", "").startswith("application/http"):
            block = block[block.find(b"\r\n\r\n") + 4:] if b"\r\n\r\n" in block else b""
        kind, stated = fields["warc-type"], fields.get("warc-payload-digest", "")
        digest = stated.removeprefix("sha1:")
        if kind != "revisit":
            digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
            if stated.startswith("sha1:") and stated != "sha1:" + digest:
                raise ValueError(f"the record at {at} of {source.path} does not have the payload of its digest")
        length = int(fields.get("warc-payload-length", -1)) if kind == "revisit" else len(block)
        yield (source.path, at, after - at, kind, fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-refers-to"),
               digest, None if length < 0 else length, list(fields.items()), None if kind == "revisit" else block)
        at = after


def records(spark: SparkSession, files: DataFrame, split: int = SPLIT) -> DataFrame:
    """All records of the listed files (path, bytes), read in ranges of `split` bytes.

    payload is the body of an HTTP message, or the whole block of other records, and null in a revisit, whose
    payload_digest and payload_bytes are those it states (payload_bytes null if it does not). A digest that does not fit its
    payload, a damaged member, and bytes between members fail the read; nothing is skipped. An empty list gives no
    records; a file listed twice is read twice.
    """
    ranges = files.filter("bytes > 0").select("path", F.explode(F.expr(f"sequence(0L, (bytes - 1) div {split}L)")).alias("k"))
    n = files.agg(F.sum(F.expr(f"(bytes + {split - 1}L) div {split}L"))).first()[0] or 0
    # a fixed number: sized by its few bytes, the list would end in one task
    ranges = ranges.repartition(max(1, min(TASKS, n)))
    schema = spark.createDataFrame([], RECORDS).schema
    arrow = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()),
                       ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
                       ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), arrow)], schema=arrow)
        rows, held = [], 0
        for batch in batches:
            for path, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                source = Source(path)
                for row in records_of(source, k * split, (k + 1) * split):
                    rows.append(row)
                    held += len(row[-1] or b"") + 500
                    if held > 8 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
        if rows:
            yield batch_of(rows)

    return ranges.mapInArrow(run, schema)


def page_key(record_id: str) -> F.Column:
    """The key in a record id that `urn` made; null for that of a null key."""
    inside = F.regexp_extract(record_id, f"^<{URN}(.*)>$", 1)
    return F.when(F.col(record_id).startswith(f"<{URN}"), F.url_decode(F.replace(inside, F.lit("+"), F.lit("%2B"))))


def page_records(pages: DataFrame, folder: str | None = None, least: int = 0, split: int = SPLIT) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each row of `pages`, written to archives and read
    back. See `archived` for nulls, repeats and ties."""
    files = archived(pages, folder, least=least)
    kind = pages.schema["page_id"].dataType
    read = records(pages.sparkSession, files, split).filter(F.col("record_type").isin("response", "revisit"))
    return read.select(page_key("record_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       page_key("refers_to").cast(kind).alias("refers_to"))
