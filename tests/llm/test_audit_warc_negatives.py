"""Filter interactions, web archives and hard negatives against brute force."""

import base64
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from knownthen.llm import multi_index, queries, transducer, warc

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


# --- the transducer and its table --------------------------------------------------------


def measures(t):
    words = re.findall(WORD, t or "")
    return (len(words), len(set(words)), len(re.findall("[A-Z]", t or "")), len(t or ""), len(re.findall(r"[#$%&*|]", t or "")))


TEXTS = [None, "", " ", "\n\t\v\f\r", "a", " a", "a ", "A a A\x1ca", "日本 日本 ÄB🙂", "x\x00y x\x00y", "# $ % & * | #|", "aaaaaaaa aaaaaaab aaaaaaaa",
         "w" * 127 + " " + "w" * 128 + " " + "w" * 129 + " " + "w" * 128, "b" * 5000 + " " + "b" * 5000 + " " + "b" * 4999 + "c", " x y"]


def test_measures_of_odd_texts(documents):
    rows = documents(TEXTS + TEXTS)
    got = {r.doc_id: tuple(r)[-5:] for r in transducer.profiled(rows.select("doc_id", "text")).collect()}
    assert got == {i: measures(t) for i, t in enumerate(TEXTS + TEXTS)}


def test_measures_of_long_texts_and_of_texts_over_several_blocks(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "b", "ab", "Zé", "long" * 40, "#"]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    texts += ["q" * 3000, " " * 3000, "x y " * 2000]
    coded = [t.encode() for t in texts]
    begins = np.cumsum([0, *map(len, coded)])
    want = [measures(t) for t in texts]
    for block in (7, 64, 1000, 1 << 20):
        monkeypatch.setattr(transducer, "BLOCK", block)
        got = transducer.profiles(np.frombuffer(b"".join(coded), np.uint8), begins)
        assert list(map(tuple, got.tolist())) == want


def test_equal_hashes_do_not_make_words_equal(monkeypatch):
    monkeypatch.setattr(transducer.SpanTable, "hashes", lambda self, start, size, doc: np.zeros(len(start), np.int64))
    text = " ".join(f"word{i % 37}" for i in range(300)).encode()
    got = transducer.profiles(np.frombuffer(text * 2, np.uint8), np.array([0, len(text), 2 * len(text)]))
    assert got[:, 1].tolist() == [37, 37]


# --- the audit ---------------------------------------------------------------------------


def brute_audit(docs, labels):
    first = {}
    for i, t, *_ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    rows = []
    for i, t, _, source, _ in docs:
        n, d, c, p, s = measures(t)
        fails = {x for x, bad in zip("ABCDE", (n < 50, 100 * d < 65 * n, 100 * c > 5 * p, s > 0, i is not None and i > first[t or ""])) if bad}
        rows.append((source or "", fails, any(q == 1 for k, q, _ in labels if k == i is not None), any(x == 1 for k, _, x in labels if k == i is not None)))
    out = set()
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = {x: 0 for x in "ABCDE"}
        lines = []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                shapley[x] += len(gone)
                lines.append((order, step, len(left), len(gone), sum(x in r[1] for r in mine) - len(gone), sum(r[1] == {x} for r in mine),
                              sum(r[2] for r in gone), sum(r[3] for r in gone)))
        out |= {(part, *line, shapley[line[0][line[1] - 1]]) for line in lines}
    return out


def test_audit_equals_brute_force(spark, documents, tmp_path):
    rng = random.Random(5)
    pool = ["a b", "", None, "X" * 9 + " y", "p|q", " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i % 9}" for i in range(60)),
            " ".join(f"W{i}" for i in range(60)) + " #", "same same"]
    docs = [(i // 2 if i % 11 == 0 else i, rng.choice(pool), "en", rng.choice(["s", "t", "", None]), 0) for i in range(150)] + [(None, "same same", "en", "s", 0)]
    labels = [(rng.randint(0, 160), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(120)] + [(None, 1, 1)]
    folder = str(tmp_path)
    documents(docs).withColumn("n_words", F.lit("clash")).withColumn("part", F.lit(1)).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    got = queries.op11_filter_audit(spark, folder)
    assert got.columns == "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    assert dict(got.dtypes)["step"] == "int" and dict(got.dtypes)["shapley"] == "bigint"
    assert set(map(tuple, got.collect())) == brute_audit(docs, labels)


def test_audit_of_an_empty_table(spark, documents, tmp_path):
    documents([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert queries.op11_filter_audit(spark, str(tmp_path)).count() == 0


# --- archives ----------------------------------------------------------------------------


PAGES = "page_id long, url string, html string"


def sha(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def pages_of(spark, rows):
    return spark.createDataFrame(rows, PAGES)


def brute_pages(rows, least=0):
    first = {}
    for i, _, t in rows:
        if i is not None and len((t or "").encode()) >= least:
            first[t or ""] = min(first.get(t or "", i), i)
    out = []
    for i, _, t in rows:
        f = first.get(t or "") if len((t or "").encode()) >= least else None
        again = f is not None and i != f
        out.append((i, len((t or "").encode()), sha(t), "revisit" if again else "response", f if again else None))
    return sorted(out, key=repr)


def some_pages():
    rng = random.Random(9)
    bodies = [None, "", "<html>é🙂</html>", "WARC/1.1\r\nWARC-Type: response\r\n\r\n", "x" * 200_000, "\r\n\r\n"] + [f"<p>{rng.random()}</p>" * 30 for _ in range(20)]
    rows = [(i, rng.choice(["http://a/b c", None, "http://x/\r\nWARC-Type: evil", "http://ü/?q=%20"]), rng.choice(bodies)) for i in range(120)]
    return rows + rows[:3] + [(None, "http://n", "<p>only here</p>"), (None, None, None)]


@pytest.mark.parametrize("split", [50, 997, 20_000, 1 << 25])
def test_records_come_back_once_wherever_files_are_cut(spark, split):
    rows = some_pages()
    got = warc.page_records(pages_of(spark, rows).withColumn("sha", F.lit(1)).withColumn("first", F.lit(2)).repartition(2), split=split)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_pages(rows)


def test_small_payloads_are_responses_each_and_a_hot_payload_is_dealt_out(spark, monkeypatch):
    rows = some_pages()
    got = warc.page_records(pages_of(spark, rows), least=30)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_pages(rows, 30)
    monkeypatch.setattr(warc, "dealt_join", lambda *a: __import__("knownthen.llm.hot", fromlist=["x"]).dealt_join(*a, target=2))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(tuple, warc.page_records(pages_of(spark, rows)).collect()), key=repr) == brute_pages(rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_whole_records_of_an_archive(spark, tmp_path):
    rows = [(1, "http://a/", "one"), (2, "http://b/", "one")]
    files = warc.archived(pages_of(spark, rows).coalesce(1), str(tmp_path / "w"))
    assert files.columns == ["path", "bytes", "records"] and files.first().records == 3
    by = {r.record_id: r for r in warc.records(spark, files).collect()}
    one, two = by["<urn:page:1>"], by["<urn:page:2>"]
    assert (one.record_type, bytes(one.payload), one.target_uri, one.headers["content-type"]) == ("response", b"one", "http://a/", "application/http; msgtype=response")
    assert (two.record_type, two.payload, two.refers_to, two.payload_bytes) == ("revisit", None, "<urn:page:1>", 3)
    assert sum(r.length for r in by.values()) == files.first().bytes and {r.record_type for r in by.values()} == {"warcinfo", "response", "revisit"}


def stored(member):
    """The same member without compression."""
    gz = zlib.compressobj(0, zlib.DEFLATED, 31)
    return gz.compress(zlib.decompress(member, 31)) + gz.flush()


def test_magic_and_archives_inside_a_payload_are_no_records(spark, tmp_path):
    inner = b"".join(warc.member("resource", f"<urn:x{i}>", b"z" * 9, "text/plain", warc.DATE, []) for i in range(3))
    hard = random.Random(1).randbytes(9000) + inner + warc.MAGIC * 5 + random.Random(2).randbytes(9000)
    data = b"".join(stored(warc.member("resource", f"<urn:{i}>", hard, "application/octet-stream", warc.DATE, [])) for i in range(4))
    assert inner in data
    path = tmp_path / "a.warc.gz"
    path.write_bytes(data)
    files = spark.createDataFrame([(str(path), len(data))], "path string, bytes long")
    for split in (9000, 11_000, 1 << 20):
        assert sorted(r.record_id for r in warc.records(spark, files, split).collect()) == [f"<urn:{i}>" for i in range(4)]


def test_damage_fails_the_read(spark, tmp_path):
    good = [warc.page_record(str(i), None, b"x" * 500, base64.b32encode(hashlib.sha1(b"x" * 500).digest()).decode(), None, warc.DATE) for i in range(5)]
    wrong = warc.page_record("7", None, b"y", base64.b32encode(b"1" * 20).decode(), None, warc.DATE)
    for name, data in (("cut", b"".join(good)[:-20]), ("between", good[0] + good[1] + b"junk" + good[2]), ("digest", good[0] + wrong + good[1])):
        path = tmp_path / name
        path.write_bytes(data)
        with pytest.raises(Exception, match="record at"):
            warc.records(spark, spark.createDataFrame([(str(path), len(data))], "path string, bytes long")).collect()


def test_no_pages(spark):
    assert warc.page_records(pages_of(spark, [])).collect() == []


# --- hard negatives ------------------------------------------------------------------------


def brute_negatives(rows, every):
    held = {}
    for k, v, label in rows:
        if k is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in v]
        held[k] = min(held.get(k, (label, q)), (label, q))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (la, qa) in held.items():
        if a % every:
            continue
        scored = [(-dot(qa, q), k, label) for k, (label, q) in held.items() if k != a]
        for s, p, _ in sorted(x for x in scored if x[2] == la)[:5]:
            best = sorted(x for x in scored if x[2] != la and 80 * -s <= 100 * -x[0] <= 100 * -s)[:5]
            out += [(a, p, i, k, -s, -n) for i, (n, k, _) in enumerate(best, 1)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(kind, n=400):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(n):
        if kind == "clusters":  # bounds leave most cells out here
            v = np.eye(16)[i % 16] * 3 + rng.normal(0, .05, 16)
        elif kind == "ties":
            v = rng.integers(-1, 2, 4) / 2
        else:
            v = rng.normal(0, .2, 9)
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(0, 4))))
    rows += [(n, None, 1), (n + 1, [float("nan")] * 4, 1), (n + 2, [float("inf")], 1), (n + 3, [None, 1.0], 1), (n + 4, [1.0], None), (None, [1.0], 1)]
    rows += [(n + 10, [0.5], 1), (n + 11, [], 2), rows[5], (7, rows[9][1], 3)]
    return rows


@pytest.mark.parametrize("kind", ["clusters", "ties", "noise"])
def test_negatives_equal_brute_force(spark, kind, monkeypatch):
    rows = vectors(kind)
    monkeypatch.setattr(multi_index, "PART", 90)
    df = spark.createDataFrame(rows, VECTORS).withColumn("key", F.lit("clash"))
    for codes, sample, block in ((5, 50, 13), (16, 4096, 2048)):
        got = multi_index.hard_negatives(multi_index.integers(df), F.col("key") % 8 == 0, codes=codes, sample=sample, block=block)
        assert sorted(map(tuple, got.collect())) == brute_negatives(rows, 8)


def test_the_sequence_is_in_order_and_whole():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=7), rng.normal(size=5)
    got = list(multi_index.sequence(a, b))
    assert sorted((i, j) for _, i, j in got) == [(i, j) for i in range(7) for j in range(5)]
    assert [s for s, _, _ in got] == sorted((x + y for x in a for y in b), reverse=True)


def test_certified_searches_leave_cells_out(monkeypatch):
    rng = np.random.default_rng(2)
    x = np.floor(256 * (np.eye(16)[np.arange(640) % 16] * 3 + rng.normal(0, .05, (640, 16))))
    books = multi_index.Codebooks(16, 8, (multi_index.centres_of(x[:, :8], 16), multi_index.centres_of(x[:, 8:], 16)))
    keys, labels = np.arange(640), np.zeros(640, np.int64)
    cells = multi_index.Cells(books, keys, labels, x, *books.codes(x))
    none = np.full((1, 1), multi_index.NONE, np.int64)
    lists = multi_index.Lists(multi_index.Wanted(keys[:1], labels[:1], x[:1], True, 5, none, -none, none))
    seen = []
    add = multi_index.Lists.add
    monkeypatch.setattr(multi_index.Lists, "add", lambda self, who, k, *rest: (seen.append(len(k)), add(self, who, k, *rest))[1])
    monkeypatch.setattr(multi_index, "VISITS", 1)
    multi_index.search(cells, books, lists)
    want = sorted(((int(x[0] @ x[k]), -k) for k in range(1, 640)), reverse=True)[:5]
    assert list(zip(lists.scores[0, 0].tolist(), (-lists.keys[0, 0]).tolist())) == want
    assert sum(seen) < 200


def test_too_long_vectors_fail_and_no_vectors_give_nothing(spark):
    assert multi_index.hard_negatives(multi_index.integers(spark.createDataFrame([], VECTORS)), F.col("key") % 8 == 0).collect() == []
    far = spark.createDataFrame([(0, [1e7, 0.0], 1), (1, [1.0], 2)], VECTORS)
    with pytest.raises(ValueError, match="too long"):
        multi_index.hard_negatives(multi_index.integers(far), F.col("key") % 8 == 0)
