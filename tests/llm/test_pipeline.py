"""The stages of the pipeline, each on its predecessor's output."""

import corpus_pipeline
from knownthen.llm import langid, line_templates, minhash
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.dtypes, {}
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.written(stage(spark, docs, SF), name)
        seen[name] = (docs, after)
        if name != "packing":
            assert after.dtypes == columns
            assert after.join(docs, "doc_id", "left_anti").count() == 0
        docs = after
    before, after = seen["language_id"]
    known = langid.learned(before.filter(~langid.held_out(F.col("doc_id"))))
    assert after.count() == langid.predicted(before, known).filter("not rejected").count() > 0.9 * before.count()
    before, after = seen["near_dedup"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in minhash.near_duplicates(before).filter("kept").collect()}
    assert minhash.near_duplicates(after).filter("not kept").count() == 0
    before, after = seen["decontamination"]
    assert 0 < before.count() - after.count() < 0.1 * before.count()
    before, after = seen["packing"]
    assert after.select("doc_id").distinct().count() == before.count()


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_jobs_of_line_dedup_do_not_grow_with_the_templates_of_a_leaf(spark, documents, monkeypatch):
    lines = [" ".join(["one", "two", "three", *(chr(97 + t) + p for p in "defghij")]) for t in range(25)]
    docs = documents([f"Text {'abcd'[i] * 5} has this of its own.\n" + "\n".join(lines) for i in range(4)])
    tables, written = [], line_templates.written
    monkeypatch.setattr(line_templates, "written", lambda df, name: tables.append(name) or written(df, name))
    rows = corpus_pipeline.line_dedup(spark, docs, SF).orderBy("doc_id").collect()
    assert rows[0].text.count("\n") == 25 and not any("one two" in r.text for r in rows[1:]) and len(rows) == 4
    assert len(tables) < 20
