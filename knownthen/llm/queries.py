"""The named queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from knownthen.llm import compact_windows, decontaminate, langid, line_templates, minhash, multi_index, packing, quality_lines, secrets, token_prefix, transducer, url_filter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark, sf_dir):
    return line_templates.cleaned(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scanned(docs, secrets.fit(secrets.sample(docs)))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf")


def op4_token_counts(spark, sf_dir):
    return token_prefix.prefix_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_lines.cleaned(docs).drop("text")


def op6_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"))


def op7_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    known = langid.learned(docs.filter(~langid.held_out(F.col("doc_id"))))
    found = langid.predicted(docs.select("doc_id", "text"), known)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op8_substring_dedup(spark, sf_dir):
    return compact_windows.repeated_passages(table(spark, sf_dir, "documents"))


def op9_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


#: Fixed rules of the query: action, host, start of the path.
URL_RULES = "('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')"


def op10_url_filter(spark, sf_dir):
    rules = spark.sql(f"SELECT * FROM VALUES {URL_RULES} AS r(action, host, path)")
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op11_filter_audit(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"), "text")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = transducer.profiled(docs).join(labels, "doc_id", "left").withColumns(
        {m: F.coalesce(m, F.lit(False)) for m in ("good", "toxic")})
    conditions = [F.col("n_words") < 50, 100 * F.col("n_distinct") < 65 * F.col("n_words"),
                  100 * F.col("n_capitals") > 5 * F.col("n_points"), F.col("n_symbols") > 0]
    cells = transducer.audit_cells(rows, conditions, ["good", "toxic"], key="doc_id", part="part", twin="digest")
    return transducer.interactions(cells, "ABCDE", marks=("good", "toxic")).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
        F.col("lost_good").alias("good_lost"), F.col("lost_toxic").alias("toxic_lost"), "shapley")


def op12_warc(spark, sf_dir):
    return warc.page_records(table(spark, sf_dir, "pages"))


def op13_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = multi_index.integers(table(spark, sf_dir, "embeddings").withColumn("label", label))
    return multi_index.hard_negatives(rows, F.col("key") % 100 == 0)


def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash_dedup, op2_line_dedup, op3_secret_scan, op4_token_counts, op5_quality_rules, op6_packing, op7_language_id, op8_substring_dedup, op9_decontamination, op10_url_filter, op11_filter_audit,
                                   op12_warc, op13_hard_negatives, pipeline)}
