"""The registered queries of this subpackage and their check SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from marketpulse.llm import (
    exact_dedup, importance, language, mixing, ngram_join, packing, passages, periodic_runs, quality, sharding, token_files, toxicity,
    url_rules,
)
from marketpulse.llm.common import table
from marketpulse.session import scratch_path

SPACES = r"[\x20\x09-\x0D]"


def tokenizer() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_prefix_shards(spark, sf):
    shards = sharding.assign_shards(table(spark, sf, "documents"), 8, together=True)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op2_compression_toxicity(spark, sf):
    return toxicity.score_documents(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op3_bayes_ngram_join(spark, sf):
    groups = ngram_join.similar_groups(table(spark, sf, "documents"))
    return groups.select("doc_id", "class_id", "text_id", "n_copies", "n_links")


def op4_curriculum_mix(spark, sf):
    passes = mixing.mix(table(spark, sf, "documents"))
    return passes.groupBy("rid", "doc_id", "size", "source_size", "target").agg(
        F.sum("words").alias("taken"), F.min("position").alias("first_position")).drop("rid")


def op5_token_files(spark, sf):
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf, "documents"), path, tokenizer(), 2)
    return token_files.read_tokens(spark, path)


def op6_block_names(spark, sf):
    groups = exact_dedup.exact_groups(table(spark, sf, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = rf"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '{SPACES}+', '', 'g') AS plain
  FROM documents
), g AS (
  SELECT *, count(*) OVER (PARTITION BY plain) AS group_size,
         first_value(doc_id) OVER (PARTITION BY plain ORDER BY chars DESC, doc_id) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(plain) AS text_sha256 FROM g
"""


def op7_likelihood_rules(spark, sf):
    trusted = table(spark, sf, "labels").where("quality = 1")
    judged = quality.judge(table(spark, sf, "documents"), trusted, keep=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "score")


def op8_best_fit_packing(spark, sf):
    return packing.pack_documents(table(spark, sf, "documents"), tokenizer())


def op9_url_rules(spark, sf):
    judged = url_rules.judge_urls(table(spark, sf, "pages"), url_rules.rule_table(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = r"""
WITH p AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^[\s\S]*?://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^[\s\S]*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), r(verdict, host, path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), m AS (
  SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(r.host || r.path) DESC NULLS LAST) AS n
  FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1
"""

def op10_compact_windows(spark, sf):
    return passages.near_passages(table(spark, sf, "documents"))


def op11_kernel_language(spark, sf):
    return language.predict(table(spark, sf, "documents"))


def op12_importance_resampling(spark, sf):
    drawn = importance.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_periodic_runs(spark, sf):
    found = periodic_runs.periodic_runs(planted_periods(table(spark, sf, "documents")))
    # The exact greatest ratio: lengths and periods are multiplied crosswise; earlier runs win ties.
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, r: F.when(r.length * a.period > a.length * r.period, r).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def planted_periods(docs):
    """The documents; where crc32(doc_id) is a multiple of 10, their words from some place on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    parts = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words"))
    n, g = F.size("words").cast("long"), F.expr("h div 10")
    parts = parts.withColumns({"n": n, "g": g}).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    parts = parts.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    moved = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(
        F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return parts.select("doc_id", F.when(F.col("n") > 0, F.array_join(moved, " ")).otherwise(F.col("text")).alias("text"))


QUERIES = {
    "op1_prefix_shards": (op1_prefix_shards, None),
    "op2_compression_toxicity": (op2_compression_toxicity, None),
    "op3_bayes_ngram_join": (op3_bayes_ngram_join, None),
    "op4_curriculum_mix": (op4_curriculum_mix, None),
    "op5_token_files": (op5_token_files, None),
    "op6_block_names": (op6_block_names, OP6_SQL),
    "op7_likelihood_rules": (op7_likelihood_rules, None),
    "op8_best_fit_packing": (op8_best_fit_packing, None),
    "op9_url_rules": (op9_url_rules, OP9_SQL),
    "op10_compact_windows": (op10_compact_windows, None),
    "op11_kernel_language": (op11_kernel_language, None),
    "op12_importance_resampling": (op12_importance_resampling, None),
    "op13_periodic_runs": (op13_periodic_runs, None),
}


def queries() -> dict:
    return {name: query for name, (query, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql is not None}
