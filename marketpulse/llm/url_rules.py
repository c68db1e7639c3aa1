"""URL rules by host-suffix and path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Verdict, host and path of each rule.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    rows = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS rules(verdict, host, path)")


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z lower-cased; empty if NULL or without ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the end of the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", prefix_hex: int = 8) -> DataFrame:
    """The verdict of the longest rule that fits each url, else ``default``.

    Returns ``page_id``, ``url``, ``host``, ``path``, ``rule`` (host + path, NULL if none fits) and ``verdict``.
    A rule fits its host and all subdomains if the path starts with its path. Among rules of equal
    length the one with the longer host wins, then block.

    Each url becomes its host suffixes times the prefixes of its path that have the length of some
    rule's path (one row of distinct lengths, at most the longest url). An expression meets the rules
    by the first ``prefix_hex`` digits of its SHA-256; the full digest confirms. All expressions of a
    url lie in one task, so the best rule is found before the only shuffle.

    NULL urls and urls without :// have an empty host and path and fit no rule. Repeated rows and
    NULL ids are judged row by row; equal rules count once. Empty tables give empty results, or the
    default for every page if there are no rules. Other columns are ignored.
    """
    known = rules.select(
        "verdict", F.concat("host", "path").alias("rule"), F.length("host").alias("host_length"),
        F.sha2(F.concat_ws("\n", "host", "path"), 256).alias("digest")).distinct()
    known = known.withColumn("short", F.substring("digest", 1, prefix_hex))
    lengths = rules.select(F.length("path").alias("n")).agg(F.sort_array(F.collect_set("n")).alias("lengths"))
    urls = pages.select(F.monotonically_increasing_id().alias("rid"), "page_id", "url",
                        host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.lit(0).alias("one"))
    urls = urls.join(F.broadcast(lengths.withColumn("one", F.lit(0))), "one")
    labels = F.split("host", r"\.", -1)
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    suffixes = F.when(F.col("host") != "", tails).otherwise(F.array().cast("array<string>"))
    prefixes = F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    every = (
        urls.withColumn("suffix", F.explode_outer(suffixes)).withColumn("start", F.explode_outer(prefixes))
        .withColumn("full", F.sha2(F.concat(F.col("suffix"), F.lit("\n"), F.col("start")), 256))
        .withColumn("head", F.substring("full", 1, prefix_hex))
    )
    met = every.join(known, F.col("head") == F.col("short"), "left")
    fits = F.col("full") == F.col("digest")
    best = F.max(F.when(fits, F.struct(F.length("rule").alias("n"), "host_length", (F.col("verdict") == "block").alias("blocks"), "rule", "verdict")))
    return met.groupBy("rid", "page_id", "url", "host", "path").agg(best.alias("best")).select(
        "page_id", "url", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
