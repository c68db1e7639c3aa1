"""Alternative data: JSON metric series, commit counts, repository facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketpulse.operators.joins import exchange_flow
from marketpulse.operators.series import last_rows


def parse_metric_json(df: DataFrame, metric: str, payload: str = "payload", key: str = "symbol") -> DataFrame:
    """JSON arrays of {t: epoch s, v: number} as (key, metric, ts, value)."""
    points = F.from_json(payload, "array<struct<t:bigint,v:double>>")
    return df.select(key, F.inline(points)).select(
        key, F.lit(metric).alias("metric"), F.timestamp_seconds("t").alias("ts"), F.col("v").alias("value"))


def parse_weekly_activity(df: DataFrame, weeks: int = 52, payload: str = "payload", key: str = "symbol") -> DataFrame:
    """JSON arrays of {week: epoch s, total: n} as (key, ts, commits), the last ``weeks`` of each key."""
    points = F.from_json(payload, "array<struct<week:bigint,total:bigint>>")
    rows = df.select(key, F.inline(points)).select(
        key, F.timestamp_seconds("week").alias("ts"), F.col("total").alias("commits"))
    return last_rows(rows, weeks, by=(key,))


def parse_repo_stats(df: DataFrame, payload: str = "payload", key: str = "symbol") -> DataFrame:
    """Counts (0 when missing) and dates of a repository."""
    def count(name):
        return F.coalesce(F.get_json_object(payload, f"$.{name}").try_cast("bigint"), F.lit(0).cast("bigint"))
    names = {"stars": "stargazers_count", "forks": "forks_count", "watchers": "watchers_count",
             "open_issues": "open_issues_count"}
    dates = ("created_at", "updated_at", "pushed_at")
    return df.select(
        key, *[count(field).alias(out) for out, field in names.items()],
        *[F.try_to_timestamp(F.get_json_object(payload, f"$.{d}")).alias(d) for d in dates])


def flow_metric(inflow: DataFrame, outflow: DataFrame, key: str = "symbol") -> DataFrame:
    """Net exchange flow as a metric series."""
    both = exchange_flow(inflow.drop("metric"), outflow.drop("metric"), by=(key,))
    return both.select(key, F.lit("exchange_flow").alias("metric"), "ts", F.col("net_flow").alias("value"))


def collect_metrics(*series: DataFrame) -> DataFrame:
    """All metric series as one long table."""
    return reduce(DataFrame.unionByName, series)
