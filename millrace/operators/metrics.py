"""Run metrics as aggregations; every ratio is 0 where its denominator is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def stage_report(calls: DataFrame, stage: str, seconds: str, tokens: str) -> DataFrame:
    """(stage, requests, seconds, tokens, items_per_second, requests_per_minute, tokens_per_second, tokens_per_request)."""
    took = F.sum(F.greatest(F.coalesce(F.col(seconds), F.lit(0.0)), F.lit(0.0)))
    got = calls.groupBy(F.col(stage).alias("stage")).agg(F.count("*").alias("requests"), took.alias("seconds"), F.sum(F.coalesce(F.col(tokens), F.lit(0))).alias("tokens"))
    return got.select(
        "*",
        ratio(F.col("requests"), F.col("seconds")).alias("items_per_second"),
        ratio(60 * F.col("requests"), F.col("seconds")).alias("requests_per_minute"),
        ratio(F.col("tokens"), F.col("seconds")).alias("tokens_per_second"),
        ratio(F.col("tokens"), F.col("requests")).alias("tokens_per_request"),
    )


def run_report(calls: DataFrame, stage: str = "stage", run: str = "run_id", seconds: str = "seconds", prompt: str = "prompt_tokens", completion: str = "completion_tokens", items: str = "items") -> DataFrame:
    """A row a stage with runs, items, requests, tokens of both kinds, and all ratios.

    A stage lasts from its first call's start to its last call's end, by ``started``
    and ``seconds``; the mean of running calls is the sum of their seconds over that.
    Missing tokens, items and seconds count as 0.
    """
    some = lambda c, zero: F.coalesce(F.col(c), F.lit(zero))
    took = F.greatest(some(seconds, 0.0), F.lit(0.0))
    start = F.unix_micros(F.col("started").cast("timestamp")) / F.lit(1e6)
    got = calls.groupBy(F.col(stage).alias("stage")).agg(
        F.countDistinct(run).alias("runs"), F.sum(some(items, 0)).alias("items"), F.count("*").alias("requests"), F.sum(took).alias("request_seconds"),
        F.greatest(F.coalesce(F.max(start + took) - F.min(start), F.lit(0.0)), F.lit(0.0)).alias("seconds"), F.sum(some(prompt, 0)).alias("prompt_tokens"), F.sum(some(completion, 0)).alias("completion_tokens"),
    )
    got = got.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
    per = lambda a, b, name, times=1: (times * ratio(F.col(a), F.col(b))).alias(name)
    return got.select(
        "*", per("items", "seconds", "items_per_second"), per("items", "seconds", "items_per_minute", 60), per("request_seconds", "requests", "seconds_per_request"),
        per("requests", "seconds", "requests_per_minute", 60), per("request_seconds", "seconds", "concurrency"), per("total_tokens", "seconds", "tokens_per_second"), per("total_tokens", "requests", "tokens_per_request"),
    )


def run_totals(calls: DataFrame, **columns) -> DataFrame:
    """One row for a whole run, with the columns of ``run_report`` but the stage; no calls give no row."""
    return run_report(calls.withColumn("__all", F.lit("all")), stage="__all", **columns).drop("stage")
