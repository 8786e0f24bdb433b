"""Counts and listings about runs: crawls, reviews, batches, tags, results and errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.metrics import ratio
from millrace.session import settle


def crawl_metrics(crawls: DataFrame, kind: str = "kind", target: str = "target", ok: str = "ok", seconds: str = "seconds") -> DataFrame:
    """One row: crawls, successes, failures, the mean duration over all crawls, different targets, the share of successes, and crawls by kind."""
    done = F.coalesce(F.col(ok), F.lit(False))
    by = crawls.groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("crawlers_used"))
    total = crawls.agg(
        F.count("*").alias("total_crawls"), F.count_if(done).alias("successful_crawls"), F.count_if(~done).alias("failed_crawls"),
        F.coalesce(F.sum(seconds), F.lit(0.0)).alias("total_duration"), F.countDistinct(target).alias("unique_targets"),
    )
    total = total.withColumn("avg_duration", ratio(F.col("total_duration"), F.col("total_crawls"))).withColumn("success_rate", ratio(F.col("successful_crawls"), F.col("total_crawls")))
    return total.join(by, F.lit(True), "left")  # one row each


def review_counts(reviews: DataFrame, score: str = "score", least: float = 4) -> DataFrame:
    """One row: accepted and rejected; what has no score is rejected."""
    accepted = F.coalesce(F.col(score) >= least, F.lit(False))
    return reviews.agg(F.count_if(accepted).alias("accepted"), F.count_if(~accepted).alias("rejected"))


def run_counts(pairs: DataFrame, question: str = "question", answer: str = "answer", label: str = "label") -> DataFrame:
    """One row: questions, answered ones, labelled ones, and different labels."""
    named = F.coalesce(F.col(label), F.lit("")) != ""
    return pairs.agg(F.count(question).alias("questions"), F.count(answer).alias("answered"), F.count_if(named).alias("labelled"), F.countDistinct(F.when(named, F.col(label))).alias("labels"))


def batch_summary(results: DataFrame, seconds: float, ok: str = "ok") -> DataFrame:
    """One row: files, successes (no mark counts as one), failures, files a second."""
    good = F.coalesce(F.col(ok), F.lit(True))
    got = results.agg(F.count("*").alias("files"), F.count_if(good).alias("successful"), F.count_if(~good).alias("failed"))
    return got.withColumn("files_per_second", ratio(F.col("files"), F.lit(float(seconds))))


def combined(results: DataFrame, key: str, engine: str = "engine", ok: str = "ok") -> DataFrame:
    """One row a key: how many engines were used, succeeded and failed, and the names of those that did."""
    good = F.coalesce(F.col(ok), F.lit(False))
    got = results.groupBy(key).agg(
        F.count("*").alias("total_engines"), F.count_if(good).alias("successful_engines"), F.count_if(~good).alias("failed_engines"),
        F.array_sort(F.collect_list(F.when(good, F.col(engine)))).alias("results"), F.array_sort(F.collect_list(F.when(~good, F.col(engine)))).alias("errors"),
    )
    return got


def split_results(results: DataFrame, ok: str = "ok") -> tuple[DataFrame, DataFrame]:
    """Successes, and everything else; no mark is a failure here."""
    good = F.coalesce(F.col(ok), F.lit(False))
    return results.where(good), results.where(~good)


def merged_tags(old: Column, new: Column) -> Column:
    """One map of tags; the later value of a tag stands."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)


def top_by(df: DataFrame, by: str, score: str, tie: str, k: int) -> DataFrame:
    """The ``k`` rows of highest score in each group, with their rank from 1; ties by ``tie``. The limit is the feature."""
    w = Window.partitionBy(by).orderBy(F.col(score).desc_nulls_last(), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def capped(df: DataFrame, by: str, order: list[str], per_group: int, overall: int) -> DataFrame:
    """At most ``per_group`` rows of a group, and ``overall`` of those, in the order of ``order``. The limits are the feature."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= per_group).drop("__n").orderBy(*order).limit(overall)


def turn_ends(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, question, answer): the first user turn that has a text, and the last such assistant turn."""
    there = F.col(text).isNotNull()
    first = F.min_by(text, F.when(there & (F.col(role) == "user"), F.col(order)))
    last = F.max_by(text, F.when(there & (F.col(role) == "assistant"), F.col(order)))
    return turns.groupBy(key).agg(first.alias("question"), last.alias("answer"))


def evaluation(items: DataFrame, least: float = 0.6, score: str = "score") -> tuple[DataFrame, DataFrame]:
    """(report of one row, items kept): how many items there are, how many pass, their share and mean score."""
    passed = F.coalesce(F.col(score) >= least, F.lit(False))
    report = items.agg(F.count("*").alias("items"), F.count_if(passed).alias("passed"), F.avg(score).alias("mean_score"))
    return report.withColumn("pass_rate", ratio(F.col("passed"), F.col("items"))), items.where(passed)


def places(df: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """``df`` with the place of each row from 1: rows are dealt by ranges of the order, numbered within, and moved on by the sizes of the ranges before."""
    ranged = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    ranged = settle(ranged, "places")
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))  # a row a partition
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.withColumn("__own", own).join(before, "__part").withColumn(name, (F.col("__own") + F.col("__before")).cast("int")).select(*df.columns, name)


def previous(df: DataFrame, by: str, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with ``value`` of the row before in the same group, null for the first.

    Rows are dealt by ranges of group and order, so a group of any size is spread over
    many tasks; where it goes on in the next range, that range's first row takes the
    last row of the range before, one row a range.
    """
    ranged = settle(df.repartitionByRange(by, *order).withColumn("__part", F.spark_partition_id()), "previous")
    lasts = ranged.groupBy("__part").agg(F.max(F.struct(by, *order, F.col(value).alias("__value"))).alias("__last"))
    before = lasts.select("__part", F.lag("__last").over(Window.orderBy("__part")).alias("__before"))  # a row a range
    own = Window.partitionBy("__part", by).orderBy(*order)
    rows = ranged.withColumn("__own", F.lag(F.struct(F.col(value).alias("v"))).over(own)).join(before, "__part")
    carried = F.when(F.col("__before")[by].eqNullSafe(F.col(by)), F.col("__before.__value"))
    return rows.withColumn(name, F.when(F.col("__own").isNotNull(), F.col("__own.v")).otherwise(carried)).select(*df.columns, name)
