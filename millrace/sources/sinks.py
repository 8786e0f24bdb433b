"""Sinks: labelled rows as JSON lines, parsed and cleaned texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save_jsonl(df: DataFrame, path: str, single: bool = False) -> None:
    """Rows as JSON lines with null keys kept; refuses an empty frame."""
    if df.isEmpty():
        raise ValueError("nothing to save")
    (df.coalesce(1) if single else df).write.option("ignoreNullFields", False).json(path)


def label_rows(pairs: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """What is saved of a run: its pairs, and the transcripts of its calls if there are any; columns that one side lacks are null."""
    return pairs if calls is None else pairs.unionByName(calls, allowMissingColumns=True)


def save_evaluation(report: DataFrame, kept: DataFrame, path: str) -> None:
    """The report as one JSON row, the items kept as JSON lines, in folders of their own."""
    report.coalesce(1).write.option("ignoreNullFields", False).json(f"{path}/report")
    kept.write.option("ignoreNullFields", False).json(f"{path}/items")


def save_merged(docs: DataFrame, path: str, by: str = "source", order: str = "doc_id", text: str = "text") -> None:
    """The texts of each group in order, by blank lines, as files below a folder a group. A group of any size is dealt over many tasks by ranges of the order, and no text is gathered."""
    rows = docs.select(F.coalesce(F.col(by).cast("string"), F.lit("null")).alias("__by"), F.col(order).alias("__order"), F.coalesce(F.col(text), F.lit("")).alias("value"))
    rows = rows.repartitionByRange("__by", "__order").sortWithinPartitions("__by", "__order")
    rows.select("__by", "value").write.partitionBy("__by").option("lineSep", "\n\n").text(path)


def save_texts(df: DataFrame, path: str, text: str = "content") -> None:
    if df.isEmpty():
        raise ValueError("nothing to save")
    df.select(F.col(text).alias("value")).write.text(path)


def bucket_stats(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("objects"), (F.coalesce(F.sum("length"), F.lit(0)) / 1048576).alias("total_mb"))
