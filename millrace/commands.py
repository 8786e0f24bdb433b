"""The commands a user starts: ``python -m millrace.commands clean|parse|chunk|list-formats|status ...``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import millrace
from millrace.functions import chunk, clean, filters, privacy
from millrace.functions.tables import CODE_LANGUAGES, DOCUMENTS, IMAGES
from millrace.session import share_code
from millrace.sources import files, sinks

MODES = ("full", "abnormal", "filter", "privacy", "no_html")


def cleaned(df: DataFrame, mode: str, text: str = "text") -> DataFrame:
    """``df`` with its text cleaned in one of MODES; ``filter`` and ``full`` keep only rows that pass the quality rules."""
    if mode not in MODES:
        raise ValueError(f"no mode {mode}; there are {', '.join(MODES)}")
    share_code(df.sparkSession)
    rule: dict[str, Column] = {"full": clean.full_clean(F.col(text)), "abnormal": clean.full_clean(F.col(text)), "filter": clean.no_html_clean(F.col(text)), "privacy": privacy.mask_private(F.col(text)), "no_html": clean.no_html_clean(F.col(text))}
    out = filters.computed(df, text, rule[mode])
    if mode in ("full", "filter"):
        out = out.where(filters.keep(F.col(text)))
    return out.withColumn(text, privacy.mask_private(F.col(text))) if mode == "full" else out


def formats() -> list[tuple[str, str]]:
    """(extension, kind) of all files that have a route."""
    return [*((x, "image") for x in IMAGES), *((x[1:], f"code: {lang}") for x, lang in CODE_LANGUAGES.items()), *((x, "document") for x in DOCUMENTS)]


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="millrace", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, what in (("clean", "clean texts of a Parquet table"), ("parse", "texts of the files below a folder, as JSON lines"), ("chunk", "cut texts of a Parquet table")):
        c = sub.add_parser(name, help=what)
        c.add_argument("source")
        c.add_argument("target")
        if name != "parse":
            c.add_argument("--text", default="text")
        if name == "clean":
            c.add_argument("--mode", choices=MODES, default="full")
        if name == "parse":
            c.add_argument("--domain", default="Technology")
        if name == "chunk":
            c.add_argument("--size", type=int, default=500)
            c.add_argument("--overlap", type=int, default=100)
    sub.add_parser("list-formats", help="extensions that have a route")
    sub.add_parser("status", help="what runs here")
    a = p.parse_args(arguments)
    if a.command == "list-formats":
        print("\n".join(f"{x}\t{kind}" for x, kind in formats()))
        return 0
    spark = spark or SparkSession.builder.appName("millrace").getOrCreate()
    if a.command == "status":
        print(f"{millrace.__name__} on Spark {spark.version}, {spark.sparkContext.master}, {spark.sparkContext.defaultParallelism} tasks at once")
    elif a.command == "clean":
        cleaned(spark.read.parquet(a.source), a.mode, a.text).write.parquet(a.target)
    elif a.command == "chunk":
        share_code(spark)
        chunk.chunk_rows(spark.read.parquet(a.source), a.text, a.size, a.overlap).write.parquet(a.target)
    else:
        now = spark.sql("select date_format(current_timestamp(), 'yyyy-MM-dd HH:mm:ss')").first()[0]
        sinks.save_jsonl(files.parse(files.scan(spark, a.source), now, a.domain), a.target)
    return 0


if __name__ == "__main__":
    sys.exit(main())
