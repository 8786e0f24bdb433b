"""The text rules as functions for SQL.

``register`` gives a session temporary functions of one string each: the native
rules as SQL expressions, which the optimizer inlines, and two table functions that
cut a text into chunks and an HTML page into sections.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from millrace.functions import clean, filters, html, privacy, text_rules
from millrace.functions.chunk import fill_sentences
from millrace.session import share_code

#: Function name to rule; all are columns of one string.
RULES: dict[str, Callable[[Column], Column]] = {
    f.__name__: f
    for f in (
        clean.convert_newlines, clean.single_space, clean.tabs_to_spaces, clean.remove_invisible_chars, clean.simplify_chinese, clean.point_conversion, clean.remove_html_tags,
        clean.remove_abnormal_chars, clean.clean_space, clean.clean_tips, clean.no_html_clean, clean.full_clean, clean.nlp_clean, privacy.replace_ip, privacy.replace_email,
        privacy.replace_customer_number, privacy.replace_phone_number, privacy.replace_qq, privacy.replace_id_card, filters.char_count, filters.few_digits, filters.readable,
        html.text_of, html.title_of, html.lang_of, text_rules.complete_api_url, text_rules.safe_identifier, text_rules.content_type, text_rules.target_type, text_rules.tidy_markdown,
    )
}


def expression(spark: SparkSession, rule: Callable[[Column], Column], argument: str = "x") -> tuple[str, str]:
    """(SQL text, type) of a rule on a column of that name, as the analyzer writes it."""
    with filters.written_out():
        frame = spark.createDataFrame([], f"{argument} string").select(rule(F.col(argument)).alias("y"))
    plan = frame._jdf.queryExecution().analyzed()
    sql = plan.expressions().head().child().sql()
    return sql.replace(f"`{argument}`", argument), frame.schema["y"].dataType.simpleString()


class _Chunks:
    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
        yield from enumerate(fill_sentences(text or "", size, overlap))


class _Sections:
    def eval(self, page: str) -> Iterator[tuple[int, str, str]]:
        for s in html.read_html(page or "")["sections"]:
            yield s["level"], s["header"], s["body"]


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to ``spark``; their names, in order."""
    share_code(spark)
    for name, rule in RULES.items():
        sql, kind = expression(spark, rule)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {kind} RETURN {sql}")
    spark.udtf.register("chunks_of", F.udtf(_Chunks, returnType="chunk_index int, chunk string"))
    spark.udtf.register("sections_of", F.udtf(_Sections, returnType="level int, header string, body string"))
    spark.udf.register("bigram_peak", filters.bigram_peak)
    return [*RULES, "chunks_of", "sections_of", "bigram_peak"]
