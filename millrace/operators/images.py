"""Images of markdown texts and the chunks that show them; question rows with image tokens."""

from __future__ import annotations

import posixpath

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.chunk import split_recursive, splitter
from millrace.functions.filters import bound
from millrace.session import share_code

#: An image in markdown, and what stands for it while the text is split (fixed values).
IMAGE, MARK = r"!\[[^\]]*\]\(([^)]+)\)", r"\|\|image_placeholder_(\d+)\|\|"


def images_of(c: Column) -> Column:
    """The targets of a markdown text's images, in order."""
    return F.regexp_extract_all(c, F.lit(IMAGE), 1)


def with_marks(c: Column) -> Column:
    """The text with numbered marks for its images, from 0."""

    def put(parts: Column) -> Column:
        marked = F.transform(parts, lambda x, k: F.when(k == 0, x).otherwise(F.concat(F.lit("||image_placeholder_"), (k - 1).cast("string"), F.lit("||"), x)))
        return F.array_join(marked, "")

    return bound(F.split(c, IMAGE, -1), put)


def marked_places(c: Column) -> Column:
    """The different numbers of the marks in a chunk, ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(MARK), 1), lambda x: x.cast("int"))))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _resolved(paths: pd.Series, file: pd.Series) -> pd.Series:
    """Paths below the folder above the file's own."""
    return pd.Series([[posixpath.normpath(posixpath.join(posixpath.dirname(posixpath.dirname(f or "")), p)) for p in ps] if ps is not None else None for ps, f in zip(paths, file)], dtype=object)


def image_chunks(texts: DataFrame, path: str = "path", text: str = "text", size: int = 2000, overlap: int = 300) -> DataFrame:
    """(path, chunk_index, text, images): the chunks that show images, without the marks; texts without images give none."""
    share_code(texts.sparkSession)
    cut = splitter(split_recursive, size=size, overlap=overlap)
    rows = texts.where(F.col(text).rlike(IMAGE)).select(path, images_of(F.col(text)).alias("all"), cut(with_marks(F.col(text))).alias("chunks"))
    rows = rows.select(path, "all", F.posexplode("chunks").alias("chunk_index", "chunk")).withColumn("places", marked_places(F.col("chunk"))).where(F.size("places") > 0)
    shown = F.transform("places", lambda k: F.element_at("all", k + 1))
    return rows.select(path, "chunk_index", F.trim(F.regexp_replace("chunk", MARK, "")).alias("text"), _resolved(shown, F.col(path)).alias("images"))


def valid_messages(messages: Column, images: Column) -> Column:
    """Whether there are two turns or more, a user and an assistant among them, and an image path for each image token."""
    role = lambda name: F.exists(messages, lambda m: m["role"] == name)
    tokens = F.aggregate(messages, F.lit(0), lambda n, m: n + F.regexp_count(F.coalesce(m["content"], F.lit("")), F.lit("<image>")))
    named = F.forall(images, lambda x: x.isNotNull() & (x != ""))
    return F.coalesce((F.size(messages) >= 2) & role("user") & role("assistant") & named & (tokens == F.size(images)), F.lit(False))


def generate_image_pairs(chunks: DataFrame, client, text: str = "text", images: str = "images", per_chunk: int = 5, **options) -> DataFrame:
    """(messages, images): questions on chunks that show images, and answers to them."""
    from millrace.operators import qa

    asked = qa.complete(chunks.withColumn("__p", qa.image_prompt(F.col(text), F.col(images), per_chunk)), "__p", client, "__r", **options)
    rows = asked.select(text, images, F.explode(F.slice(F.from_json(qa.json_of(F.col("__r")), "array<string>"), 1, per_chunk)).alias("question")).where("question is not null")
    rows = qa.complete(rows.withColumn("__p", qa.answer_prompt(F.col("question"), F.col(text))), "__p", client, "answer", **options).where("answer is not null")
    return rows.select(image_messages(F.col("question"), F.col("answer"), F.col(images)).alias("messages"), F.col(images).alias("images"))


def image_messages(question: Column, answer: Column, images: Column) -> Column:
    """A user and an assistant message; the user's begins with one token an image."""
    lead = F.repeat(F.lit("<image>"), F.size(images))
    said = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(said("user", F.concat(lead, question)), said("assistant", answer))
