"""Crawled records: markdown of pages, papers and search results, feed entries, and a store of records."""

from __future__ import annotations

from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text_rules import first_of, preview, safe_identifier
from millrace.session import share_code

LINKS = 20
#: Name spaces of feeds of papers (fixed values).
ATOM, PAPERS = "{http://www.w3.org/2005/Atom}", "{http://arxiv.org/schemas/atom}"


def _line(label: str, value: Column) -> Column:
    """A bold label and its value, and a blank line; null where the value is null or empty."""
    return F.concat(F.lit(f"**{label}:** "), F.nullif(value, F.lit("")), F.lit("\n"))


def _linked(label: str, url: Column) -> Column:
    return _line(label, F.concat(F.lit("["), F.nullif(url, F.lit("")), F.lit("]("), url, F.lit(")")))


def _list(label: str, values: Column) -> Column:
    return _line(label, F.array_join(values, ", "))


def paper_markdown(title: Column, paper_id: Column, authors: Column, categories: Column, published: Column, updated: Column, doi: Column, pdf: Column, summary: Column, crawled: Column) -> Column:
    """A paper's record; what is missing leaves no line, and an update on the day of publication none either."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("# "), F.coalesce(title, F.lit("Unknown Title")), F.lit("\n")),
        _line("ArXiv ID", paper_id), _list("Authors", authors), _list("Categories", categories), _line("Published", published),
        _line("Updated", F.when(~updated.eqNullSafe(published), updated)), _line("DOI", doi), _linked("PDF", pdf),
        F.concat(F.lit("## Abstract\n\n"), F.nullif(summary, F.lit("")), F.lit("\n")), F.concat(F.lit("\n*Crawled at: "), F.nullif(crawled, F.lit("")), F.lit("*\n")),
    )


def page_markdown(title: Column, url: Column, description: Column, language: Column, text: Column, links: Column, crawled: Column) -> Column:
    """A page's record; ``links`` is an array of (url, text), of which the first ``LINKS`` are shown."""
    shown = F.transform(F.filter(links, lambda x: x["url"] != ""), lambda x: F.concat(F.lit("- ["), F.coalesce(F.nullif(F.trim(x["text"]), F.lit("")), F.lit("Link")), F.lit("]("), x["url"], F.lit(")")))
    listed = F.array_join(preview(shown, LINKS, "\n*... and {} more links*"), "\n")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("# "), F.coalesce(F.nullif(title, F.lit("")), F.lit("Web Page")), F.lit("\n")), _linked("URL", url), _line("Description", description), _line("Language", language),
        F.concat(F.lit("## Content\n\n"), F.nullif(text, F.lit("")), F.lit("\n")), F.when(F.size(shown) > 0, F.concat(F.lit("## Links\n\n"), listed, F.lit("\n"))),
        F.concat(F.lit("*Crawled at: "), F.nullif(crawled, F.lit("")), F.lit("*\n")),
    )


def record_kind(kind: Column, source: Column, paper_id: Column) -> Column:
    """Which of the forms a crawled record has: arxiv, web, search or generic, tried in this order."""
    return F.when(paper_id.isNotNull() | F.coalesce(source == "arxiv", F.lit(False)) | F.coalesce(kind == "single_paper", F.lit(False)), "arxiv").when((kind == "web_page") | (source == "web"), "web").when(
        kind == "search_results", "search"
    ).otherwise("generic")


def search_results(rows: DataFrame) -> DataFrame:
    """Results of any engine under one set of names; columns that an engine lacks count as null."""
    there = lambda *names: [F.col(n).cast("string") for n in names if n in rows.columns] or [F.lit(None).cast("string")]
    pick = lambda *names: F.coalesce(first_of(*there(*names)), F.lit(""))
    return rows.select(
        pick("url").alias("url"), pick("title", "name").alias("title"), pick("description", "snippet").alias("description"), pick("summary").alias("summary"),
        pick("siteName").alias("site_name"), pick("datePublished", "dateLastCrawled").alias("date_published"), pick("displayUrl", "url").alias("display_url"),
    )


def read_entry(xml: str) -> dict:
    """The first entry of an Atom feed of papers; nothing where there is none or the text is no XML."""
    try:
        entry = ElementTree.fromstring(xml).find(f"{ATOM}entry")
    except ElementTree.ParseError:
        entry = None
    if entry is None:
        return {}
    text = lambda at, name: ((x := at.find(name)) is not None and x.text or "").strip() or None
    return {
        "paper_id": (text(entry, f"{ATOM}id") or "").rpartition("/abs/")[2] or None,
        "title": text(entry, f"{ATOM}title") or "Unknown Title",
        "authors": [n for a in entry.findall(f"{ATOM}author") if (n := text(a, f"{ATOM}name"))],
        "summary": text(entry, f"{ATOM}summary") or "",
        "categories": [c.get("term") for c in entry.findall(f"{ATOM}category") if c.get("term")],
        "published_date": text(entry, f"{ATOM}published"),
        "updated_date": text(entry, f"{ATOM}updated"),
        "pdf_url": next((x.get("href") for x in entry.findall(f"{ATOM}link") if x.get("type") == "application/pdf"), None),
        "doi": text(entry, f"{PAPERS}doi"),
    }


_ENTRY = T.StructType([T.StructField(n, T.ArrayType(T.StringType()) if n in ("authors", "categories") else T.StringType()) for n in ("paper_id", "title", "authors", "summary", "categories", "published_date", "updated_date", "pdf_url", "doi")])


@F.pandas_udf(_ENTRY)
def feed_entry(xml: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([dict.fromkeys(_ENTRY.names) | read_entry(x or "") for x in xml], columns=_ENTRY.names, dtype=object)


# --- a store of records ---


def save_records(records: DataFrame, path: str, name: str, saved_at: str) -> None:
    """Rows as JSON lines in one partition of their kind, with the name they are kept under and when; the partition is written anew."""
    share_code(records.sparkSession)
    kept = records.withColumn("identifier", safe_identifier(F.col(name).cast("string"))).withColumn("saved_at", F.lit(saved_at))
    kept.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The records of a store in the order of their names."""
    return spark.read.json(path).orderBy("identifier")
