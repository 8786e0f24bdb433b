"""Text, metadata, links and sections of HTML: native rules where patterns suffice, a stdlib parser in Arrow batches elsewhere."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SKIPPED = {"script", "style", "nav", "header", "footer"}
HEADERS = {f"h{k}": k for k in range(1, 7)}
#: Fields of a page's metadata (fixed values); keywords are an array, and the canonical address is the page's own where none is named.
FIELDS = ("title", "description", "author", "language", "canonical_url", "og_title", "og_description", "og_image", "twitter_title", "twitter_description")


def text_of(c: Column) -> Column:
    """Pattern rule: script and style go, tags become spaces, white space is squeezed."""
    c = F.regexp_replace(c, "(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    c = F.regexp_replace(c, "<[^>]+>", " ")
    return F.trim(F.regexp_replace(c, "[ \\t\\r\\n]+", " "))


def title_of(c: Column) -> Column:
    return F.trim(F.regexp_extract(c, "(?is)<title[^>]*>(.*?)</title>", 1))


def lang_of(c: Column) -> Column:
    return F.regexp_extract(c, "(?i)<html[^>]* lang=[\"']?([A-Za-z-]+)", 1)


def hrefs_of(c: Column) -> Column:
    """Link targets by pattern, without empty, script, mail and phone links."""
    found = F.regexp_extract_all(c, F.lit("(?i)<a [^>]*href=[\"']([^\"']*)[\"']"), 1)
    return F.filter(found, lambda x: (x != "") & ~F.lower(x).rlike("^(javascript:|mailto:|tel:)"))


class _Reader(HTMLParser):
    def __init__(self, base: str) -> None:
        super().__init__()
        self.base, self.skip, self.text, self.links, self.meta = base, 0, [], [], {}
        self.sections: list[list] = [[0, "", []]]
        self.link: list | None = None
        self.in_title = self.in_header = False

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        self.skip += tag in SKIPPED
        if tag == "html" and a.get("lang"):
            self.meta["language"] = a["lang"]
        elif tag == "title":
            self.in_title = True
        elif tag == "meta" and (name := (a.get("name") or a.get("property") or "").lower()):
            self.meta.setdefault(name.replace("og:", "og_").replace("twitter:", "twitter_"), a.get("content") or "")
        elif tag == "link" and (a.get("rel") or "").lower() == "canonical":
            self.meta["canonical_url"] = urljoin(self.base, a.get("href") or "")
        elif tag == "a":
            self.link = [a.get("href") or "", "", a.get("title") or ""]
        elif tag in HEADERS:
            self.in_header = True
            self.sections.append([HEADERS[tag], "", []])

    def handle_endtag(self, tag):
        self.skip = max(0, self.skip - (tag in SKIPPED))
        if tag == "title":
            self.in_title = False
        elif tag == "a" and self.link is not None:
            href, text, title = self.link
            url = urljoin(self.base, href)
            if href and not href.lower().startswith(("javascript:", "mailto:", "tel:")) and url.startswith(("http://", "https://")):
                self.links.append({"url": url, "text": text.strip(), "title": title})
            self.link = None
        elif tag in HEADERS:
            self.in_header = False

    def handle_data(self, data):
        if self.in_title:
            self.meta["title"] = self.meta.get("title", "") + data
            return
        if self.link is not None:
            self.link[1] += data
        if self.skip:
            return
        self.text.append(data)
        if self.in_header:
            self.sections[-1][1] += data
        elif data.strip():
            self.sections[-1][2].append(data.strip())


def read_html(html: str, base: str = "") -> dict:
    reader = _Reader(base)
    reader.feed(html)
    reader.close()
    lines = (" ".join(p.strip() for p in line.split("  ") if p.strip()) for line in "".join(reader.text).splitlines())
    sections = [{"level": level, "header": header.strip(), "body": "\n".join(body)} for level, header, body in reader.sections if header.strip() or body]
    words = [x.strip() for x in reader.meta.get("keywords", "").split(",") if x.strip()]
    metadata = {k: reader.meta.get(k, "").strip() for k in FIELDS} | {"keywords": words}
    metadata["canonical_url"] = metadata["canonical_url"] or base
    return {"text": " ".join(x for x in lines if x), "metadata": metadata, "links": reader.links, "sections": sections}


_TEXT = T.StringType()
_LINK = T.StructType([T.StructField(x, _TEXT) for x in ("url", "text", "title")])
_SECTION = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("header", _TEXT), T.StructField("body", _TEXT)])
SCHEMA = T.StructType(
    [T.StructField("text", _TEXT), T.StructField("metadata", T.StructType([*[T.StructField(x, _TEXT) for x in FIELDS], T.StructField("keywords", T.ArrayType(_TEXT))])), T.StructField("links", T.ArrayType(_LINK)), T.StructField("sections", T.ArrayType(_SECTION))]
)


@F.pandas_udf(SCHEMA)
def parse_page(html: pd.Series, url: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_html(h or "", u or "") for h, u in zip(html, url)], columns=["text", "metadata", "links", "sections"])


def sections_markdown(sections: Column) -> Column:
    """Sections as markdown: the header at its level, the body, a blank line."""
    head = lambda s: F.when(s["header"] != "", F.concat(F.repeat(F.lit("#"), F.greatest(s["level"], F.lit(1))), F.lit(" "), s["header"], F.lit("\n"))).otherwise("")
    return F.trim(F.array_join(F.transform(sections, lambda s: F.concat(head(s), s["body"], F.lit("\n"))), "\n"))
