"""Small scalar rules of names, addresses, targets and texts as Column functions; null in, null out unless said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of byte sizes, each 1024 of the one before (fixed values).
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")
#: A JSON object with up to two objects inside one another, as a pattern (fixed value).
OBJECT = r"\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}"
#: Words that mark text taken from a paged file (fixed values).
PAGED = ("pdf", "page", "document")


def complete_api_url(c: Column, suffix: str = "/chat/completions") -> Column:
    """The address without closing slashes, with the suffix once."""
    base = F.regexp_replace(c, "/+$", "")
    return F.when(base.endswith(suffix), base).otherwise(F.concat(base, F.lit(suffix)))


def safe_identifier(c: Column, most: int = 50) -> Column:
    """Letters, digits, hyphen, underscore and full stop, the first ``most`` of them."""
    return F.substring(F.regexp_replace(c, r"[^\p{L}\p{N}_.-]", ""), 1, most)


def content_type(c: Column) -> Column:
    """Markdown, PDF converted content or Text, by the first mark that is there."""
    marked = F.trim(c).startswith("#") | c.contains("**") | c.contains("```")
    paged = F.lower(c).rlike("|".join(PAGED))
    return F.when(marked, "Markdown").when(paged, "PDF converted content").when(c.isNotNull(), "Text")


def target_type(c: Column) -> Column:
    """What a crawl target is: arxiv_url, web_url, arxiv_id or search_query."""
    url = c.rlike("^https?://")
    number = F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit("v"), F.lit(""))
    return F.when(url & c.contains("arxiv.org"), "arxiv_url").when(url, "web_url").when(number.rlike("^[0-9]+$"), "arxiv_id").when(c.isNotNull(), "search_query")


def valid_target(c: Column, kind: Column) -> Column:
    """A web target has to be an address with a host; a paper target is anything that is no address, or one of the archive."""
    url = F.coalesce(c.rlike("^https?://[^/?#\\s]+"), F.lit(False))
    return F.when(kind == "web", url).otherwise(F.coalesce((F.trim(c) != "") & (~url | c.contains("arxiv.org")), F.lit(False)))


def byte_size(c: Column) -> Column:
    """A number of bytes in the largest unit below 1024, with two decimals."""
    out = F.lit(None).cast("string")
    for k, unit in reversed(list(enumerate(SIZE_UNITS))):
        fits = c < F.lit(float(1024 ** (k + 1)))
        out = F.when(fits, F.format_string(f"%.2f{unit}", F.round(c / F.lit(float(1024**k)), 2))).otherwise(out)
    return out


def truncate(c: Column, most: int, strip: bool = True, mark: str = "...") -> Column:
    """The first ``most`` characters and a mark, where there are more; ``strip`` takes spaces off before the mark."""
    head = F.substring(c, 1, most)
    return F.when(F.length(c) > most, F.concat(F.rtrim(head) if strip else head, F.lit(mark))).otherwise(c)


def tidy_markdown(c: Column) -> Column:
    """Rules of tables become one form, three line feeds or more become two, and the ends are trimmed."""
    c = F.regexp_replace(c, r"\|(\s*-+\s*)\|", "|:---:|")
    return F.regexp_replace(F.regexp_replace(c, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def json_objects(c: Column) -> Column:
    """The objects in a text that are valid JSON, in order."""
    return F.filter(F.regexp_extract_all(c, F.lit(OBJECT), 0), lambda x: F.try_parse_json(x).isNotNull())


def first_of(*columns: Column) -> Column:
    """The first value that is neither null nor empty: results of different engines name the same thing differently."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def without_nulls(c: Column) -> Column:
    """A map without its null values."""
    return F.map_filter(c, lambda _, v: v.isNotNull())


def preview(c: Column, most: int, more: str = "... and {} more") -> Column:
    """The first ``most`` of an array of strings, and one that says how many are left out."""
    before, after = more.split("{}")
    rest = F.concat(F.lit(before), (F.size(c) - most).cast("string"), F.lit(after))
    return F.when(F.size(c) > most, F.concat(F.slice(c, 1, most), F.array(rest))).otherwise(c)
