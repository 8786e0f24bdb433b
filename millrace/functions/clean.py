"""Cleaning rules as Column -> Column functions; Catalyst folds a chain of them into one projection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.filters import gated
from millrace.functions.han import SIMPLIFIED, TRADITIONAL

#: A watermark sentence that crawled pages carry; deleted where it stands (fixed value, a parameter).
WATERMARK = "This page was saved for offline reading."


def convert_newlines(c: Column) -> Column:
    """Carriage returns go; runs of line feeds become one."""
    return F.regexp_replace(F.replace(c, F.lit("\r"), F.lit("")), "\n+", "\n")


def single_space(c: Column) -> Column:
    return F.regexp_replace(c, " {2,}", " ")


def tabs_to_spaces(c: Column) -> Column:
    return F.replace(c, F.lit("\t"), F.lit("    "))


def remove_invisible_chars(c: Column) -> Column:
    """Control characters and the no-break space go; line feeds stay."""
    return F.regexp_replace(c, "[\\x00-\\x09\\x0B-\\x1F\\x7F-\\xA0]", "")


def simplify_chinese(c: Column) -> Column:
    """Traditional to simplified characters, one to one; words are not looked at."""
    return gated(c, lambda t: t.rlike(r"[\x{3400}-\x{9FFF}]"), lambda t: F.translate(t, TRADITIONAL, SIMPLIFIED))


def point_conversion(c: Column) -> Column:
    """A bullet at the start of a line becomes a hyphen; not at the very start of the text."""
    return F.replace(c, F.lit("\n• "), F.lit("\n- "))


def remove_html_tags(c: Column) -> Column:
    """Script and style elements go with their content, then every tag."""

    def rules(t: Column) -> Column:
        t = F.regexp_replace(t, "(?is)<script[^>]*>.*?</script>", "")
        t = F.regexp_replace(t, "(?is)<style[^>]*>.*?</style>", "")
        return F.regexp_replace(t, "<[^>]+>", "")

    return gated(c, lambda t: t.contains("<"), rules)


def remove_abnormal_chars(c: Column) -> Column:
    """Private-use characters, replacement characters, zero-width marks and box drawing go."""
    return F.regexp_replace(c, "[\\x{E000}-\\x{F8FF}\\x{FFFD}\\x{FEFF}\\x{200B}-\\x{200F}\\x{2500}-\\x{257F}]", "")


def clean_space(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit(""))


def clean_tips(c: Column, watermark: str = WATERMARK) -> Column:
    return F.replace(c, F.lit(watermark), F.lit(""))


def no_html_clean(c: Column) -> Column:
    for rule in (convert_newlines, single_space, tabs_to_spaces, simplify_chinese, remove_invisible_chars, convert_newlines):
        c = rule(c)
    return c


def full_clean(c: Column) -> Column:
    for rule in (point_conversion, remove_html_tags, convert_newlines, single_space, tabs_to_spaces, simplify_chinese, remove_invisible_chars, convert_newlines, clean_tips):
        c = rule(c)
    return c


def nlp_clean(c: Column) -> Column:
    """Tags, abnormal characters, invisible characters and spare spaces."""
    return F.trim(single_space(remove_invisible_chars(remove_abnormal_chars(remove_html_tags(c)))))


def markdown_format(c: Column) -> Column:
    """The text as it is: a step that is named and does nothing."""
    return c


def references(c: Column, bracketed: bool = False) -> Column:
    """Distinct references of a text, sorted, one a line: links, DOIs, two-author citations; opt-in years and numbers in brackets."""
    patterns = [r"DOI:[ \t]?[^ \t\r\n]+|https?://[^ \t\r\n]+", r"[A-Z][a-z]+ and [A-Z][a-z]+,? \(?[0-9]{4}\)?"]
    if bracketed:
        patterns += [r"\([0-9]{4}\)", r"\[[0-9]+\]"]
    found = F.concat(*[F.regexp_extract_all(c, F.lit(p), 0) for p in patterns])
    return F.array_join(F.array_sort(F.array_distinct(found)), "\n")
