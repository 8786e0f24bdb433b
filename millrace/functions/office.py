"""Text rules of office files: what is left to do once a decoder, or none, has given characters."""

from __future__ import annotations

import html as entities
import quopri
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: First bytes of compound files (fixed value).
COMPOUND = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
#: Marks that end a sentence, so that a short line is no title (fixed values).
SENTENCE_ENDS = "。.！!？?"
#: What a scrubbed text may hold besides letters, digits, underscores and white space (fixed values).
ALLOWED = r"一-鿿぀-ヿ가-힯，。！？；：（）【】《》、·…—.,!?;:()\[\]{}\"'`~@#$%\^&*+=\-/\\\\"


def wps_kind(content: Column) -> Column:
    """ms_works, ole_based, wps_office or generic, by the first 512 bytes."""
    head = F.hex(F.substring(content, 1, 512))
    # A mark counts at whole bytes only, so at odd places of the hexadecimal digits.
    has = lambda mark: head.rlike(f"^(..)*?{mark.hex().upper()}")
    return F.when(has(b"Microsoft Works"), "ms_works").when(head.startswith(COMPOUND.hex().upper()), "ole_based").when(has(b"WPS") | has(b"Kingsoft"), "wps_office").otherwise("generic")


def titles_as_headers(c: Column) -> Column:
    """Short lines without a closing mark become headers, lines become paragraphs; empty texts stay."""
    line = lambda x: F.trim(F.regexp_replace(x, r"^[\t\r\x0B\f]+|[\t\r\x0B\f]+$", ""))

    def header(x: Column) -> Column:
        ends = F.rlike(x, F.lit(f"[{SENTENCE_ENDS}]$"))
        return F.when((x == "") | ends | (F.length(x) >= 50), x).when(F.length(x) < 20, F.concat(F.lit("## "), x)).otherwise(F.concat(F.lit("### "), x))

    text = F.array_join(F.transform(F.transform(F.split(c, "\n"), line), header), "\n\n")
    return F.regexp_replace(F.regexp_replace(text, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def scrub(c: Column) -> Column:
    """Plain text out of what was read from a binary file: tags, prefixes, control characters, entities and odd characters go,
    long repeats become one, and lines that are mostly marks go; what is left is empty if under ten characters."""
    for name in ("&lt;", "&gt;", "&quot;", "&#39;", "&nbsp;", "&amp;"):
        c = F.replace(c, F.lit(name), F.lit(entities.unescape(name)))
    steps = (
        (r"<[^>]+>", ""), (r"\b[\p{L}\p{N}_]+:", ""), (r"[\x00-\x08\x0b-\x0c\x0e-\x1f\x7f]", ""), (r"&[a-zA-Z]+;|&#[0-9]+;|&#x[0-9a-fA-F]+;", ""),
        (r"[^\p{L}\p{N}_\s" + ALLOWED + "]", ""), (r"([^\s一-鿿])\1{5,}", "$1"), (r"[ \t]+", " "), (r"\n\s*\n\s*\n+", "\n\n"),
    )
    for pattern, to in steps:
        c = F.regexp_replace(c, pattern, to)
    lines = F.transform(F.split(c, "\n"), lambda x: F.trim(x))
    meant = lambda x: F.length(F.regexp_replace(x, r"[^\p{L}\p{N}]", ""))
    kept = F.filter(lines, lambda x: (F.length(x) < 5) | (meant(x) / F.length(x) > 0.3))
    text = F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), "\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    return F.when(F.length(text) < 10, "").otherwise(text)


#: Tags and what stands for them in plain text, in this order (fixed values).
BLOCKS = (
    (r"<br\s*/?>", "\n"), ("</p>", "\n"), ("<p[^>]*>", ""), ("</div>", "\n"), ("<div[^>]*>", ""), ("</h[1-6]>", "\n\n"), ("<h[1-6][^>]*>", ""),
    ("</li>", "\n"), ("<li[^>]*>", "• "), ("</tr>", "\n"), ("</td>", " | "), ("</th>", " | "),
)
_CODE = re.compile(r"(?is)<pre[^>]*>\s*<code[^>]*>(.*?)</code>\s*</pre>")


def blocks_to_text(c: Column) -> Column:
    """Text of HTML with lines for its blocks, a bar between cells, and one blank line at most; native, without entities and code blocks."""
    for pattern, to in BLOCKS:
        c = F.regexp_replace(c, "(?i)" + pattern, to)
    for pattern in ("(?is)<style[^>]*>.*?</style>", "(?is)<script[^>]*>.*?</script>", "<[^>]+>"):
        c = F.regexp_replace(c, pattern, "")
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t\r]+", " "), r" *\| *", " | ")
    lines = F.transform(F.split(c, "\n"), lambda x: F.trim(x))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def mht_to_text(raw: bytes) -> str:
    """Text of an HTML part in quoted-printable: its body, entities decoded, code blocks kept as they are."""
    text = quopri.decodestring(raw).decode("utf-8", "replace") if re.search(rb"=[0-9A-F]{2}|=\r?\n", raw) else raw.decode("utf-8", "replace")
    body = re.search(r"(?is)<body[^>]*>(.*?)</body>", text)
    text = body[1] if body else text
    code: list[str] = []

    def put(m: re.Match) -> str:
        code.append(entities.unescape(m[1]))
        return f"\0{len(code) - 1}\0"

    text = _CODE.sub(put, text)
    for pattern, to in BLOCKS:
        text = re.sub("(?i)" + pattern, to, text)
    text = entities.unescape(re.sub(r"(?is)<(style|script)[^>]*>.*?</\1>|<[^>]+>", "", text))
    lines = [re.sub(r"\s*\|\s*", " | ", re.sub(r"[ \t]+", " ", x.strip())) for x in text.split("\n")]
    text = re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()
    return re.sub("\0(\\d+)\0", lambda m: code[int(m[1])], text)


@F.pandas_udf(T.StringType())
def mht_text(content: pd.Series) -> pd.Series:
    return content.map(lambda x: None if x is None else mht_to_text(bytes(x)))
