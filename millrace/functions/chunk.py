"""Splitting texts into chunks."""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.batches import sliced
from millrace.functions.filters import bound
from millrace.functions.tables import CODE_LANGUAGES


def _check(size: int, overlap: int) -> None:
    if not 0 <= overlap < size:
        raise ValueError("the overlap has to be smaller than the chunk")


def windows(c: Column, size: int, overlap: int) -> Column:
    """Fixed windows of ``size`` characters every ``size - overlap``; none for an empty text.

    The text is cut once into pieces of the step's length, and a window is a piece
    and the beginning of those that follow, so the time is linear in the text.
    """
    _check(size, overlap)
    step = size - overlap

    def of(parts: Column) -> Column:
        n = F.greatest(F.ceil((parts["n"] - overlap) / step), F.lit(1)).cast("int")
        more = lambda k, j: F.coalesce(F.try_element_at(parts["p"], k + 1 + j), F.lit(""))
        rest = lambda k: F.substring(F.concat(*[more(k, j) for j in range(1, -(-overlap // step) + 1)]), 1, overlap)
        return F.transform(F.slice(parts["p"], F.lit(1), n), (lambda x, k: F.concat(x, rest(k))) if overlap else (lambda x: x))

    pieces = F.regexp_extract_all(c, F.lit(f"(?s).{{1,{step}}}+"), 0)
    cut = bound(F.struct(F.length(c).alias("n"), pieces.alias("p")), of)
    return F.when(F.length(c) > size, cut).when(F.length(c) > 0, F.array(c)).otherwise(F.array().cast("array<string>"))


def fill_sentences(text: str, size: int = 500, overlap: int = 100) -> list[str]:
    """Sentences (ended by a CJK full stop, exclamation or question mark) are filled up to ``size``.

    On overflow the next chunk begins with the last ``overlap`` characters of the
    one before; a chunk that is still too long is cut into fixed windows.
    """
    _check(size, overlap)
    out: list[str] = []
    now = ""
    for sentence in re.split("(?<=[。！？])", text):
        if len(now) + len(sentence) <= size:
            now += sentence
            continue
        if now:
            out.append(now)
        now = now[len(now) - min(overlap, len(now)) :] + sentence
        while len(now) > size:
            out.append(now[:size])
            now = now[size - overlap :]
    return [*out, now] if now else out


def paragraphs(c: Column, size: int = 500, overlap: int = 100) -> Column:
    """``fill_sentences`` in Arrow batches for texts with such marks; for others ``windows`` is the same, and native."""
    marked = F.coalesce(c.rlike("[。！？]"), F.lit(False))
    return F.when(marked, splitter(fill_sentences, size=size, overlap=overlap)(F.when(marked, c))).otherwise(windows(c, size, overlap))


def chunk_rows(df, text: str = "text", size: int = 500, overlap: int = 100):
    """One row a chunk, with chunk_index from 0; all columns stay."""
    return df.select("*", F.posexplode(paragraphs(F.col(text), size, overlap)).alias("chunk_index", "chunk"))


def _ends(text: str, begin: int, end: int, size: int, separators: Sequence[str]) -> Iterator[int]:
    """Where the pieces of text[begin:end] end: up to ``size`` characters, cut before the first separator that occurs and, too long ones, the next."""
    if end - begin <= size:
        if begin < end:
            yield end
        return
    for k, sep in enumerate(separators):
        if not sep:
            break
        at = text.find(sep, begin, end)
        if at < 0:
            continue
        further = separators[k + 1 :] or ("",)
        while begin < end:
            stop = at if at >= 0 else end
            if stop - begin > size:
                yield from _ends(text, begin, stop, size, further)
            elif begin < stop:
                yield stop
            begin, at = stop, text.find(sep, stop + len(sep), end)
        return
    yield from range(begin + 1, end + 1)


def split_recursive(text: str, size: int, overlap: int, separators: Sequence[str] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Pieces split at the first separator that occurs, too long ones at the next, then merged up to ``size`` with overlap.

    Pieces follow one another without gaps, so places in the text stand for them and none is held but those of a chunk.
    """
    _check(size, overlap)
    out: list[str] = []
    held: deque[int] = deque()  # where the pieces of text[first:last] end
    first = last = 0
    for end in _ends(text, 0, len(text), size, separators):
        if held and end - first > size:
            out.append(text[first:last].strip())
            while held and (last - first > overlap or end - first > size):
                first = held.popleft()
        held.append(end)
        last = end
    out.append(text[first:last].strip())
    return [x for x in out if x]


#: Separators by language family, tried before the general ones (fixed values).
CODE_SEPARATORS = {
    "python": ("\nclass ", "\ndef ", "\n\tdef ", "\n    def "),
    "javascript": ("\nfunction ", "\nclass ", "\nconst ", "\nlet "),
    "java": ("\nclass ", "\npublic ", "\nprivate ", "\nprotected "),
    "go": ("\nfunc ", "\ntype ", "\nvar "),
    "rust": ("\nfn ", "\nimpl ", "\nstruct "),
    "sql": ("\nCREATE ", "\nSELECT ", "\nINSERT "),
}


def split_code(text: str, language: str = "generic", size: int = 4000, overlap: int = 200) -> list[str]:
    return split_recursive(text, size, overlap, (*CODE_SEPARATORS.get(language, ()), "\n\n", "\n", " ", ""))


def split_json(value, size: int = 2000, at: str = "$") -> list[str]:
    """JSON chunks of at most ``size`` characters where the structure allows; each names its place."""
    text = json.dumps(value, ensure_ascii=False)
    if len(text) <= size or not isinstance(value, (dict, list)):
        return [json.dumps({at: value}, ensure_ascii=False)]
    items = value.items() if isinstance(value, dict) else enumerate(value)
    return [c for k, v in items for c in split_json(v, size, f"{at}.{k}")]


def splitter(split: Callable[..., list[str]], **options) -> Callable[[Column], Column]:
    """A text splitter as a column function over slices of Arrow batches."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return sliced(batches, lambda t: split(t, **options) if t else [], pa.list_(pa.string()))

    return run


def code_language(name: Column, text: Column) -> Column:
    """Language by extension, else by ordered marks in the text, else generic."""
    known = F.create_map(*[F.lit(x) for pair in CODE_LANGUAGES.items() for x in pair])
    by_name = F.try_element_at(known, F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1)))
    has = text.contains
    marks = (
        F.when(has("def ") & has("import "), "python").when(has("function") & (has("const ") | has("let ")), "javascript").when(has("class ") & has("public "), "java")
        .when(has("#include") & has("int main"), "cpp").when(has("package ") & has("func "), "go").when(has("fn ") & has("let "), "rust")
    )
    return F.coalesce(by_name, marks, F.lit("generic"))


def code_markdown(chunks: Column, language: Column, path: Column) -> Column:
    """A markdown document of code chunks: a header block, then each chunk in a fence with its numbers of lines and characters."""

    def one(x: Column, k: Column) -> Column:
        lines = F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit(""))) + 1
        count = F.concat(F.lit("*Lines: "), lines.cast("string"), F.lit(", Characters: "), F.length(x).cast("string"), F.lit("*\n\n---\n\n"))
        return F.concat(F.lit("## Chunk "), (k + 1).cast("string"), F.lit("\n\n```"), language, F.lit("\n"), x, F.lit("\n```\n\n"), count)

    head = F.concat(F.lit("# Code Analysis: "), path, F.lit("\n\n**Language:** "), language, F.lit("\n**Total Chunks:** "), F.size(chunks).cast("string"), F.lit("\n\n"))
    return F.concat(head, F.array_join(F.transform(chunks, one), ""))
