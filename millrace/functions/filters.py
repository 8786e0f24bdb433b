"""Quality predicates of a text as Column functions; null texts are rejected."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.batches import sliced

_written_out = ContextVar("written_out", default=False)


@contextmanager
def written_out():
    """Within this, ``bound`` writes its argument out wherever it stands, as SQL text has no way to bind it."""
    token = _written_out.set(True)
    try:
        yield
    finally:
        _written_out.reset(token)


def bound(c: Column, of) -> Column:
    """``of(c)`` with c evaluated once a row, wherever the optimizer moves the expression."""
    return of(c) if _written_out.get() else F.element_at(F.transform(F.array(c), of), 1)


def gated(c: Column, gate, rule) -> Column:
    """``rule(c)`` where the cheap test ``gate(c)`` says that it may change c, else c, which is evaluated once."""
    return bound(c, lambda t: F.when(gate(t), rule(t)).otherwise(t))


def computed(df: DataFrame, name: str, c: Column) -> DataFrame:
    """``df`` with the column ``name``, computed once: no filter above is moved below it and computes it again."""
    return df.select(*[x for x in df.columns if x != name], F.explode(F.array(c)).alias(name))


def _peak(text: str | None) -> float | None:
    if text is None or len(text) < 2:
        return None
    pieces = np.frombuffer(text[: len(text) // 2 * 2].encode("utf-32-le", "surrogatepass"), np.uint64)
    ordered = np.sort(pieces)
    ends = np.flatnonzero(np.append(ordered[1:] != ordered[:-1], True))
    return float(np.diff(ends, prepend=-1).max() / len(pieces))


@F.arrow_udf(T.DoubleType())
def bigram_peak(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Share of the most common two-character piece at offsets 0, 2, 4, ...; an odd last character is left out; null below two characters."""
    return sliced(batches, _peak, pa.float64())


def few_repeats(c: Column, most: float = 0.6) -> Column:
    return F.coalesce(bigram_peak(c) <= most, F.lit(False))


def char_count(c: Column, least: int = 30, most: int = 500_000) -> Column:
    return F.coalesce(F.length(c).between(least, most), F.lit(False))


def few_digits(c: Column, most: float = 0.6) -> Column:
    digits = F.length(F.regexp_replace(c, r"\P{Nd}++", ""))  # no list of matches is made
    return F.coalesce(digits / F.nullif(F.length(c), F.lit(0)) <= most, F.lit(False))


def keep(c: Column, repeats: float = 0.6, least: int = 30, most: int = 500_000, digits: float = 0.6) -> Column:
    """All three rules; Spark applies the two native ones before the batches of the third. ``c`` should be a plain column (see ``computed``)."""
    return char_count(c, least, most) & few_digits(c, digits) & few_repeats(c, repeats)


RECOGNISED = r"[\x20-\x7E\n\r\t\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}]"


def readable(c: Column, least: int = 50, share: float = 0.7) -> Column:
    """Long enough, and mostly of characters that a decoder meant."""
    odd = F.length(F.regexp_replace(c, RECOGNISED + "++", ""))
    return F.coalesce((F.length(c) >= least) & ((F.length(c) - odd) / F.nullif(F.length(c), F.lit(0)) >= share), F.lit(False))


def retryable(status: Column, body: Column) -> Column:
    """Whether a request may be sent again."""
    return status.isNull() | status.isin(408, 409, 425, 429, 500, 502, 503, 504) | ((status == 400) & F.coalesce(F.lower(body).contains("rate"), F.lit(False)))
