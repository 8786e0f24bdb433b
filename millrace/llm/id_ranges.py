"""Rows dealt into partitions by ranges of their id, in ascending order, without reading the texts twice.

The cut points are percentiles of the id column alone, one number a partition,
so the wide rows move once. Nulls come first. An id that fills several ranges by
itself, or null where it does, is dealt over as many by a hash of the text, and
equal ids are ordered by that hash, so no range has more than about its share.
Equal rows stay together.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

SAMPLE = 64
_HASHES = 1 << 20


def partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def text_hash(text: Column) -> Column:
    """By which rows of one id are ordered and dealt."""
    return F.pmod(F.xxhash64(text), F.lit(_HASHES))


@dataclass(frozen=True)
class Ranges:
    """``cuts`` are ascending ids at which a range starts, ``shares`` how many ranges each of them fills itself, ``nulls`` how many null does."""

    cuts: tuple
    shares: tuple[int, ...]
    nulls: int = 1

    @property
    def n(self) -> int:
        return self.nulls + sum(self.shares)

    @property
    def hot(self) -> bool:
        """Whether some id, or null, is dealt over several ranges; only then are hashes of texts needed."""
        return self.nulls > 1 or any(x > 1 for x in self.shares)

    def of(self, ids: Column, hashes: Column) -> Column:
        """The number of a row's range, by a balanced tree of comparisons."""
        ends = [self.nulls - 1]
        for share in self.shares:
            ends.append(ends[-1] + share)
        part = lambda share: F.floor(hashes * share / F.lit(_HASHES))

        def between(lo: int, hi: int) -> Column:
            if lo == hi:
                return F.lit(ends[lo])
            mid = (lo + hi) // 2
            return F.when(ids < F.lit(self.cuts[mid]), between(lo, mid)).otherwise(between(mid + 1, hi))

        out = between(0, len(self.cuts))
        for k, share in enumerate(self.shares):
            if share > 1:
                out = F.when(ids == F.lit(self.cuts[k]), F.lit(ends[k] + 1) + part(share)).otherwise(out)
        return F.when(ids.isNull(), part(self.nulls)).otherwise(out).cast("int")


def ranges_of(df: DataFrame, id_col: str, n: int) -> Ranges:
    """About ``n`` ranges of equal numbers of rows."""
    if n < 2:
        return Ranges((), ())
    if isinstance(df.schema[id_col].dataType, NumericType):
        got = df.agg(F.percentile_approx(id_col, [k / n for k in range(1, n)], 20 * n).alias("p"), F.count("*").alias("rows"), F.count(id_col).alias("ids")).first()
        points, rows, ids = got.p or [], got.rows, got.ids
    else:  # ids without percentiles: about SAMPLE rows a range stand for all
        rows, ids = df.agg(F.count("*"), F.count(id_col)).first()
        share = min(1.0, SAMPLE * n / max(1, ids))
        some = df.select(id_col).where(F.col(id_col).isNotNull() & (F.rand(42) < share)).groupBy(id_col).count().orderBy(id_col).collect()
        total, seen, points = sum(x[1] for x in some), 0, []
        for value, count in some:
            points += [value] * ((seen + count) * n // total - seen * n // total)
            seen += count
        points = points[: n - 1]
    found = Counter(x for x in points if x is not None)
    cuts = tuple(sorted(found))
    return Ranges(cuts, tuple(found[x] for x in cuts), max(1, n * (rows - ids) // max(1, rows)))


def dealt(df: DataFrame, id_col: str, text_col: str, ranges: Ranges) -> DataFrame:
    """``df`` with the columns __range and __hash, dealt by the range and sorted by it, the id and the hash within partitions."""
    rows = df.withColumn("__hash", text_hash(F.col(text_col)))
    rows = rows.withColumn("__range", ranges.of(F.col(id_col), F.col("__hash")))
    return rows.repartitionById(ranges.n, F.col("__range")).sortWithinPartitions("__range", F.col(id_col).asc_nulls_first(), "__hash", text_col)
