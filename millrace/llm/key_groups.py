"""Rows of one key brought together for pairs to be formed in numpy; a large key comes in pairs of blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP = ["key", "lo", "hi"]


def dealt(rows: DataFrame, block: int) -> DataFrame:
    """``rows`` (key, n, node, ...), once for each pair of blocks that the row's block is in; n is how many rows the key has.

    Rows of one block ``mine`` meet in all groups of that block, and belong to the one of lo = hi.
    """
    rows = rows.withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), *[c for c in rows.columns if c not in ("key", "n", "blocks", "other")])


def whole_groups(batches):
    """Tables of whole groups from sorted rows, each with the ordinals of its rows' groups."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch])
        held = new if held is None else pa.concat_tables([held, new]).combine_chunks()
        group = _ordinals(held)
        last = int(np.searchsorted(group, group[-1]))
        if last:
            yield held.slice(0, last).combine_chunks(), group[:last]
            held = held.slice(last)
    if held is not None:
        held = held.combine_chunks()
        yield held, _ordinals(held)


def _ordinals(rows: pa.Table) -> np.ndarray:
    by = np.stack([rows[c].to_numpy() for c in GROUP])
    return np.concatenate([[0], (by[:, 1:] != by[:, :-1]).any(axis=0).cumsum()])


def starts(*sorted_by: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    new = np.ones(len(sorted_by[0]), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in sorted_by])
    return np.flatnonzero(new)
