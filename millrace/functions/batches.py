"""Arrow batches of texts in slices, so that a Python worker's memory goes with a slice and not with what Spark sends at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def sliced(batches: Iterator[pa.Array], of: Callable[[str | None], object], kind: pa.DataType, most: int = 1 << 20) -> Iterator[pa.Array]:
    """``of`` each text, in arrays of that type; one is made of about ``most`` bytes of text, or of a single longer text."""
    for texts in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(ends // most)) + 1).tolist(), len(texts)]
        for a, b in pairwise(cuts):
            yield pa.array([of(t) for t in texts[a:b].to_pylist()], kind)
