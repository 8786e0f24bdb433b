"""Units of a batch of texts: every distinct one is looked up once, and ids are put together again in numpy.

A unit is a run of bytes of one class, with the spaces before it. Nothing here
depends on the vocabulary: a caller says which classes there are and gives the
ids of the distinct units.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Classes of bytes: letters of any script (1), digits (2), line feed (3), space (4), others (0).
CLASSES = np.array([1 if b >= 128 or chr(b).isalpha() else 2 if chr(b).isdigit() else {10: 3, 32: 4}.get(b, 0) for b in range(256)], np.uint8)


def distinct_units(texts: list[bytes], glue: bytes = b" ") -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(place of each unit among the distinct ones, where each text's units end, distinct units); nothing is cut after a byte of ``glue``."""
    data = b"".join(texts)
    raw = np.frombuffer(data, np.uint8)
    kind = CLASSES[raw]
    free = np.ones(256, bool)
    free[list(glue)] = False
    cut = np.empty(len(raw), bool)
    cut[1:] = (kind[1:] != kind[:-1]) & free[raw[:-1]]
    bounds = np.cumsum([0, *map(len, texts)])
    cut[bounds[:-1][np.diff(bounds) > 0]] = True
    starts = np.flatnonzero(cut)
    offsets = np.append(starts, len(raw)).astype(np.int32)
    coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
    return coded.indices.to_numpy(), np.searchsorted(starts, bounds[1:]), coded.dictionary.to_numpy(zero_copy_only=False).tolist()


def gather(table: list[bytes], places: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """The ids (little-endian, 32 bits) of each text: those of its words in ``table``, one after the other."""
    blob = np.frombuffer(b"".join(table), "<u4")
    size = np.fromiter(map(len, table), np.int64, len(table)) // 4
    start = np.cumsum(size) - size
    n = size[places]
    upto = np.cumsum(n)
    ids = blob[np.repeat(start[places] - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)]
    bounds = np.concatenate([[0], upto])[ends]
    return np.split(ids, bounds[:-1]) if len(bounds) else []


class Memo:
    """A dictionary in two generations of bounded size: what is in use stays."""

    def __init__(self, most: int) -> None:
        self.most, self.new, self.old = most, {}, {}

    def get(self, key: str) -> bytes | None:
        got = self.new.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self.new[key] = got
        return got

    def put(self, key: str, value: bytes) -> None:
        if len(key) <= 200:
            if len(self.new) >= self.most:
                self.old, self.new = self.new, {}
            self.new[key] = value

    def table(self, keys: list[str], learn) -> list[bytes]:
        """The values of distinct keys; ``learn`` gives those of a list that isn't there."""
        out = list(map(self.new.get, keys))
        new, old, missing = self.new, self.old, []
        for k, x in enumerate(out):
            if x is None:
                if (x := old.get(keys[k])) is None:
                    missing.append(k)
                else:
                    out[k] = new[keys[k]] = x
        for k, x in zip(missing, learn([keys[k] for k in missing])):
            out[k] = x
            self.put(keys[k], x)
        return out


def slices(sizes: list[int], most: int):
    """(from, to) of runs of texts of at most ``most`` bytes in all; a longer text is a run of its own."""
    at = 0
    while at < len(sizes):
        to, size = at, 0
        while to < len(sizes) and (to == at or size + sizes[to] <= most):
            size += sizes[to]
            to += 1
        yield at, to
        at = to
