"""Document fingerprints by locally consistent parsing.

Symbols are code points, hashed. On each level, runs of a symbol become one
name; deterministic coin tossing labels every symbol by the lowest bit in which
it differs from the one before, four times, until labels are below six while
neighbours still differ; symbols whose label is a local maximum start phrases;
and a phrase's name is a hash of its symbols, which are the next level's symbols.
A cut depends on a few neighbouring symbols only, so equal substrings get equal
phrases inside, wherever they stand.

A fingerprint is a one-permutation sketch of the names in four sections (symbols,
phrases of level 1, of level 2, of levels from 3), one byte a bin, in hexadecimal,
00 for an empty bin. A name that is repeated in a row counts as often as it is
repeated, so a long stretch of one phrase weighs as much as its length. Likeness is
the share of equal bins among those that either has, in the highest section of
which both have enough.

Null and empty texts have the empty fingerprint; two empty ones are alike (1),
an empty one and another are not (0). Equal texts have equal fingerprints. Null
ids come before all others; rows that repeat an id follow one another by a hash of
their texts; a table of one row is followed by itself; an empty table gives an
empty table. Very long texts are parsed one at a time; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.id_ranges import partitions, ranges_of, text_hash
from millrace.session import share_code

SECTIONS = (32, 32, 32, 96)  # bins of symbols and of levels 1, 2 and 3 up
ENOUGH = 16
MAX_LEVELS = 40
_SYMBOLS_AT_ONCE = 1 << 16
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x + _K1
    x ^= x >> np.uint64(30)
    x *= _K2
    x ^= x >> np.uint64(27)
    x *= _K3
    x ^= x >> np.uint64(31)
    return x


def _labels(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below six; neighbours within a text differ. first: where texts start."""
    x = names
    for _ in range(4):
        apart = np.empty_like(x)
        apart[1:] = x[1:] ^ x[:-1]
        apart[first] = ~x[first]  # as if the symbol before differed in every bit
        low = (apart & (~apart + apart.dtype.type(1))) - apart.dtype.type(1)
        at = np.bitwise_count(low)
        bit = (x >> at.astype(x.dtype)) & x.dtype.type(1)
        x = (2 * at + bit.astype(np.uint8)).astype(np.uint8)
    return x


def _parse(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrase names of the next level and where texts start in them; no text is empty."""
    new = np.empty(len(names), bool)
    new[0] = True
    new[1:] = names[1:] != names[:-1]
    new[first] = True
    starts = np.flatnonzero(new)
    if len(starts) < len(names):
        length = np.diff(np.append(starts, len(names))).astype(np.uint64)
        first = np.searchsorted(starts, first)
        names = names[starts]
        runs = np.flatnonzero(length > 1)
        names[runs] = _mix(names[runs] ^ (length[runs] * _K2))
    label = _labels(names, first)
    cut = np.zeros(len(names), bool)
    if len(names) > 2:
        cut[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    last = np.append(first[1:], len(names)) - 1
    cut[last] = False
    cut[first] = True
    starts = np.flatnonzero(cut)
    place = np.arange(len(names)) - np.repeat(starts, np.diff(np.append(starts, len(names))))
    value = _mix(names ^ ((place.astype(np.uint64) + np.uint64(1)) * _K1))
    return _mix(np.add.reduceat(value, starts)), np.searchsorted(starts, first)


def _places_in_runs(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """0 for the first of a run of equal names, then 1, 2 and so on."""
    new = np.empty(len(names), bool)
    new[0] = True
    new[1:] = names[1:] != names[:-1]
    new[first] = True
    starts = np.flatnonzero(new)
    if len(starts) == len(names):
        return np.zeros(len(names), np.uint64)
    return (np.arange(len(names)) - np.repeat(starts, np.diff(np.append(starts, len(names))))).astype(np.uint64)


def sketches(texts: list[str]) -> np.ndarray:
    """(texts, bins) bytes of the fingerprints."""
    out = np.zeros((len(texts), sum(SECTIONS)), np.uint8)
    group: list[int] = []
    size = 0
    for k, x in enumerate(texts):
        if x:
            group.append(k)
            size += len(x)
        if group and (size >= _SYMBOLS_AT_ONCE or k == len(texts) - 1):
            out[group] = _sketch([texts[g] for g in group])
            group, size = [], 0
    return out


def _sketch(texts: list[str]) -> np.ndarray:
    first = np.cumsum([0, *map(len, texts[:-1])])
    names = _mix(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64))
    least = np.full((len(texts), sum(SECTIONS)), 0xFFFFFFFF, np.uint32)
    there = np.zeros(least.shape, bool)
    begin = np.cumsum([0, *SECTIONS])
    ids = np.arange(len(texts))  # of the texts that go on: one that is a single name is done
    for level in range(MAX_LEVELS + 1):
        if level:
            names, first = _parse(names, first)
        section = min(level, len(SECTIONS) - 1)
        again = _places_in_runs(names, first)
        count = np.diff(np.append(first, len(names)))
        h = _mix(names ^ np.uint64(section + 1) ^ (again * _K2))
        bins = begin[section] + ((h >> np.uint64(40)) % np.uint64(SECTIONS[section])).astype(np.int64)
        flat = np.repeat(ids, count) * least.shape[1] + bins
        np.minimum.at(least.reshape(-1), flat, (h & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        there.reshape(-1)[flat] = True
        more = count > 1
        if not more.any():
            break
        if not more.all():
            names, ids, count = names[np.repeat(more, count)], ids[more], count[more]
            first = np.cumsum(count) - count
    value = _mix(least.astype(np.uint64)) % np.uint64(255) + np.uint64(1)
    return np.where(there, value, 0).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness of the rows of two arrays of sketches, 0 to 1."""
    out = (~a.any(axis=1) & ~b.any(axis=1)).astype(float)
    end = 0
    for bins in SECTIONS:  # the highest section of which both have enough stands
        x, y = a[:, end : end + bins], b[:, end : end + bins]
        fewer = np.minimum((x > 0).sum(axis=1), (y > 0).sum(axis=1))
        either = ((x > 0) | (y > 0)).sum(axis=1)
        same = ((x == y) & (x > 0)).sum(axis=1)
        take = (fewer >= ENOUGH) | ((either > 0) & (end == 0))
        out = np.where(take, same / np.maximum(either, 1), out)
        end += bins
    return out


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by the first as many code points of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every row."""

    def run(batches):
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            prints = [x.tobytes().hex() for x in sketches(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array(prints, pa.string())], ["doc_id", "n_chars", "fingerprint"])

    share_code(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_chars long, fingerprint string")


def with_following(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, range, extra) dealt by id ranges, ascending, so that each text comes after the one that follows it in descending order.

    The last document of each range also goes, as an extra row, before the next
    range, and the last of all before the first: one row a partition more, found
    by a broadcast of as many ids. Rows with one id are ordered by the text; where an
    id is dealt over several ranges, by a hash of the text first.
    """
    ranges = ranges_of(docs, id_col, partitions(docs))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("hash", text_hash(F.col("text")) if ranges.hot else F.lit(0).cast("long"))  # without it, only ids are read for the tops
    ranged = rows.withColumn("range", ranges.of(F.col("doc_id"), F.col("hash")))
    top = F.max(F.struct("doc_id", "hash")) if ranges.hot else F.struct(F.max("doc_id").alias("doc_id"), F.lit(0).cast("long").alias("hash"))
    tops = ranged.groupBy("range").agg(top.alias("top")).orderBy("range").collect()  # a row a partition
    goes = [(x.top.doc_id, x.top.hash, tops[(k + 1) % len(tops)].range) for k, x in enumerate(tops)]
    extra = docs.sparkSession.createDataFrame(goes, f"top {kind}, top_hash long, to int")
    placed = ranged.join(F.broadcast(extra), ranged["doc_id"].eqNullSafe(extra["top"]) & (ranged["hash"] == extra["top_hash"]), "left")
    own, other = F.struct(F.col("range").alias("range"), F.lit(False).alias("extra")), F.struct(F.col("to").alias("range"), F.lit(True).alias("extra"))
    placed = placed.select("doc_id", "text", "hash", F.explode(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, other))).alias("at"))
    placed = placed.select("doc_id", "text", "hash", "at.range", "at.extra").repartitionById(ranges.n, F.col("range"))
    return placed.sortWithinPartitions("range", F.col("extra").desc(), F.col("doc_id").asc_nulls_first(), "hash", "text").select("doc_id", "text", "range", "extra")


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches):
        before, before_range = "", None
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                texts = [x or "" for x in batch.column(1).to_pylist()]
                ranges, extra = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                following = []
                for k, x in enumerate(texts):
                    following.append(before if ranges[k] == before_range else "")
                    before, before_range = x, ranges[k]
                keep = np.flatnonzero(~np.array(extra, bool))
                if not len(keep):
                    continue
                changed = [edited(texts[k], following[k]) for k in keep]
                lead = following[keep[0]]
                every = sketches([lead, *texts])
                own = every[keep + 1]
                next_ = every[keep]
                if keep[0] and ranges[keep[0]] != ranges[keep[0] - 1]:
                    next_[0] = 0
                other = sketches(changed)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(keep)),
                        pa.array([len(texts[k]) for k in keep], pa.int64()),
                        pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in changed]),
                        pa.array([x.tobytes().hex() for x in own], pa.string()),
                        pa.array([x.tobytes().hex() for x in other], pa.string()),
                        pa.array(likeness(own, other)),
                        pa.array(likeness(own, next_)),
                    ],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    share_code(docs.sparkSession)
    if docs.select(id_col).isEmpty():
        return docs.sparkSession.createDataFrame([], schema)
    return with_following(docs, id_col, text_col).mapInArrow(run, schema)
