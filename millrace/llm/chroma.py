"""Chroma audio fingerprints of a media column, and the alignment of recordings.

A recording is unsigned 8-bit mono PCM in a binary column. Its frames' spectra are
folded into twelve pitch classes; rectangular filters, evaluated on an integral
image over frames and pitch classes, are quantised to two bits each and packed
into one 32-bit integer a frame.

Recordings with equal fingerprints are one class, so copies cost nothing more.
Between classes, pairs of neighbouring integers picked by winnowing are keys. Two
classes are linked where, at one offset, they share at least ``MIN_VOTES`` keys and
few bits differ over the whole overlap; of several such offsets the one of most
votes is the pair's. Every row has the number of classes that its class is linked
with, and the best link to an earlier class (of smaller id): most votes, of equals
the smallest id.

All pairs that share enough keys are verified, each once: the keys of a class are
ordered from the rarest on, and a pair belongs to the first key that both have. The
holders of a key come together with all their shared keys, form their pairs in numpy,
and leave the task as one row each, with a count and the best, so no table has a row
a pair. The work still grows with the square of the number of different recordings
around a common passage, as do the links themselves. A key with more than ``BLOCK``
holders is dealt over tasks by pairs of blocks. Integers are only read where a first
pass has found enough common keys.

Null and empty media have no integers and no alignment; media shorter than one
window are padded with silence to one. Repeated ids are rows of their own class
member list; two recordings of one id can be linked, but not aligned to their own id.
A recording that only rows without an id have is a class too, after all others, and
nothing is aligned to it. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.key_groups import GROUP, dealt, starts, whole_groups
from millrace.session import settle, share_code

RATE, FRAME, HOP = 8000, 256, 32
SPAN = 16  # frames under a filter
WINNOW = 8
MAX_BIT_ERROR = 0.2
MIN_VOTES = 2
MIN_OVERLAP = 8
BLOCK = 1024
_FRAMES_AT_ONCE = 1 << 14
_PAIRS_AT_ONCE = 1 << 20
#: (kind, first pitch class, classes, frames): eight bands by rule, each under two kinds of filter.
FILTERS = [(kind, 3 * k // 2 % 12, 3 + k % 3, SPAN >> (k % 3)) for k in range(8) for kind in ("time", "pitch")]
_QUANTA = (-0.12, 0.0, 0.12)


@cache
def _fold() -> np.ndarray:
    """(bins, 12): which pitch class each spectral bin belongs to."""
    hz = np.arange(1, FRAME // 2 + 1) * RATE / FRAME
    out = np.zeros((FRAME // 2 + 1, 12), np.float32)
    out[np.arange(1, len(hz) + 1), np.round(12 * np.log2(hz / 27.5)).astype(int) % 12] = 1
    return out


def chroma(samples: np.ndarray) -> np.ndarray:
    """(frames, 12), each row of length one where there is sound."""
    n = (len(samples) - FRAME) // HOP + 1
    windows = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP][:n]
    taper = np.hanning(FRAME).astype(np.float32)
    out = np.empty((n, 12), np.float32)
    for at in range(0, n, _FRAMES_AT_ONCE):
        spectrum = np.fft.rfft(windows[at : at + _FRAMES_AT_ONCE] * taper, axis=1)
        out[at : at + _FRAMES_AT_ONCE] = (spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ _fold()
    norm = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 1e-6)


def packed(frames: np.ndarray) -> np.ndarray:
    """One 32-bit integer for each span of frames, from filters on the integral image."""
    wide = np.concatenate([frames, frames[:, :11]], axis=1)  # pitch classes go round
    image = np.zeros((len(wide) + 1, wide.shape[1] + 1))
    image[1:, 1:] = wide.cumsum(axis=0, dtype=np.float64).cumsum(axis=1)
    n = len(frames) - SPAN + 1
    at = np.arange(n)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return image[at + t1, p1] - image[at + t0, p1] - image[at + t1, p0] + image[at + t0, p0]

    out = np.zeros(n, np.uint32)
    for kind, p, height, width in FILTERS:
        t0 = (SPAN - width) // 2
        if kind == "time":
            a, b = area(t0, t0 + width // 2, p, p + height), area(t0 + width // 2, t0 + width, p, p + height)
        else:
            half = (height + 1) // 2
            a, b = area(t0, t0 + width, p, p + half), area(t0, t0 + width, p + half, p + half + height // 2)
        level = np.searchsorted(_QUANTA, np.log1p(a) - np.log1p(b), "right").astype(np.uint32)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1)))  # neighbouring levels differ in one bit
    return out


def fingerprint(media: bytes | None) -> np.ndarray:
    if not media:
        return np.empty(0, np.uint32)
    samples = np.frombuffer(media, np.uint8).astype(np.float32) / 128 - 1
    least = FRAME + (SPAN - 1) * HOP
    if len(samples) < least:
        samples = np.concatenate([samples, np.zeros(least - len(samples), np.float32)])
    return packed(chroma(samples))


def fingerprints(recordings: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """(rec_id, n_ints, digest, ints) of every row; ints as little-endian bytes."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                ints = [fingerprint(x.as_py()).astype("<u4").tobytes() for x in batch.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(x) // 4 for x in ints], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ints]), pa.array(ints, pa.binary())], ["rec_id", "n_ints", "digest", "ints"]
                )

    share_code(recordings.sparkSession)
    kind = recordings.schema[id_col].dataType.simpleString()
    return recordings.select(id_col, media_col).mapInArrow(run, f"rec_id {kind}, n_ints long, digest string, ints binary")


def _picked(ints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, key) by winnowing: the smallest hash of every WINNOW neighbouring keys."""
    wide = ints.astype(np.uint64)
    pairs = (wide[:-1] << np.uint64(32)) | wide[1:] if len(wide) > 1 else wide
    h = pairs * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    if len(h) > WINNOW:
        at = np.unique(np.lib.stride_tricks.sliding_window_view(h, WINNOW).argmin(axis=1) + np.arange(len(h) - WINNOW + 1))
    else:
        at = np.unique(h.argmin(keepdims=True)) if len(h) else np.empty(0, np.int64)
    once = np.unique(h[at], return_index=True)[1]  # a key repeated in one recording counts where it is first
    return at[once], h[at[once]]


def _keys(classes: DataFrame) -> DataFrame:
    """(node, key, place) of all picked keys of the classes."""

    def run(batches):
        for batch in batches:
            owner, keys, places = [], [], []
            for k in range(batch.num_rows):
                at, key = _picked(np.frombuffer(batch.column(1)[k].as_py(), "<u4"))
                owner.append(np.full(len(at), k))
                keys.append(key)
                places.append(at)
            take = pa.array(np.concatenate(owner))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(places).astype(np.int32))], ["node", "key", "place"])

    return classes.select("node", "ints").mapInArrow(run, "node long, key long, place int")


def bit_error(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[float, int]:
    """Share of differing bits where b[k] lies under a[k + offset], and the overlap."""
    s, t = max(0, offset), max(0, -offset)
    n = min(len(a) - s, len(b) - t)
    if n <= 0:
        return 1.0, 0
    return float(np.bitwise_count(a[s : s + n] ^ b[t : t + n]).sum()) / (32 * n), n


# --- pairs of classes -------------------------------------------------------


def _holders(shared: DataFrame, bodies: DataFrame, block: int) -> DataFrame:
    """A row for each key of a class that can be the first one of a pair, and for each pair of the key's blocks that the class is in."""
    lists = shared.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "key", "place"))).alias("s")).where(F.size("s") >= MIN_VOTES)
    lists = lists.join(bodies.select("node", "class_id"), "node")
    # A pair has MIN_VOTES keys or more, so the first of them is never among a class's last ones.
    firsts = lists.select("node", "class_id", F.col("s.key").alias("keys"), F.col("s.place").alias("places"), F.posexplode(F.slice("s", 1, F.size("s") - (MIN_VOTES - 1))).alias("pos", "own"))
    return dealt(firsts.select("node", "class_id", "pos", "keys", "places", F.col("own.key").alias("key"), F.col("own.n").alias("n")), block)


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP, F.col("class_id").asc_nulls_last(), "node")


def _candidates(rows: pa.Table, group: np.ndarray):
    """(later, earlier, offset, votes) of the pairs of rows that belong to their group, a part at a time; a pair is in one part."""
    lists = rows["keys"].combine_chunks(), rows["places"].combine_chunks()
    lens = lists[0].value_lengths().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lens)), lens)
    key, place = (x.flatten().to_numpy() for x in lists)
    before = np.arange(len(row)) - np.repeat(np.cumsum(lens) - lens, lens) < rows["pos"].to_numpy()[row]
    order = np.lexsort((row, key, group[row]))
    row, key, place, before = row[order], key[order], place[order].astype(np.int64), before[order]
    runs = starts(key, group[row])
    sizes = np.diff(np.append(runs, len(row)))
    after = np.repeat(runs + sizes, sizes) - np.arange(len(row)) - 1  # holders of the same key that follow
    lefts = np.flatnonzero(after)
    lefts = lefts[np.argsort(row[lefts], kind="stable")]
    mine, lo, hi = (rows[c].to_numpy() for c in ("mine", "lo", "hi"))
    ends = np.append(starts(row[lefts])[1:], len(lefts)) if len(lefts) else lefts  # a row's keys stay together
    work = np.append(0, np.cumsum(after[lefts]))
    at = 0
    while at < len(lefts):
        to = int(ends[max(np.searchsorted(work[ends], work[at] + _PAIRS_AT_ONCE, "right") - 1, np.searchsorted(ends, at, "right"))])
        part, at = lefts[at:to], to
        n = after[part]
        one = np.repeat(part, n)
        other = one + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        # A pair of one block belongs to the group of that block alone.
        here = (lo[row[one]] == hi[row[one]]) | (mine[row[one]] != mine[row[other]])
        one, other = one[here], other[here]
        if not len(one):
            continue
        pair, offset = row[one] * len(lens) + row[other], place[other] - place[one]
        order = np.lexsort((offset, pair))
        pair, offset, early = pair[order], offset[order], before[one][order]
        runs = starts(pair, offset)
        votes = np.diff(np.append(runs, len(pair)))
        pairs = starts(pair)
        elsewhere = np.repeat(np.logical_or.reduceat(early, pairs), np.diff(np.append(pairs, len(pair))))
        runs, votes = runs[(votes >= MIN_VOTES) & ~elsewhere[runs]], votes[(votes >= MIN_VOTES) & ~elsewhere[runs]]
        if len(runs):
            yield pair[runs] % len(lens), pair[runs] // len(lens), offset[runs], votes


def _with_candidates(batches):
    """The rows that have a candidate in their group."""
    for rows, group in whole_groups(batches):
        found = np.zeros(len(group), bool)
        for later, earlier, _, _ in _candidates(rows, group):
            found[later] = found[earlier] = True
        yield from rows.filter(pa.array(found)).to_batches(max_chunksize=1024)


def bit_errors(flat: np.ndarray, start: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``bit_error`` of many pairs of the bodies that ``flat`` holds."""
    s, t = np.maximum(0, offset), np.maximum(0, -offset)
    n = np.minimum(size[a] - s, size[b] - t)
    s, t, differing = s + start[a], t + start[b], np.empty(len(n), np.int64)
    done = np.append(0, np.cumsum(n))  # the overlaps hold the common keys, so none is empty
    at = 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(done, done[at] + _PAIRS_AT_ONCE, "right")) - 1)
        step = np.arange(done[to] - done[at]) - np.repeat(done[at:to] - done[at], n[at:to])
        bits = np.bitwise_count(flat[np.repeat(s[at:to], n[at:to]) + step] ^ flat[np.repeat(t[at:to], n[at:to]) + step])
        differing[at:to] = np.add.reduceat(bits, done[at:to] - done[at], dtype=np.int64)
        at = to
    return differing / (32 * n), n


def _linked(batches):
    """(node, links, to, offset, votes, error): how many links a row has in its group, and the best to an earlier one."""
    for rows, group in whole_groups(batches):
        bodies = rows["ints"].to_pylist()
        flat, size = np.frombuffer(b"".join(bodies), "<u4"), np.array([len(x) // 4 for x in bodies])
        start = np.cumsum(size) - size
        name = rows["class_id"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        n = len(group)
        links, to, at, most, error = (np.zeros(n, np.int64), np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n))
        for later, earlier, offset, votes in _candidates(rows, group):
            wrong, overlap = bit_errors(flat, start, size, later, earlier, offset)
            good = np.flatnonzero((wrong <= MAX_BIT_ERROR) & (overlap >= MIN_OVERLAP))
            # A pair's best offset, then a row's best pair.
            good = good[np.lexsort((offset[good], np.abs(offset[good]), -votes[good], earlier[good], later[good]))]
            if not len(good):
                continue
            good = good[starts(later[good], earlier[good])]
            links += np.bincount(later[good], minlength=n) + np.bincount(earlier[good], minlength=n)
            good = good[name[later[good]] != name[earlier[good]]]
            good = good[np.lexsort((earlier[good], -votes[good], later[good]))]
            if not len(good):
                continue
            good = good[starts(later[good])]
            good = good[votes[good] > most[later[good]]]  # of equals, earlier parts have the smaller ids
            x = later[good]
            to[x], at[x], most[x], error[x] = earlier[good], offset[good], votes[good], wrong[good]
        some, none = np.flatnonzero(links), to[links > 0] < 0
        best = rows["class_id"].combine_chunks().take(pa.array(to[some], mask=none))
        rest = [pa.array(x[some].astype(kind), mask=none) for x, kind in ((at, np.int32), (most, np.int64), (error, np.float64))]
        yield pa.RecordBatch.from_arrays([rows["node"].combine_chunks().take(pa.array(some)), pa.array(links[some]), best, *rest], ["node", "links", "to", "offset", "votes", "error"])


def linked(bodies: DataFrame, block: int = BLOCK) -> DataFrame:
    """(digest, n_links, b) of the classes of ``bodies`` (node, digest, class_id, ints) that have links."""
    kind = bodies.schema["class_id"].dataType.simpleString()
    keys = settle(_keys(bodies), "chroma-keys")
    several = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    holders = settle(_holders(keys.join(several, "key"), bodies, block), "chroma-holders")
    layout = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in holders.schema)
    found = settle(_grouped(holders).mapInArrow(_with_candidates, layout), "chroma-candidates")
    pairs = _grouped(found.join(bodies.select("node", "ints"), "node").select(*holders.columns, "ints"))
    parts = settle(pairs.mapInArrow(_linked, f"node long, links long, to {kind}, offset int, votes long, error double"), "chroma-links")
    order = F.when(F.col("votes").isNotNull(), F.struct(-F.col("votes"), "to"))
    best = parts.groupBy("node").agg(F.sum("links").alias("n_links"), F.min_by(F.struct("to", "offset", "votes", "error"), order).alias("b"))
    return best.join(bodies.select("node", "digest"), "node").select("digest", "n_links", "b")


def align(recordings: DataFrame, id_col: str, media_col: str, block: int = BLOCK) -> DataFrame:
    """(rec_id, n_ints, fingerprint_sha256, class_id, aligned_to, offset, votes, bit_error, n_links) of every row."""
    prints = settle(fingerprints(recordings, id_col, media_col), "chroma-prints")
    # One row a class: equal fingerprints of one id are one row too. Written once, so a node keeps its number.
    bodies = prints.where("n_ints > 0").groupBy("digest").agg(F.min("rec_id").alias("class_id"), F.first("ints").alias("ints"))
    bodies = settle(bodies.withColumn("node", F.monotonically_increasing_id()), "chroma-bodies")
    classes = settle(bodies.select("digest", "class_id").join(linked(bodies, block), "digest", "left"), "chroma-classes")
    rows = prints.select("rec_id", "n_ints", "digest").join(classes, "digest", "left")
    class_id = F.when(F.col("n_ints") > 0, F.col("class_id")).otherwise(F.col("rec_id"))
    return rows.select(
        "rec_id", "n_ints", F.col("digest").alias("fingerprint_sha256"), class_id.alias("class_id"), F.col("b.to").alias("aligned_to"),
        "b.offset", "b.votes", F.col("b.error").alias("bit_error"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
    )
