"""SimHash near-duplicates found through Golay-code fuzzy hashing.

A document's 64-bit fingerprint is cut into three segments (22, 21 and 21 bits,
zero-padded to the 23 bits of the binary Golay code). Two fingerprints that
differ in at most four bits fall in one of two cases:

* some segment is equal: the segment itself is a key (three keys);
* no segment is equal: every segment has at least one error, so at least two of
  the three have exactly one. The perfect Golay code puts every word within
  three bits of exactly one codeword c(u); a word one bit away is within four
  bits of c(u). So c(u) is among the codewords within four bits of v - one
  codeword when v is at most two bits from its own, six when it is three away.
  A key is a pair of such codeword indices, for each of the three segment pairs.

A pair is looked at only where one side's *nearest* codewords meet the other
side's list, which makes the 24-bit key as selective as exact matching. The
candidates are verified with the full fingerprints.

Distinct fingerprints are linked, not documents; a key's members arrive sorted
and are compared block by block in numpy, and only a spanning forest of the true
links leaves a task. A key with more members than ``block`` is cut into blocks
whose pairs are dealt to other tasks, before it is shuffled where a sample of the
members shows it, else where it arrives, so no task holds or compares an unbounded
group, and no pair is dropped.

Nulls and empty texts have no words and the fingerprint zero, which is linked
like any other. Rows that repeat a doc_id stay; a null doc_id never names a
component unless no other id is in it. Other columns are carried as they are not
read at all.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import connected_components
from millrace.session import settle, share_code

SEGMENTS = ((42, 22), (21, 21), (0, 21))  # (shift, width), from the high bits down
#: Generator polynomial of the binary Golay code [23, 12, 7]: x^11+x^9+x^7+x^6+x^5+x+1.
GOLAY_POLYNOMIAL = 0b101011100011
MAX_BITS = 4
BLOCK = 1 << 16
_PAIRS_AT_ONCE = 1 << 21
_SMALL_RUN = 64


# --- fingerprints -----------------------------------------------------------


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash over the word shingles of the ASCII-lower-cased text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    hashed = xxhash.xxh64_digest
    if len(words) <= shingle:
        return int.from_bytes(hashed(joined, seed), "big")
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps[shingle - 1 :].tolist(), len(joined)]
    ones = np.zeros(64, np.int64)
    total = len(ends)
    for at in range(0, total, 1 << 16):
        part = b"".join([hashed(joined[a:b], seed) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)])])
        bits = np.unpackbits(np.frombuffer(part, np.uint8)).reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def with_fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py(), shingle, seed) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    share_code(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, fp long")


# --- the code ---------------------------------------------------------------


class Golay:
    """Syndrome decoding of the [23, 12, 7] code, built from its generator polynomial."""

    def __init__(self) -> None:
        data = np.arange(1 << 12, dtype=np.int64)
        word = data << 11
        for bit in range(22, 10, -1):
            word = np.where(word >> bit & 1, word ^ (GOLAY_POLYNOMIAL << (bit - 11)), word)
        self.parity = word  # of each 12-bit message
        unit = np.array([self._syndrome_of(1 << k) for k in range(23)])
        self.leader = np.zeros(1 << 11, np.int64)  # error pattern of weight 3 at most
        self.others = np.full((1 << 11, 5), -1, np.int64)  # patterns of weight 4, where the leader has weight 3
        for weight in (1, 2, 3, 4):
            filled: dict[int, int] = {}
            for bits in combinations(range(23), weight):
                syndrome = int(np.bitwise_xor.reduce(unit[list(bits)]))
                pattern = sum(1 << b for b in bits)
                if weight < 4:
                    self.leader[syndrome] = pattern
                else:
                    self.others[syndrome, filled.setdefault(syndrome, 0)] = pattern
                    filled[syndrome] += 1

    def _syndrome_of(self, word):
        return self.parity[word >> 11] ^ (word & 0x7FF)

    def indices(self, words: np.ndarray) -> np.ndarray:
        """(n, 6): index of the nearest codeword, then those at distance four, -1 where there is none."""
        syndrome = self._syndrome_of(words)
        patterns = np.concatenate([self.leader[syndrome][:, None], self.others[syndrome]], axis=1)
        return np.where(patterns >= 0, (words[:, None] ^ patterns) >> 11, -1)


_golay: Golay | None = None


def golay() -> Golay:
    global _golay
    if _golay is None:
        _golay = Golay()
    return _golay


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row, nearest) of every key of every fingerprint."""
    fps = fps.view(np.uint64)
    rows = np.arange(len(fps))
    segments = [((fps >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
    keys, owners, nearest = [], [], []
    for k, segment in enumerate(segments):
        keys.append(segment | (k << 40))
        owners.append(rows)
        nearest.append(np.ones(len(fps), bool))
    near = [golay().indices(segment) for segment in segments]
    for k, (i, j) in enumerate(combinations(range(3), 2)):
        left, right = near[i][:, :, None], near[j][:, None, :]
        key = ((k + 3) << 40) | (left << 12) | right
        there = (left >= 0) & (right >= 0)
        row, a, b = np.nonzero(there)
        keys.append(key[there])
        owners.append(row)
        nearest.append((a == 0) & (b == 0))
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(nearest)


# --- links within keys ------------------------------------------------------


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node of its component) of the graph with edges a-b."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    away = label != np.arange(len(nodes))
    return nodes[away], nodes[label[away]]


def _spread(fps: np.ndarray, near: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of one large key, by breadth-first search; each member is a source once."""
    left = np.arange(len(fps))  # not yet reached
    a, b = [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = np.bitwise_count(fps[left] ^ fps[at]) <= max_bits
            if not near[at]:
                hit &= near[left]
            got = left[hit]
            if len(got):
                a.append(np.full(len(got), fps[at]))
                b.append(fps[got])
                queue.extend(got.tolist())
                left = left[~hit]
    return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


def links(keys: np.ndarray, fps: np.ndarray, near: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges of the true links among rows sorted by key."""
    if not len(keys):
        return fps[:0], fps[:0]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    a, b = [], []
    for run in np.flatnonzero(sizes > _SMALL_RUN):
        s, e = starts[run], starts[run] + sizes[run]
        p, q = _spread(fps[s:e], near[s:e], max_bits)
        a.append(p)
        b.append(q)
    size_of, start_of = np.repeat(sizes, sizes), np.repeat(starts, sizes)
    lefts = np.flatnonzero(near & (size_of > 1) & (size_of <= _SMALL_RUN))
    work = np.cumsum(size_of[lefts])
    cuts = np.searchsorted(work, np.arange(_PAIRS_AT_ONCE, (work[-1] if len(work) else 0) + _PAIRS_AT_ONCE, _PAIRS_AT_ONCE))
    for at, to in zip([0, *cuts], [*cuts, len(lefts)]):
        part = lefts[at:to]
        if not len(part):
            continue
        n = size_of[part]
        one = np.repeat(part, n)
        other = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start_of[part], n)
        hit = (np.bitwise_count(fps[one] ^ fps[other]) <= max_bits) & (fps[one] != fps[other])
        a.append(fps[one[hit]])
        b.append(fps[other[hit]])
    if not a:
        return fps[:0], fps[:0]
    return forest(np.concatenate(a), np.concatenate(b))


_LINK_SCHEMA = "a long, b long, key long, block int, near boolean"


def _link_rows(batches, max_bits: int, block: int):
    """Sorted (key, fp, near) rows to star edges; blocks of over-large keys pass through for the second round."""

    def edges(keys, fps, near):
        a, b = links(keys, fps.view(np.uint64), near, max_bits)
        none = pa.nulls(len(a))
        return pa.RecordBatch.from_arrays(
            [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.bool_())], ["a", "b", "key", "block", "near"]
        )

    def over(key, fps, near, number):
        none = pa.nulls(len(fps)).cast(pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(fps), none, pa.array(np.full(len(fps), key)), pa.array(np.full(len(fps), number, np.int32)), pa.array(near)], ["a", "b", "key", "block", "near"]
        )

    held: list = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)]
    number, large = 0, None  # blocks so far of the key that goes on
    for batch in batches:
        new = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)]
        held = [np.concatenate([x, y]) for x, y in zip(held, new)]
        while len(held[0]):
            if large is not None and held[0][0] != large:
                number, large = 0, None
            last = held[0][-1]
            cut = int(np.searchsorted(held[0], last))
            if large is not None:
                end = int(np.searchsorted(held[0], large, "right"))
                if end < block and end == len(held[0]):
                    break
                take = min(end, block)
                yield over(large, held[1][:take], held[2][:take], number)
                yield edges(*(x[:take] for x in held))
                held, number = [x[take:] for x in held], number + 1
            elif cut:
                yield edges(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
            elif len(held[0]) > block:
                large = last
            else:
                break
    if len(held[0]):
        if large is not None and held[0][0] == large:
            yield over(large, held[1], held[2], number)
        yield edges(*held)


def _keyed(fps: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            values = batch.column(0).to_numpy()
            for at in range(0, len(values), 4096):
                part = values[at : at + 4096]
                key, row, near = keys_of(part)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row]), pa.array(near)], ["key", "fp", "near"])

    return fps.select("fp").mapInArrow(run, "key long, fp long, near boolean")


def split_hot(rows: DataFrame, sample: DataFrame, every: int, block: int, member: str, name: str) -> DataFrame:
    """``rows`` (key, ...) with the keys that have more than about ``block`` members split before any task holds one.

    ``sample`` has the same columns for one in ``every`` members. The members of a
    key that it shows to be large are cut into blocks by a hash, and each goes to
    the keys of all pairs of its block with another, so that every two members
    still meet. A key that the sample misses is cut where it arrives.
    """
    n = F.count("*") * every
    hot = settle(sample.groupBy(F.col("key").alias("hot_key")).agg(n.alias("n")).where(F.col("n") > block), name)
    if hot.isEmpty():
        return rows
    hot = hot.select("hot_key", F.ceil(2 * F.col("n") / block).alias("blocks"))
    own = F.pmod(F.xxhash64(member, F.lit(7)), F.col("blocks"))
    pair = lambda o: F.xxhash64("key", F.least(own, o), F.greatest(own, o))
    keys = F.when(F.col("blocks").isNull(), F.array("key")).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), pair))
    return rows.join(hot, F.col("key") == F.col("hot_key"), "left").select(F.explode(keys).alias("key"), *[c for c in rows.columns if c != "key"])


def one_in(block: int) -> int:
    return max(1, min(64, block // 1024))


def link_fingerprints(fps: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect all fingerprints of ``fps`` (one distinct column fp) within max_bits.

    Every pair within ``max_bits`` (four at most) is connected by a path of edges,
    and every edge is such a pair or a shortcut between two connected ones.
    """
    if not 0 <= max_bits <= 4:
        raise ValueError("the keys are complete for at most four differing bits")
    share_code(fps.sparkSession)

    def linked(rows: DataFrame) -> DataFrame:
        return rows.sortWithinPartitions("key", "fp").mapInArrow(lambda it: _link_rows(it, max_bits, block), _LINK_SCHEMA)

    every = one_in(block)
    keyed = split_hot(_keyed(fps), _keyed(fps.where(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0)), every, block, "fp", "golay-hot")
    found = settle(linked(keyed.repartition("key")), "golay-links")
    edges = found.where("b is not null").select("a", "b")
    over = found.where("b is null")
    if not over.isEmpty():
        counts = over.groupBy("key").agg((F.max("block") + 1).alias("blocks"))
        paired = (
            over.join(counts, "key")
            .withColumn("other", F.explode(F.expr("filter(sequence(0, blocks - 1), x -> x != block)")))
            .select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"), F.col("a").alias("fp"), "near")
        )
        second = paired.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(lambda it: _link_rows(it, max_bits, 2 * block + 1), _LINK_SCHEMA)
        edges = edges.unionByName(second.where("b is not null").select("a", "b"))
    return edges


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = MAX_BITS, seed: int = 42, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links."""
    prints = settle(with_fingerprints(docs, shingle, seed, id_col, text_col), "golay-fingerprints")
    distinct = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "golay-distinct")
    edges = link_fingerprints(distinct, max_bits, block)
    members = connected_components(edges)  # node, component: only those with links
    firsts = distinct.join(members, distinct.fp == members.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    firsts = settle(firsts, "golay-roots")
    smallest = settle(firsts.groupBy("root").agg(F.min("first").alias("component_id")), "golay-components")
    named = settle(firsts.join(smallest, "root").select("fp", "component_id"), "golay-named")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those whose component has a smaller doc_id; all columns stay."""
    found = near_duplicates(docs, shingle, max_bits, id_col=id_col, text_col=text_col)
    drop = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__drop"))
    return docs.join(drop, docs[id_col] == drop["__drop"], "left_anti")
