"""Near-duplicates at a set similarity of word shingles, by SimHash majorities and Golay keys.

A document's set of word shingles votes on each of 448 bits: the bit is 1 where
more shingles have it than not. Two sets of Jaccard similarity 0.8 differ in 15 %
of such bits, too many to be decoded from the bits alone. So the segments of 23
votes are decoded *softly*: to the codeword of the Golay code that the votes, as
they were counted, speak for most. A vote that is nearly a tie, which is one that
an edit turns over, then hardly counts. At similarity 0.8 two segments have the
same codeword with probability 0.26 (0.12 when their bits are decoded).

A key is a set of ``together`` of the ``SEGMENTS`` codeword indices, 12 bits each:
documents meet where any two of eighteen segments agree, which two sets of
similarity 0.8 do with probability 0.97. Two at a time make 24-bit keys, for up to
some 1e9 different documents; beyond that, three at a time keep keys selective.

Within a key only a spanning forest leaves the task, of the pairs whose majorities
differ in few enough bits, with the most similar pairs first. A key with more
members than ``block`` is cut into blocks whose pairs are dealt to other tasks,
before it is shuffled where a sample shows it, so no task holds an unbounded group. The forests' distinct edges are candidates; each
is verified by the exact Jaccard similarity of the two sets of shingle hashes (64
bits), and components are made of verified links only.

A forest holds together only where all of its edges pass. So where a rejected edge
leaves two components apart, all pairs of the members of such components that meet in
a key, differ in few enough bits and are not yet together are verified as well, each
in the first key that both have. Every pair that meets and has the similarity is
then in one component; what that costs grows with the pairs that are near and fail.

Which pairs meet is a matter of probability, which are linked is not. Documents
with the same set of shingles are one node, known by a 128-bit digest of the set.
Texts without words (nulls, too) have the empty set and are copies of each other;
a text of fewer words than a shingle is one shingle. Ties among votes are
decoded alike for equal sets. Repeated rows of one doc_id stay or go together,
each linked by its own text. A row with a null doc_id names no component and is
never dropped; it has the component of the rows of equal shingles, if any. An
empty table gives an empty table. Other columns are not read. Long texts are held
one at a time.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import connected_components
from millrace.llm.golay_dedup import golay, one_in, split_hot
from millrace.llm.key_groups import GROUP, dealt, starts, whole_groups
from millrace.session import forget, settle, share_code

SEGMENTS = 18
TOGETHER = 2
WORDS = 7  # of 64 bits; the segments lie in the first bits
CHECK = 6  # of them, the last, go with the keys
SIMILARITY = 0.8
#: How many standard deviations a candidate pair may differ by more than pairs of the similarity do.
SPREAD = 2.3
BLOCK = 1 << 16
REST_BLOCK = 512  # where sets come along
_SMALL_RUN = 64
_PAIRS_AT_ONCE = 1 << 20
_REST_PAIRS_AT_ONCE = 1 << 16
_TEXTS_AT_ONCE = 64
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x + _K1
    x ^= x >> np.uint64(30)
    x *= _K2
    x ^= x >> np.uint64(27)
    x *= _K3
    x ^= x >> np.uint64(31)
    return x


_SALTS = _mix(np.arange(1, WORDS + 1, dtype=np.uint64) * _K3)


def most_differing(similarity: float = SIMILARITY, spread: float = SPREAD) -> int:
    """Bits in which a candidate pair may differ: sets of equal size have the cosine 2J / (1 + J)."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(64 * CHECK * (p + spread * np.sqrt(p * (1 - p) / (64 * CHECK))))


# --- sets and fingerprints --------------------------------------------------


def shingles(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of the ASCII-lower-cased text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(shingle, len(each))
    n = len(each) - size + 1
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total = (total * _K3 ^ each[k : k + n]) * _K2
        total ^= total >> np.uint64(32)
    return np.unique(_mix(total))


def votes(hashes: np.ndarray) -> np.ndarray:
    """For each bit, how many more hashes have it than not."""
    ones = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(hashes), 255):
        bits = np.unpackbits(_mix(hashes[at : at + 255, None] ^ _SALTS).view(np.uint8), axis=1)
        ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return 2 * ones - len(hashes)


def _signs() -> np.ndarray:
    """(23, 2048): +1 and -1 for the bits of the codewords of the lower half of the messages; the others are their complements."""
    message = np.arange(1 << 11)
    word = (message << 11) | golay().parity[message]
    return (2 * (word >> np.arange(23)[:, None] & 1) - 1).astype(np.float32)


_table: np.ndarray | None = None


def codewords(counted: np.ndarray) -> np.ndarray:
    """(texts, SEGMENTS) indices of the codewords that the votes of the segments speak for most."""
    global _table
    if _table is None:
        _table = _signs()
    parts = counted[:, : 23 * SEGMENTS].reshape(-1, 23).astype(np.float32)
    out = np.empty(len(parts), np.int64)
    for at in range(0, len(parts), 1024):
        match = parts[at : at + 1024] @ _table
        best = np.abs(match).argmax(axis=1)
        out[at : at + 1024] = np.where(match[np.arange(len(best)), best] >= 0, best, 4095 - best)
    return out.reshape(len(counted), SEGMENTS)


def with_fingerprints(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, fp, codes) for every row: digest of the set, packed majorities, packed codeword indices."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, _TEXTS_AT_ONCE):
                batch = whole.slice(at, _TEXTS_AT_ONCE)
                digests, counted = [], np.empty((batch.num_rows, 64 * WORDS), np.int64)
                for k in range(batch.num_rows):
                    hashes = shingles(batch.column(1)[k].as_py(), shingle)
                    digests.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
                    counted[k] = votes(hashes)
                fps = [x.tobytes() for x in np.packbits(counted > 0, axis=1)]
                codes = [x.tobytes() for x in codewords(counted).astype("<i2")]
                columns = [batch.column(0), pa.array(digests, pa.binary()), pa.array(fps, pa.binary()), pa.array(codes, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "fp", "codes"])

    share_code(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, digest binary, fp binary, codes binary")


# --- keys -------------------------------------------------------------------

_COLUMNS = ["key", "node", *[f"c{k}" for k in range(CHECK)]]


def keys_of(codes: np.ndarray, together: int = TOGETHER) -> np.ndarray:
    """(nodes, keys): a key for each choice of ``together`` segments."""
    out = []
    for k, chosen in enumerate(combinations(range(SEGMENTS), together)):
        key = np.full(len(codes), k, np.int64)
        for segment in chosen:
            key = key << 12 | codes[:, segment]
        out.append(key)
    return np.stack(out, axis=1)


def _keyed(nodes: DataFrame, together: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                node = batch.column(0).slice(at, 256).to_numpy()
                fp = np.frombuffer(b"".join(batch.column(1).slice(at, 256).to_pylist()), np.int64).reshape(len(node), WORDS)[:, WORDS - CHECK :]
                codes = np.frombuffer(b"".join(batch.column(2).slice(at, 256).to_pylist()), "<i2").reshape(len(node), SEGMENTS).astype(np.int64)
                keys = keys_of(codes, together)
                n = keys.shape[1]
                columns = [keys.reshape(-1), np.repeat(node, n), *(np.repeat(c, n) for c in fp.T)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], _COLUMNS)

    return nodes.select("node", "fp", "codes").mapInArrow(run, ", ".join(f"{c} long" for c in _COLUMNS))


# --- forests within keys ----------------------------------------------------


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(axis=-1, dtype=np.int64)


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the components of each a and b are joined; a label is the smallest of its component."""
    root, x, y = np.arange(len(label)), label[a], label[b]
    while (root[x] != root[y]).any():
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while (root != root[root]).any():
            root = root[root]
    return root[label]


def spanning(n: int, a: np.ndarray, b: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Places of the edges (a, b) that make a minimum spanning forest of ``n`` nodes; of equal distances the first edge is taken."""
    label, chosen = np.arange(n), []
    rank = np.empty(len(a), np.int64)
    rank[np.argsort(far, kind="stable")] = np.arange(len(a))
    edge = np.argsort(rank)
    left = np.arange(len(a))
    while True:
        left = left[label[a[left]] != label[b[left]]]
        if not len(left):
            return np.concatenate(chosen) if chosen else left
        best = np.full(n, len(a))
        np.minimum.at(best, label[a[left]], rank[left])
        np.minimum.at(best, label[b[left]], rank[left])
        picked = edge[np.unique(best[best < len(a)])]
        chosen.append(picked)
        label = _merged(label, a[picked], b[picked])


def _spread(check: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, label): a breadth-first forest over pairs that differ in ``most`` bits at most; each row is a source once."""
    left, a, b, label = np.arange(len(check)), [], [], np.arange(len(check))
    while len(left):
        root, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = _differing(check[left], check[at]) <= most
            got = left[hit]
            a.append(np.full(len(got), at))
            b.append(got)
            label[got] = root
            queue.extend(got.tolist())
            left = left[~hit]
    return np.concatenate(a) if a else left, np.concatenate(b) if b else left, label


def _large(check: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of one large key: rows that are surely similar by breadth first, then their groups by the nearest pairs."""
    a, b, label = _spread(check, most * 3 // 5)
    live = set(np.unique(label).tolist())
    while len(live) > 1:
        sizes = np.bincount(label, minlength=len(check))
        wait = int(sizes.argmax())  # the others look for it
        best: dict[int, tuple] = {}
        for at in np.flatnonzero(np.isin(label, list(live - {wait}))).tolist():
            far = _differing(check, check[at])
            far[label == label[at]] = 1 << 30
            to = int(far.argmin())
            if far[to] <= most:
                best[label[at]] = min(best.get(label[at], (1 << 30,)), (int(far[to]), min(at, to), max(at, to)))
        if not best:
            break
        found = np.array(sorted(set(best.values())), np.int64)
        found = found[spanning(len(check), label[found[:, 1]], label[found[:, 2]], found[:, 0])]
        a, b = np.concatenate([a, found[:, 1]]), np.concatenate([b, found[:, 2]])
        gone = live - set(best) - {wait}  # without a partner now, without one later
        label = _merged(label, found[:, 1], found[:, 2])
        live = set(np.unique(label).tolist()) - gone
    return a, b


def links(rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(smaller node, larger node) of the forests of rows (key, node, fingerprint words) sorted by key."""
    keys, node, check = rows[:, 0], rows[:, 1], np.ascontiguousarray(rows[:, 2:])
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    a, b = [], []
    for run in np.flatnonzero(sizes > _SMALL_RUN):
        s = starts[run]
        p, q = _large(check[s : s + sizes[run]], most)
        a.append(p + s)
        b.append(q + s)
    after = np.repeat(starts + sizes, sizes) - np.arange(len(keys)) - 1  # rows of the same key that follow
    lefts = np.flatnonzero((after > 0) & (np.repeat(sizes, sizes) <= _SMALL_RUN))
    work = np.cumsum(after[lefts])
    cuts = np.searchsorted(work, np.arange(_PAIRS_AT_ONCE, work[-1] if len(work) else 0, _PAIRS_AT_ONCE))
    ones, others, fars = [], [], []
    for part in np.split(lefts, cuts):
        n = after[part]
        one = np.repeat(part, n)
        other = one + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        far = _differing(check[one], check[other])
        hit = far <= most
        ones.append(one[hit])
        others.append(other[hit])
        fars.append(far[hit])
    one, other, far = np.concatenate(ones), np.concatenate(others), np.concatenate(fars)
    if len(one):
        there, place = np.unique(np.concatenate([one, other]), return_inverse=True)
        kept = spanning(len(there), place[: len(one)], place[len(one) :], far)
        a.append(one[kept])
        b.append(other[kept])
    x, y = (node[np.concatenate(p)] for p in (a, b)) if a else (node[:0], node[:0])
    return np.minimum(x, y), np.maximum(x, y)


def _pieces(batches, block: int):
    """(rows, None) of whole keys, and (rows, number) for the blocks of a key that has more than ``block`` rows."""
    held, large, number = np.empty((0, len(_COLUMNS)), np.int64), None, 0
    for batch in batches:
        held = np.concatenate([held, np.column_stack([c.to_numpy() for c in batch.columns[: len(_COLUMNS)]])])
        if not len(held):
            continue
        if large is not None:
            end = int(np.searchsorted(held[:, 0], large, "right"))
            if end < len(held):
                for k, at in enumerate(range(0, end, block)):  # the end of a key may be more than one block
                    yield held[at : min(at + block, end)], number + k
                held, large = held[end:], None
        if large is None:
            cut = int(np.searchsorted(held[:, 0], held[-1, 0]))
            if cut:
                yield held[:cut], None
                held = held[cut:]
        while len(held) > block:
            number = 0 if large is None else number
            large = held[0, 0]
            yield held[:block], number
            held, number = held[block:], number + 1
    if len(held):
        yield held, None if large is None else number


_LINK_SCHEMA = "a long, b long, block int, " + ", ".join(f"{c} long" for c in _COLUMNS)


def _linked(batches, most: int, block: int):
    """Forest edges (a, b); rows of an over-large key also pass through with their block, for the second round."""
    for rows, number in _pieces(batches, block):
        a, b = links(rows, most)
        nothing = pa.nulls(len(a), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int32()), *[nothing] * len(_COLUMNS)], ["a", "b", "block", *_COLUMNS])
        if number is not None:
            nothing = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([nothing, nothing, pa.array(np.full(len(rows), number, np.int32)), *(pa.array(np.ascontiguousarray(c)) for c in rows.T)], ["a", "b", "block", *_COLUMNS])


def candidates(nodes: DataFrame, most: int, together: int = TOGETHER, block: int = BLOCK) -> DataFrame:
    """Distinct edges (a, b) of the forests of all keys of ``nodes`` (node, fp, codes)."""
    share_code(nodes.sparkSession)

    def linked(rows: DataFrame, block: int) -> DataFrame:
        return rows.sortWithinPartitions("key", "node").mapInArrow(lambda it: _linked(it, most, block), _LINK_SCHEMA)

    every = one_in(block)
    sample = _keyed(nodes.where(F.pmod(F.xxhash64("node"), F.lit(every)) == 0), together)
    keyed = split_hot(_keyed(nodes, together), sample, every, block, "node", "wide-hot")
    found = settle(linked(keyed.repartition("key"), block), "wide-links")
    edges = found.where("a is not null").select("a", "b")
    over = found.where("a is null").drop("a", "b")
    if not over.isEmpty():
        blocks = over.groupBy("key").agg((F.max("block") + 1).alias("blocks"))
        paired = over.join(blocks, "key").withColumn("other", F.explode(F.expr("filter(sequence(0, blocks - 1), x -> x != block)")))
        paired = paired.withColumn("key", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))).select(*_COLUMNS)
        edges = edges.unionByName(linked(paired.repartition("key"), 2 * block + 1).where("a is not null").select("a", "b"))
    return edges.distinct()


# --- exact similarity -------------------------------------------------------


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(node, hashes) of the nodes of ``wanted`` (node, first, digest), from the texts of their first documents."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("first"), F.col(text_col).alias("text")).join(wanted, "first")

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, _TEXTS_AT_ONCE):
                batch = whole.slice(at, _TEXTS_AT_ONCE)
                found = [shingles(x.as_py(), shingle).view(np.int64) for x in batch.column(2)]
                # Rows that repeat an id may have other texts.
                own = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() == d.as_py() for x, d in zip(found, batch.column(3))]
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([x if ok else None for x, ok in zip(found, own)], pa.list_(pa.int64()))], ["node", "hashes"])

    got = texts.select("first", "node", "text", "digest").mapInArrow(run, "node long, hashes array<long>")
    return settle(got.where("hashes is not null").dropDuplicates(["node"]), "wide-sets")


def verified(edges: DataFrame, docs: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows of ``edges`` whose sets have at least the Jaccard similarity, by their exact intersection; and the sets of all ends."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = _sets(docs, nodes.join(ends, "node").select("node", "first", "digest"), shingle, id_col, text_col)
    both = edges.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return settle(both.where(common >= F.lit(similarity) * (F.size("x") + F.size("y") - common)).select("a", "b"), "wide-verified"), sets


# --- pairs whose forests fell apart -----------------------------------------


def _crossing(rows: pa.Table, group: np.ndarray, most: int, together: int):
    """(one, other) rows of different labels that meet in a key and are near, the nearest first, a part at a time."""
    label, mine, lo, hi = (rows[c].to_numpy() for c in ("label", "mine", "lo", "hi"))
    check = np.frombuffer(b"".join(rows["fp"].to_pylist()), np.int64).reshape(len(label), WORDS)[:, WORDS - CHECK :]
    codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), "<i2").reshape(len(label), SEGMENTS)
    runs, groups = starts(group, label), starts(group)
    run_end = np.repeat(np.append(runs[1:], len(label)), np.diff(np.append(runs, len(label))))
    after = np.append(groups[1:], len(label))[group - group[0]] - run_end
    work = np.append(0, np.cumsum(after))
    at = 0
    while at < len(label):
        to = max(at + 1, int(np.searchsorted(work, work[at] + _REST_PAIRS_AT_ONCE, "right")) - 1)
        n = after[at:to]
        one = np.repeat(np.arange(at, to), n)
        other = run_end[one] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = to
        far = _differing(check[one], check[other])
        # A pair of one block belongs to the group of that block alone.
        here = np.flatnonzero((far <= most) & ((lo[one] == hi[one]) | (mine[one] != mine[other])))
        here = here[np.argsort(far[here], kind="stable")]
        one, other = one[here], other[here]
        meet = (codes[one] == codes[other]).sum(axis=1) >= together
        if meet.any():
            yield one[meet], other[meet]


def _with_crossing(batches, most: int, together: int):
    """The rows that have a pair in their group."""
    for rows, group in whole_groups(batches):
        found = np.zeros(len(group), bool)
        for one, other in _crossing(rows, group, most, together):
            found[one] = found[other] = True
        yield from rows.filter(pa.array(found)).to_batches(max_chunksize=256)


def _joined(batches, most: int, together: int, similarity: float):
    """(a, b): labels that a pair of the similarity holds together."""
    for rows, group in whole_groups(batches):
        label, hashes = rows["label"].to_numpy(), rows["hashes"].combine_chunks()
        ends = np.append(0, np.cumsum(hashes.value_lengths().to_numpy(zero_copy_only=False)))
        hashes = hashes.flatten().to_numpy()
        sets = [hashes[a:b] for a, b in zip(ends[:-1], ends[1:])]
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = x = root.get(up, up)
            return x

        links = []
        for parts in _crossing(rows, group, most, together):
            for one, other in zip(*(x.tolist() for x in parts)):
                x, y, p, q = sets[one], sets[other], top(label[one].item()), top(label[other].item())
                if p == q or min(len(x), len(y)) < similarity * max(len(x), len(y)):
                    continue
                common = len(np.intersect1d(x, y, assume_unique=True))
                if common >= similarity * (len(x) + len(y) - common):
                    root[max(p, q)] = min(p, q)
                    links.append((label[one], label[other]))
        links = np.array(links, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in links.T], ["a", "b"])


def rest(edges: DataFrame, good: DataFrame, labelled: DataFrame, sets: DataFrame, similarity: float, together: int, block: int) -> DataFrame | None:
    """(a, b) labels that belong together though the forests' edges between them were rejected; None where no rejected edge leaves two labels apart.

    ``labelled`` (node, label, fp, codes) are the nodes with the component that the ``good`` of ``edges`` give them.
    All nodes of a family are ends of edges, so ``sets`` has them.
    """
    label = labelled.select("node", "label")
    bad = edges.join(good, ["a", "b"], "left_anti")
    bad = bad.join(label.toDF("a", "p"), "a").join(label.toDF("b", "q"), "b").where("p != q")
    apart = settle(bad.select(F.col("p").alias("a"), F.col("q").alias("b")).distinct(), "wide-apart")
    if apart.isEmpty():
        return None
    nodes = settle(labelled.join(connected_components(apart).toDF("label", "key"), "label"), "wide-families")
    sizes = nodes.groupBy("key").agg(F.count("*").alias("n"))
    rows = dealt(nodes.select("key", "node", "label", "fp", "codes").join(sizes, "key"), min(block, REST_BLOCK))
    most = most_differing(similarity)

    def grouped(rows: DataFrame) -> DataFrame:
        return rows.repartition(*GROUP).sortWithinPartitions(*GROUP, "label", "node")

    layout = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    found = settle(grouped(rows).mapInArrow(lambda it: _with_crossing(it, most, together), layout), "wide-rest-found")
    joined = grouped(found.join(sets, "node")).mapInArrow(lambda it: _joined(it, most, together, similarity), "a long, b long")
    out = settle(joined.distinct(), "wide-rest-links")
    forget(apart, nodes, found)
    return out


# --- the operator -----------------------------------------------------------


def near_duplicates(
    docs: DataFrame, shingle: int = 5, similarity: float = SIMILARITY, together: int = TOGETHER, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, component_id) of every row: component_id is the smallest doc_id reachable over verified links."""
    prints = settle(with_fingerprints(docs, shingle, id_col, text_col), "wide-fingerprints")
    nodes = prints.where("doc_id is not null").groupBy("digest", "fp", "codes").agg(F.min("doc_id").alias("first"))
    nodes = settle(nodes.withColumn("node", F.monotonically_increasing_id()), "wide-nodes")  # written once, so a node keeps its number
    edges = settle(candidates(nodes, most_differing(similarity), together, block), "wide-candidates")
    good, sets = verified(edges, docs, nodes, similarity, shingle, id_col, text_col)
    labelled = nodes.join(connected_components(good), "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    labelled = settle(labelled, "wide-labelled")
    more = rest(edges, good, labelled, sets, similarity, together, block)
    rooted = labelled.select("digest", "first", F.col("label").alias("root"))
    if more is not None:
        roots = connected_components(more).toDF("label", "component")
        rooted = labelled.join(roots, "label", "left").select("digest", "first", F.coalesce("component", "label").alias("root"))
    rooted = settle(rooted, "wide-roots")
    named = settle(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "wide-components")
    named = settle(rooted.join(named, "root").select("digest", "component_id"), "wide-named")
    return prints.select("doc_id", "digest").join(named, "digest", "left").select("doc_id", "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those whose component has a smaller doc_id; all columns stay."""
    found = near_duplicates(docs, shingle, similarity, id_col=id_col, text_col=text_col)
    drop = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__drop")).distinct()
    return docs.join(drop, docs[id_col] == drop["__drop"], "left_anti")
