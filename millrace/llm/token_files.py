"""Token-id files in patched frame-of-reference blocks.

A segment is a byte image: a header, the index of block starts, the blocks. Each
block of 256 ids stores its minimum, the residuals packed at a width that covers
a percentile of them, and for the others an exception list of positions and high
bits. ``read_block`` opens one block through the index without touching the rest.

Documents are dealt by ranges of their id and encoded in ascending order, so the
segments of a partition follow one another and those of the partitions too. The
segments are written as a Parquet table in the shared folder: its commit protocol
keeps exactly one copy of each segment when tasks are tried again, on any store
that Spark writes. A document may be of any length and is never cut.

Null texts are encoded as empty texts; every document ends with ``end_id``. Rows
that repeat an id follow one another, in the order of a hash of their texts; null
ids come first. An empty table gives no segments. Other columns are not
read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.id_ranges import dealt, partitions, ranges_of
from millrace.llm.word_batches import Memo, distinct_units, gather, slices
from millrace.session import scratch_path, share_code

BLOCK = 256
PERCENTILE = 95
SEGMENT_IDS = 1 << 19
MEMO_UNITS = 350_000  # in each of two generations
_TEXTS_AT_ONCE = 1 << 22  # bytes encoded at a time
_MAGIC = b"PFR1"
_HEAD = struct.Struct("<4sIII")  # magic, ids, blocks, block size
_BLOCK_HEAD = struct.Struct("<IBBH")  # minimum, width, 0, exceptions


# --- blocks -----------------------------------------------------------------


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(m, BLOCK) of ``width``-bit values to (m, BLOCK * width / 64) words."""
    if width in (8, 16, 32):  # little-endian integers are packed already
        return values.astype(f"<u{width // 8}").view("<u8")
    columns = np.ascontiguousarray(values.T).astype(np.uint64)
    out = np.zeros((BLOCK * width // 64, len(values)), np.uint64)
    for j in range(BLOCK):
        k, shift = divmod(j * width, 64)
        out[k] |= columns[j] << np.uint64(shift)
        if shift + width > 64:
            out[k + 1] |= columns[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.ascontiguousarray(words).view(f"<u{width // 8}").astype(np.uint64)
    columns = np.ascontiguousarray(words.T)
    mask = np.uint64((1 << width) - 1)
    out = np.zeros((BLOCK, len(words)), np.uint64)
    for j in range(BLOCK if width else 0):
        k, shift = divmod(j * width, 64)
        out[j] = columns[k] >> np.uint64(shift)
        if shift + width > 64:
            out[j] |= columns[k + 1] << np.uint64(64 - shift)
        out[j] &= mask
    return np.ascontiguousarray(out.T)


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value."""
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.int64)


def encode_segment(ids: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    ids = np.asarray(ids, np.uint32)
    blocks = -(-len(ids) // BLOCK)
    if not blocks:
        return _HEAD.pack(_MAGIC, 0, 0, BLOCK)
    grid = np.full(blocks * BLOCK, ids[-1], np.uint32)
    grid[: len(ids)] = ids
    grid = grid.reshape(blocks, BLOCK)
    low = grid.min(axis=1)
    rest = grid - low[:, None]
    at = min(BLOCK - 1, BLOCK * percentile // 100)
    width = _widths(np.partition(rest, at, axis=1)[:, at])
    parts: list[bytes] = [b""] * blocks
    for w in np.unique(width):
        chosen = np.flatnonzero(width == w)
        mine = rest[chosen]
        body = _pack(mine & np.uint32((1 << int(w)) - 1), int(w)).astype("<u8", copy=False) if w else None
        large = mine >> np.uint32(w) if w < 32 else np.zeros_like(mine)
        row, pos = np.nonzero(large)
        high = large.astype("<u4", copy=False)
        ends = np.searchsorted(row, np.arange(len(chosen) + 1))
        values = high[row, pos]
        for k, block in enumerate(chosen):
            a, b = ends[k], ends[k + 1]
            parts[block] = (
                _BLOCK_HEAD.pack(int(low[block]), int(w), 0, b - a) + (body[k].tobytes() if w else b"") + pos[a:b].astype(np.uint8).tobytes() + values[a:b].tobytes()
            )
    sizes = np.array([len(p) for p in parts], np.int64)
    index = (_HEAD.size + 4 * blocks + np.concatenate([[0], np.cumsum(sizes)[:-1]])).astype("<u4")
    return _HEAD.pack(_MAGIC, len(ids), blocks, BLOCK) + index.tobytes() + b"".join(parts)


def _head(data: bytes) -> tuple[int, int]:
    magic, n, blocks, size = _HEAD.unpack_from(data)
    if magic != _MAGIC or size != BLOCK:
        raise ValueError("not a segment of token ids")
    return n, blocks


def decode_segment(data: bytes) -> np.ndarray:
    n, blocks = _head(data)
    starts = np.frombuffer(data, "<u4", blocks, _HEAD.size).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)
    heads = raw[starts[:, None] + np.arange(8)].copy() if blocks else np.zeros((0, 8), np.uint8)
    low = heads[:, :4].copy().view("<u4").ravel()
    width, count = heads[:, 4].astype(np.int64), heads[:, 6:8].copy().view("<u2").ravel().astype(np.int64)
    out = np.zeros((blocks, BLOCK), np.uint64)
    for w in np.unique(width):
        chosen = np.flatnonzero(width == w)
        size = BLOCK // 8 * int(w)
        if w:
            body = b"".join([data[s : s + size] for s in (starts[chosen] + 8).tolist()])
            out[chosen] = _unpack(np.frombuffer(body, "<u8").reshape(len(chosen), -1), int(w))
        odd = chosen[count[chosen] > 0]
        if len(odd):
            spots = list(zip((starts[odd] + 8 + size).tolist(), count[odd].tolist()))
            pos = np.frombuffer(b"".join([data[at : at + k] for at, k in spots]), np.uint8)
            high = np.frombuffer(b"".join([data[at + k : at + 5 * k] for at, k in spots]), "<u4")
            out[np.repeat(odd, count[odd]), pos] |= high.astype(np.uint64) << np.uint64(w)
    return (out + low[:, None]).astype(np.uint32).ravel()[:n]


def read_block(data: bytes, block: int) -> np.ndarray:
    """The ids of one block, found through the index of block starts."""
    n, blocks = _head(data)
    if not 0 <= block < blocks:
        raise IndexError(block)
    start = int(np.frombuffer(data, "<u4", 1, _HEAD.size + 4 * block)[0])
    low, width, _, count = _BLOCK_HEAD.unpack_from(data, start)
    size = BLOCK // 8 * width
    got = _unpack(np.frombuffer(data, "<u8", size // 8, start + 8)[None], width)[0]
    at = start + 8 + size
    got[np.frombuffer(data, np.uint8, count, at)] |= np.frombuffer(data, "<u4", count, at + count).astype(np.uint64) << np.uint64(width)
    return (got + low).astype(np.uint32)[: min(BLOCK, n - block * BLOCK)]


# --- texts to ids -----------------------------------------------------------

#: Unicode White_Space, as the tokenizer's own pattern splits on it (fixed values).
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"


def _byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it prints, else the next free one."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class WordMemo:
    """The tokenizers library behind a memo by unit.

    A byte-level tokenizer cuts a text before it merges. Where letters, digits,
    other characters and white space meet it always cuts, but for a space before a
    word and an apostrophe before letters; so a unit between such places has the
    same ids alone and in its text, and each distinct unit goes to the library
    once: one of letters to the library's model, others to the whole tokenizer.
    Texts with a special token go to the library whole, texts with white space of
    other kinds or with letters not listed are cut at white space only.
    """

    def __init__(self, file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        self.model = self.library.model
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        kind = str(self.library.pre_tokenizer)
        self.by_word = self.library.normalizer is None and "ByteLevel(add_prefix_space=False" in kind and "use_regex=True" in kind
        self.cut = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]")
        self.unlisted = re.compile(f"[^\\x00-\\x7f{_LETTERS}]")
        self.letters = str.maketrans({chr(b): c for b, c in enumerate(_byte_letters())})
        self.by_chunk: dict[str, bytes] = {}
        self.memo = Memo(MEMO_UNITS)

    def chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of pieces of text cut as the tokenizer cuts them at white space."""
        memo = self.by_chunk
        new = [c for c in dict.fromkeys(chunks) if c not in memo]
        for c, e in zip(new, self.library.encode_batch_fast(new, add_special_tokens=False) if new else []):
            memo[c] = array("I", e.ids).tobytes()
        out = [memo[c] for c in chunks]
        if len(memo) > MEMO_UNITS // 4:
            memo.clear()
        for c in new:
            if len(c) > 200:
                memo.pop(c, None)
        return out

    def _single(self, x: str) -> bool:
        """No white space but single spaces and single line feeds between other characters, or at an end; listed letters only."""
        if "  " in x or "\n\n" in x or "\n " in x or " \n" in x or "\t" in x or "\r" in x or "\v" in x or "\f" in x:
            return False
        return x.isascii() or self.unlisted.search(x) is None

    def _learn(self, units: list[str]) -> list[bytes]:
        out, odd = [b""] * len(units), []
        tokenize, letters = self.model.tokenize, self.letters
        for k, x in enumerate(units):
            if x.lstrip(" ").isalpha():
                shown = x if x.isascii() else x.encode().decode("latin-1")
                out[k] = array("I", [t.id for t in tokenize(shown.translate(letters))]).tobytes()
            else:
                odd.append(k)
        for k, ids in zip(odd, self.chunks([units[k] for k in odd])):
            out[k] = ids
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out, plain = [b""] * len(texts), []
        for k, x in enumerate(texts):
            if not self.by_word or any(s in x for s in self.special):
                out[k] = array("I", self.library.encode(x, add_special_tokens=False).ids).tobytes()
            elif self._single(x):
                plain.append(k)
            else:
                out[k] = b"".join(self.chunks(self.cut.findall(x)))
        places, ends, units = distinct_units([texts[k].encode() for k in plain], b" '")
        for k, ids in zip(plain, gather(self.memo.table(units, self._learn), places, ends)):
            out[k] = ids.tobytes()
        return out


@cache
def word_memo(file: str) -> WordMemo:
    return WordMemo(file)


# --- files ------------------------------------------------------------------


def write_segments(docs: DataFrame, tokenizer_file: str, end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text", segment_ids: int = SEGMENT_IDS) -> None:
    """Write the ids of all documents in ascending order of their id to ``path``."""
    share_code(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    ranges = ranges_of(docs, id_col, partitions(docs))
    rows = dealt(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text", ranges)

    def run(batches):
        coder, part = word_memo(tokenizer_file), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        held_ids: list = []
        held: list[bytes] = []
        size = start = number = 0
        type_ = None

        def flush():
            counts = [len(x) // 4 for x in held]
            image = encode_segment(np.frombuffer(b"".join(held), "<u4"))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([start], pa.int64()), pa.array([held_ids], pa.list_(type_)), pa.array([counts], pa.list_(pa.int64())), pa.array([image], pa.binary())],
                ["part", "segment", "start", "doc_ids", "counts", "image"],
            )

        for batch in batches:
            type_ = batch.column(0).type
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for at, to in slices(sizes, _TEXTS_AT_ONCE):
                some = batch.slice(at, to - at)
                texts = [x or "" for x in some.column(1).to_pylist()]
                for doc, ids in zip(some.column(0).to_pylist(), coder.encode(texts)):
                    held_ids.append(doc)
                    held.append(ids + end)
                    size += len(ids) // 4 + 1
                    if size >= segment_ids:
                        yield flush()
                        start, number, size = start + size, number + 1, 0
                        held_ids, held = [], []
        if held:
            yield flush()

    rows.select("doc_id", "text").mapInArrow(run, f"part int, segment int, start long, doc_ids array<{kind}>, counts array<long>, image binary").write.parquet(path)


def read_segments(spark, path: str, kind: str = "bigint", keep: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document of the files."""
    segments = spark.read.parquet(path)
    # One row a partition: the ids in the partitions before it.
    totals = segments.select("part", F.expr("aggregate(counts, 0L, (a, x) -> a + x)").alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    bases = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))

    def run(batches):
        for batch in batches:
            for part, start, docs, counts, image in zip(*(batch.column(k).to_pylist() for k in range(5))):
                ids = decode_segment(image)
                ends = np.cumsum(counts)
                pieces = [ids[e - n : e].astype("<u4") for e, n in zip(ends, counts)]
                columns = [
                    pa.array(docs, batch.column(2).type.value_type),
                    pa.array(np.full(len(docs), part, np.int32)),
                    pa.array(start + ends - np.array(counts)),
                    pa.array(counts, pa.int64()),
                    pa.array([zlib.crc32(x.tobytes()) for x in pieces], pa.int64()),
                ]
                names = ["doc_id", "part", "start", "n_tokens", "ids_crc32"]
                if keep:
                    columns.append(pa.array([x.astype(np.int32) for x in pieces], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    share_code(spark)
    schema = f"doc_id {kind}, part int, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep
    rows = segments.select("part", "start", "doc_ids", "counts", "image").mapInArrow(run, schema)
    kept = [F.col("doc_id"), (F.col("base") + F.col("start")).alias("start"), F.col("n_tokens"), F.col("ids_crc32")] + [F.col("ids")] * keep
    return rows.join(bases, "part").select(*kept)


def token_files(docs: DataFrame, tokenizer_file: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, keep: bool = True) -> DataFrame:
    """Write the token files of ``docs`` and read them back."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-files")
    write_segments(docs, tokenizer_file, end_id, path, id_col, text_col)
    return read_segments(spark, path, docs.schema[id_col].dataType.simpleString(), keep)
