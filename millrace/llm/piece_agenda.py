"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Adjacent symbols whose concatenation is a piece wait in an agenda ordered by the
piece's score, then by position; the best pair is merged, its neighbours enter
the agenda, and stale entries are skipped. Symbols that are no piece fall back to
byte pieces. Two characters that are neighbours in no piece are never merged
across, so a text is cut there, the agenda runs once per distinct part, and the
result is kept in a bounded memo. Many short parts have their agendas side by
side, a row each: the scores of a row's pairs are its agenda, of which the best
is taken, merged and replaced by those of its neighbours, in all rows at once.

In each Arrow batch the ids of every whole text, and every decoded text, are
compared with the sentencepiece library's. Where they differ, the library's are
returned and ``agrees`` is false, so results are the library's in any case.

Null texts are encoded as empty texts. Repeated rows are encoded alike, also
where an id is repeated; an empty table gives an empty table; other columns are
not read. Very long texts are held one at a time.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from functools import cache
from heapq import heapify, heappop, heappush
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from millrace.llm.word_batches import CLASSES, Memo, distinct_units, gather, slices
from millrace.session import share_code

SPACE = "▁"
MEMO_PARTS = 200_000  # in each of two generations
_NONE = np.iinfo(np.int64).max  # the score of a pair that makes no piece
_ROW = 24  # the longest part that is merged in a row
_TEXTS_AT_ONCE = 1 << 22  # bytes of text encoded at a time
_LIBRARY_AT_ONCE = 1 << 20  # bytes of ids of the texts given to the library at a time; it gives Python lists


class PieceAgenda:
    """Encoder and decoder for one model file."""

    def __init__(self, model_file: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.library = sp = SentencePieceProcessor(model_file=model_file)
        size = sp.get_piece_size()
        plain = [k for k in range(size) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) or sp.is_unused(k))]
        self.ids = {sp.id_to_piece(k): k for k in plain}
        order = {x: k for k, x in enumerate(sorted({-sp.get_score(k) for k in plain}))}
        self.score = {p: order[-sp.get_score(k)] for p, k in self.ids.items() if len(p) > 1}  # places by score, best first
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.has_bytes = all(sp.is_byte(k) for k in self.byte_ids)
        self.unknown, self.begin, self.end = sp.unk_id(), sp.bos_id(), sp.eos_id()
        probe = " a  b\t　ﬁ Å\n"
        self.as_is = sp.normalize(probe) == SPACE + probe.replace(" ", SPACE)
        splits = not any(SPACE in p.lstrip(SPACE) for p in self.score)
        self.whole = not (self.as_is and splits)
        self.neighbours = {p[k : k + 2] for p in self.score for k in range(len(p) - 1)}
        self.words = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.runs = re.compile(r"[^\W\d_]+|[\W\d_]+")
        # A byte class may be cut from another except at these characters; texts with one of them are cut by code points.
        kind = lambda c: int(CLASSES[min(ord(c), 128)])
        mixed = [p for p in self.neighbours if SPACE not in p and kind(p[0]) != kind(p[1])]
        self.odd = [SPACE, *sorted({c for p in mixed for c in p if ord(c) >= 128 or all(ord(x) < 128 for x in p)})]
        self.of_point = np.full(0x11001, -1, np.int64)  # ids of characters; the last stands for all beyond
        for c, k in self.ids.items():
            if len(c) == 1 and ord(c) < 0x11000:
                self.of_point[ord(c)] = k
        self._pairs()
        self.memo = Memo(MEMO_PARTS)
        self.pieces = [self._piece_bytes(k) for k in range(size)]
        self.ends = (np.array([self.begin], "<u4").tobytes(), np.array([self.end], "<u4").tobytes())

    def _piece_bytes(self, k: int) -> bytes:
        if self.library.is_control(k):
            return b""
        if self.library.is_byte(k):
            return bytes([int(self.library.id_to_piece(k)[3:5], 16)])
        if self.library.is_unknown(k):
            return " ⁇ ".encode()
        return self.library.id_to_piece(k).replace(SPACE, " ").encode()

    def merge(self, word: str) -> list[str]:
        """The symbols of a word after all merges."""
        get, symbols = self.score.get, list(word)
        last = len(symbols) - 1
        if last < 1:
            return symbols
        # An entry is one integer, the place of the score, then the position.
        shift = last.bit_length()
        mask = (1 << shift) - 1
        before, after = list(range(-1, last)), list(range(1, last + 2))
        agenda = [s << shift | k for k, s in enumerate(map(get, map(add, symbols, symbols[1:]))) if s is not None]
        heapify(agenda)
        while agenda:
            entry = heappop(agenda)
            k = entry & mask
            right = after[k]
            if right > last or not symbols[k]:
                continue
            pair = symbols[k] + symbols[right]
            if get(pair) != entry >> shift:
                continue
            symbols[k], symbols[right] = pair, ""
            after[k] = right = after[right]
            if right <= last:
                before[right] = k
                if (s := get(pair + symbols[right])) is not None:
                    heappush(agenda, s << shift | k)
            if (left := before[k]) >= 0 and (s := get(symbols[left] + pair)) is not None:
                heappush(agenda, s << shift | left)
        return [x for x in symbols if x]

    def _pairs(self) -> None:
        """Arrays of all pairs of pieces that make a piece: sorted keys, places by score, ids of the whole."""
        found = [(self.ids[p[:k]] << 32 | self.ids[p[k:]], s, self.ids[p]) for p, s in self.score.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        keys, self.pair_score, self.pair_id = np.array(sorted(found), np.int64).reshape(-1, 3).T.copy()
        self.pair_keys = np.append(keys, np.iinfo(np.int64).max)
        self.pair_score, self.pair_id = np.append(self.pair_score, _NONE), np.append(self.pair_id, 0)

    def _scores(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left << 32 | right
        at = np.searchsorted(self.pair_keys, key)
        there = self.pair_keys[at] == key
        return np.where(there, self.pair_score[at], _NONE), self.pair_id[at]

    def merge_rows(self, symbols: np.ndarray) -> list[bytes]:
        """The symbols (ids of single characters) of each row after all merges, as little-endian integers of 32 bits."""
        out: list = [b""] * len(symbols)
        rows = np.arange(len(symbols))
        score, whole = self._scores(symbols[:, :-1], symbols[:, 1:])

        def give(some: np.ndarray, done: np.ndarray) -> None:
            raw, width = done.astype("<u4").tobytes(), 4 * done.shape[1]
            for k, at in zip(some.tolist(), range(0, len(raw), width)):
                out[k] = raw[at : at + width]

        while len(rows) and symbols.shape[1] > 1:
            at = score.argmin(axis=1)
            none = score[np.arange(len(rows)), at] == _NONE
            if none.any():
                give(rows[none], symbols[none])
                go = ~none
                rows, symbols, score, whole, at = rows[go], symbols[go], score[go], whole[go], at[go]
            every, n = np.arange(len(rows)), symbols.shape[1]
            symbols[every, at] = whole[every, at]
            symbols = symbols[np.arange(n) != at[:, None] + 1].reshape(len(rows), n - 1)
            stays = np.arange(n - 1) != at[:, None]
            score, whole = score[stays].reshape(len(rows), n - 2), whole[stays].reshape(len(rows), n - 2)
            for side in (at - 1, at):  # the pairs that the merged symbol ends and begins
                some = np.flatnonzero((side >= 0) & (side < n - 2))
                k = side[some]
                score[some, k], whole[some, k] = self._scores(symbols[some, k], symbols[some, k + 1])
        give(rows, symbols)
        return out

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of each part."""
        out, rows = [b""] * len(parts), {}
        for k, x in enumerate(parts):
            rows.setdefault(len(x), []).append(k)
        for n, some in rows.items():
            if n > _ROW:
                known = np.zeros(len(some), bool)
            else:
                points = np.frombuffer("".join([parts[k] for k in some]).encode("utf-32-le"), "<u4").reshape(-1, n)
                symbols = self.of_point[np.minimum(points, len(self.of_point) - 1)]
                known = (symbols >= 0).all(axis=1)
                for k, x in zip(np.flatnonzero(known).tolist(), self.merge_rows(symbols[known])):
                    out[some[k]] = x
            for k in np.flatnonzero(~known).tolist():
                out[some[k]] = self.encode_word(parts[some[k]])
        return out

    def encode_word(self, word: str) -> bytes:
        symbols = self.merge(word)
        try:
            return array("I", map(self.ids.__getitem__, symbols)).tobytes()
        except KeyError:
            pass
        out: list[int] = []
        for symbol in symbols:
            k = self.ids.get(symbol)
            if k is not None:
                out.append(k)
            elif self.has_bytes:
                out.extend(self.byte_ids[b] for b in symbol.encode())
            else:
                out.append(self.unknown)
        return array("I", out).tobytes()

    def _part(self, part: str) -> bytes:
        ids = self.memo.get(part)
        if ids is None:
            ids = self.encode_word(part)
            self.memo.put(part, ids)
        return ids

    def encode_spaced(self, word: str) -> bytes:
        """Ids of a word with its leading space or spaces; letters are cut from other characters where no piece has both."""
        if word[1:].isalpha():
            return self._part(word)
        first, *runs = self.runs.findall(word[1:]) or [""]
        now, out = word[0] + first, []
        for run in runs:
            if now[-1] + run[0] in self.neighbours:
                now += run
            else:
                out.append(self._part(now))
                now = run
        return b"".join([*out, self._part(now)])

    def encode(self, text: str) -> bytes:
        """Ids with begin and end, as little-endian unsigned 32-bit integers."""
        if not text:
            return self.ends[0] + self.ends[1]
        if self.whole:
            return self.ends[0] + self.encode_word(self.library.normalize(text)) + self.ends[1]
        # A text begins as if after a space.
        return b"".join([self.ends[0], *map(self.encode_spaced, self.words.findall(SPACE + text.replace(" ", SPACE))), self.ends[1]])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as ``encode`` gives them, put together from those of its distinct parts."""
        out = [b""] * len(texts)
        plain = [k for k, x in enumerate(texts) if x and not self.whole and not any(c in x for c in self.odd)]
        places, ends, parts = distinct_units([b" " + texts[k].encode() for k in plain])  # a text begins as if after a space
        parts = [x.replace(" ", SPACE) for x in parts]
        table = self.memo.table(parts, self.encode_parts)
        for k, ids in zip(plain, gather(table, places, ends)):
            out[k] = self.ends[0] + ids.tobytes() + self.ends[1]
        return [x or self.encode(text) for x, text in zip(out, texts)]

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.pieces.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


@cache
def agenda(model_file: str) -> PieceAgenda:
    return PieceAgenda(model_file)


def _checked(coder: PieceAgenda, texts: list[str]):
    """(ids as bytes, decoded text, agrees) of each text."""
    mine = coder.encode_batch(texts)
    for at, to in slices([len(x) for x in mine], _LIBRARY_AT_ONCE):
        want = coder.library.encode(texts[at:to], add_bos=True, add_eos=True, num_threads=1)
        for k, ids, decoded in zip(range(at, to), want, coder.library.decode(want, num_threads=1)):
            packed = array("I", ids).tobytes()
            yield packed, decoded, mine[k] == packed and coder.decode(ids) == decoded


def encode_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, agrees[, ids, decoded]) of every row."""

    def run(batches):
        coder = agenda(model_file)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for at, to in slices(sizes, _TEXTS_AT_ONCE):
                texts = [x or "" for x in batch.column(1).slice(at, to - at).to_pylist()]
                rows = list(_checked(coder, texts))
                columns = [
                    batch.column(0).slice(at, to - at),
                    pa.array([len(r[0]) // 4 for r in rows], pa.int64()),
                    pa.array([hashlib.sha256(r[0]).hexdigest() for r in rows]),
                    pa.array([hashlib.sha256(r[1].encode()).hexdigest() for r in rows]),
                    pa.array([r[2] for r in rows]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees"]
                if keep:
                    columns += [pa.array([np.frombuffer(r[0], "<u4").astype(np.int32) for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    share_code(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean" + ", ids array<int>, decoded string" * keep
    return docs.select(id_col, text_col).mapInArrow(run, schema)
