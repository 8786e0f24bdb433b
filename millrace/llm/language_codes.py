"""Language identification with error-correcting output codes.

Every language gets a codeword of +1/-1 bits. One binary classifier per bit
tells the languages with +1 from those with -1; it is the log-odds of hashed
character n-grams, fitted on the n-gram counts of *all* training documents
(counted where the documents lie, summed by Spark; no sample). Decoding adds the
logistic loss of each bit's margin against each codeword, weighted by how
reliable the bit was for that language on a bounded sample of the training
documents (``weigh_rows``), and takes the codeword with the smallest loss.

* ``score`` is the softmax over the negative losses, between 0 and 1.
* ``ambiguous`` is set where the two best losses are close, or where the hard
  bits are farther from the chosen codeword than the code can correct.
* Null texts and texts without a letter are ``und`` with score 0.
* No training rows: every prediction is ``und``. One language only: that
  language with score 1. Ties go to the language first in code point order.
* More than ``most_labels`` languages are an error: such a column is no language.
* Repeated rows count as often as they occur, and are in the sample together or
  not at all; without a sample every bit is trusted alike. Very long texts are
  read in windows. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import settle, share_code

BUCKET_BITS = 14
ORDERS = (3, 4)  # bytes in an n-gram
WEIGH_ROWS = 4000  # bound on the sample that weighs the bits: the rows of smallest hash of id and text
MOST_LABELS = 512  # bound on the languages, 131 KB of counts each on the driver
_GAP = b"    "
#: Letters in lower case; bytes of other scripts stay; everything else separates words.
_FOLD = bytes(b if 97 <= b < 123 or b >= 128 else b + 32 if 65 <= b < 91 else 32 for b in range(256))
_WINDOWS = 1 << 20


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts with gaps between, and (start, end) offsets of each."""
    raw = [x.encode("utf-8", "surrogatepass").translate(_FOLD) for x in texts]
    sizes = np.array([len(x) + len(_GAP) for x in raw], np.int64)
    data = np.frombuffer(_GAP + _GAP.join(raw) + _GAP + _GAP, np.uint8)
    starts = np.cumsum(np.concatenate([[0], sizes[:-1]])) + len(_GAP) - 1  # from the space before the first byte
    ends = starts + sizes - len(_GAP) + 1
    return data, np.stack([starts, ends], axis=1)


def _codes(data: np.ndarray, at: int, to: int, order: int) -> np.ndarray:
    """Hash buckets of the n-grams that start in [at, to)."""
    code = np.full(to - at, order, np.uint32)
    for k in range(order):
        code = code * np.uint32(0x01000193) + data[at + k : to + k]
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x2C1B3C6D)
    return code >> np.uint32(32 - BUCKET_BITS)


def _pieces(texts: list[str]):
    """Groups of texts of bounded total size; a long text is a group of its own."""
    group: list[int] = []
    size = 0
    for k, x in enumerate(texts):
        if group and size + len(x) > _WINDOWS:
            yield group
            group, size = [], 0
        group.append(k)
        size += len(x)
    if group:
        yield group


def ngram_counts(docs: DataFrame, text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """(label, bucket, n) over all rows with a text and a label."""

    def run(batches):
        totals: dict[str, np.ndarray] = {}

        def rows():
            for label, n in totals.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["label", "bucket", "n"])
            totals.clear()

        for batch in batches:
            texts, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for group in _pieces(texts):
                data, spans = _grams([texts[k] for k in group])
                for order in ORDERS:
                    codes = _codes(data, 0, len(data) - len(_GAP), order)
                    for k, (s, e) in zip(group, spans):
                        n = totals.setdefault(labels[k], np.zeros(1 << BUCKET_BITS, np.int64))
                        np.add(n, np.bincount(codes[s:e], minlength=len(n)), out=n) if e - s > 4096 else np.add.at(n, codes[s:e], 1)
            if len(totals) > 64:
                yield from rows()
        yield from rows()

    share_code(docs.sparkSession)
    rows = docs.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull()).select(text_col, F.col(label_col).cast("string"))
    return rows.mapInArrow(run, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))


def codebook(k: int) -> np.ndarray:
    """(k, bits) of +1/-1: the exhaustive code up to five languages, else a seeded code with far rows."""
    if k < 2:
        return np.ones((k, 1), np.int8)
    if k <= 5:
        columns = [(1, *c) for c in product((1, -1), repeat=k - 1) if -1 in c]
        return np.array(columns, np.int8).T
    bits = min(63, int(np.ceil(10 * np.log2(k))))
    rng, best = np.random.default_rng(k), (-1, None)
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.int8), (k, bits))
        code = code[:, np.abs(code.sum(axis=0)) < k]
        apart = min((code[i] != code[j]).sum() for i in range(k) for j in range(i))
        best = max(best, (apart, code), key=lambda x: x[0])
    return best[1]


class OutputCodes:
    """The fitted model: languages, codewords, n-gram weights by bit, decoding weights."""

    def __init__(self, labels: list[str], counts: np.ndarray) -> None:
        self.labels = labels
        self.code = codebook(len(labels))
        bits = self.code.shape[1]
        share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True) if len(labels) else counts
        self.weights = np.zeros((1 << BUCKET_BITS, bits), np.float32)
        for b in range(bits if len(labels) > 1 else 0):
            plus, minus = share[self.code[:, b] > 0].mean(axis=0), share[self.code[:, b] < 0].mean(axis=0)
            self.weights[:, b] = np.log(plus / minus)
        self.scale = np.ones(bits, np.float32)
        self.trust = np.full(self.code.shape, 1 / max(bits, 1))
        different = [(x != y).sum() for i, x in enumerate(self.code) for y in self.code[:i]]
        self.corrects = (int(min(different)) - 1) // 2 if different else 0

    def margins(self, texts: list[str]) -> np.ndarray:
        """Mean log-odds per n-gram of each text and bit."""
        out = np.zeros((len(texts), self.code.shape[1]))
        for group in _pieces(texts):
            data, spans = _grams([texts[k] for k in group])
            total = np.zeros((len(group), out.shape[1]))
            for at in range(0, len(data) - len(_GAP), _WINDOWS):  # more than once for a long text only
                to = min(at + _WINDOWS, len(data) - len(_GAP))
                cut = np.clip(spans, at, to) - at
                some = cut[:, 1] > cut[:, 0]
                for order in ORDERS:
                    got = self.weights[_codes(data, at, to, order)]
                    sums = np.add.reduceat(np.concatenate([got, np.zeros((1, got.shape[1]), np.float32)]), cut[some].ravel(), axis=0)[::2]
                    total[some] += sums
            out[group] = total / (len(ORDERS) * np.maximum(1, spans[:, 1] - spans[:, 0]))[:, None]
        return out

    def losses(self, margins: np.ndarray) -> np.ndarray:
        z = (margins / self.scale)[:, None, :] * self.code[None]
        return (np.logaddexp(0, -4 * z) * self.trust).sum(axis=2)

    def weigh(self, margins: np.ndarray, truth: np.ndarray) -> None:
        """Scale the bits, and trust each bit for each language as it was right on a sample."""
        if len(truth):
            self.scale = np.maximum(np.abs(margins).mean(axis=0), 1e-6)
            for k in range(len(self.labels)):
                if (of := margins[truth == k]).size:
                    right = (of * self.code[k] > 0).mean(axis=0) + 1e-3
                    self.trust[k] = right / right.sum()

    def decode(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        if not self.labels:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        if len(self.labels) == 1:
            return self.labels * len(texts), np.ones(len(texts)), np.zeros(len(texts), bool)
        margins = self.margins(texts)
        losses = self.losses(margins)
        best = losses.argmin(axis=1)
        low = losses - losses.min(axis=1, keepdims=True)
        share = np.exp(-8 * low)
        score = 1 / share.sum(axis=1)
        wrong = (np.sign(margins) != self.code[best]).sum(axis=1)
        near = np.partition(low, 1, axis=1)[:, 1] < 0.05
        return [self.labels[k] for k in best], score, near | (wrong > self.corrects)


def fit(train: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", weigh_rows: int = WEIGH_ROWS, most_labels: int = MOST_LABELS) -> OutputCodes:
    """Fit on all rows of ``train`` with text and label; the counts, labels x 2^14, come to the driver."""
    counts = settle(ngram_counts(train, text_col, label_col), "ngram-counts")
    if (n := counts.select("label").distinct().count()) > most_labels:
        raise ValueError(f"{n} languages to learn, more than {most_labels}; their counts would not fit the driver")
    counts = counts.toPandas()
    labels = sorted(counts["label"].unique().tolist(), key=lambda x: x.encode("utf-32-be"))
    dense = np.zeros((len(labels), 1 << BUCKET_BITS))
    dense[[labels.index(x) for x in counts["label"]], counts["bucket"].to_numpy(int)] = counts["n"].to_numpy()
    model = OutputCodes(labels, dense)
    if len(labels) > 1:
        rows = train.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull())
        rows = rows.select(F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(17), text_col), F.lit(1 << 53)).alias("h"), text_col, F.col(label_col).cast("string"))
        under = min(1.0, weigh_rows / max(1, rows.count())) * (1 << 53)

        def run(batches):
            for batch in batches:
                got = model.margins(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(got.tolist(), pa.list_(pa.float64()))], ["h", "label", "m"])

        seen = rows.where(F.col("h") < F.lit(under)).mapInArrow(run, "h long, label string, m array<double>").orderBy("h", "label").limit(weigh_rows).toPandas()
        if len(seen):  # else every bit is trusted alike
            model.weigh(np.array(seen["m"].tolist()).reshape(len(seen), -1), np.array([labels.index(x) for x in seen["label"]]))
    return model


def identify(docs: DataFrame, model: OutputCodes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) of every row."""

    def run(batches):
        for batch in batches:
            there = np.array(batch.column(3).to_pylist(), bool)
            texts = [x for x, ok in zip(batch.column(2).to_pylist(), there) if ok]
            names, score, doubt = np.full(len(there), "und", object), np.zeros(len(there)), np.ones(len(there), bool)
            if texts:
                names[there], score[there], doubt[there] = model.decode(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names.tolist(), pa.string()), pa.array(score), pa.array(doubt)], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"]
            )

    share_code(docs.sparkSession)
    rows = docs.select(id_col, F.coalesce(held_out(id_col), F.lit(False)), text_col, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, lang_pred string, score double, ambiguous boolean")
