"""Quality scores from a sparse rule ensemble over text statistics.

Statistics of the text are Spark column expressions. A bounded sample of the
labelled rows (``max_rows``, those with the smallest hash of their id) trains
shallow boosted trees in numpy on the driver; every path from a root becomes a
conjunctive rule; a lasso logistic regression keeps few of the rules; and the
rules kept are compiled back into one Spark column expression, so scoring is a
projection that the JVM runs.

Labels, language, source and id are never statistics. Null and empty texts have
the statistics of the empty text. Null labels and labels of unknown documents
are not used, and a document with several labels has their maximum. Without
labels every score is 0.5; if all labels agree, the score is their share,
smoothed. Repeated rows are scored alike; other columns are not read. Very long
texts are read by the JVM a row at a time. An empty table gives an empty table.
Values equal to a bound lie below it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.language_codes import held_out

MAX_ROWS = 12_000
THRESHOLD = 0.3
TREES, DEPTH, BINS = 24, 3, 32


def statistics(text: Column) -> Column:
    """A struct of shares and means of a text; 0 where there is nothing to count. The text is split once."""

    def of(cut: Column) -> Column:
        text, marks, words, lines = cut["text"], cut["marks"], cut["words"], cut["lines"]
        chars = F.length(text).cast("double")
        # What is left without all others is counted; no list of matches is made.
        share = lambda kept: F.when(chars > 0, F.length(F.regexp_replace(marks, f"[^{kept}]++", "")) / chars).otherwise(0.0)
        distinct = lambda a: F.size(F.array_distinct(a)) / F.size(a)
        return F.struct(
            F.log1p(chars).alias("log_chars"),
            share(r"\p{Lu}").alias("upper"),
            share("0-9").alias("digits"),
            share(r"#$%&*+<=>@\[\\\]\^_{}~").alias("symbols"),
            share("!?").alias("bangs"),
            share("|").alias("bars"),
            share(".,").alias("stops"),
            share("\n").alias("line_feeds"),
            share("/:;()\"'-").alias("slashes"),
            distinct(words).alias("distinct_words"),
            distinct(lines).alias("distinct_lines"),
            F.log1p(F.size(words).cast("double")).alias("words"),
            (chars / F.size(words)).alias("word_length"),
        )

    text = F.coalesce(text, F.lit(""))
    marks = F.regexp_replace(text, r"[\p{Ll} ]++", "")  # small letters and spaces, most of a text, are in none of the classes
    cut = F.struct(text.alias("text"), marks.alias("marks"), F.split(text, r"[\x20\x09-\x0D]+").alias("words"), F.split(text, "\n").alias("lines"))
    return F.element_at(F.transform(F.array(cut), of), 1)


NAMES = ("log_chars", "upper", "digits", "symbols", "bangs", "bars", "stops", "line_feeds", "slashes", "distinct_words", "distinct_lines", "words", "word_length")


# --- trees and rules --------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, above, bound): value > bound if above, else value <= bound."""

    terms: tuple[tuple[str, bool, float], ...]

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, above, bound in self.terms:
            v = x[:, names.index(name)]
            out &= (v > bound) if above else (v <= bound)
        return out

    def column(self, stats: Column) -> Column:
        out = F.lit(True)
        for name, above, bound in self.terms:
            out = out & ((stats[name] > bound) if above else (stats[name] <= bound))
        return out


def _tree(bins: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, names: list[str], features: np.ndarray) -> tuple[list[tuple], np.ndarray]:
    """Paths of one regression tree on binned values, and its prediction for each row."""
    paths: list[tuple] = []
    value = np.zeros(len(bins))

    def grow(rows: np.ndarray, path: tuple, depth: int) -> None:
        if path:
            paths.append(path)
        value[rows] = gradient[rows].sum() / (hessian[rows].sum() + 1.0)
        if depth == DEPTH or len(rows) < 40:
            return
        best = (1e-6, None)
        total_g, total_h = gradient[rows].sum(), hessian[rows].sum()
        for f in features:
            g = np.bincount(bins[rows, f], gradient[rows], BINS).cumsum()[:-1]
            h = np.bincount(bins[rows, f], hessian[rows], BINS).cumsum()[:-1]
            n = np.bincount(bins[rows, f], minlength=BINS).cumsum()[:-1]
            gain = g**2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
            gain[(n < 15) | (len(rows) - n < 15)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0] and k < len(edges[f]):
                best = (gain[k], (f, k))
        if best[1] is None:
            return
        f, k = best[1]
        for above in (False, True):
            grow(rows[(bins[rows, f] > k) == above], (*path, (names[f], above, float(edges[f][k]))), depth + 1)

    grow(np.arange(len(bins)), (), 0)
    return paths, value


def _rules(x: np.ndarray, y: np.ndarray, names: list[str], seed: int) -> list[Rule]:
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(x.shape[1])], axis=1)
    rng, margin = np.random.default_rng(seed), np.full(len(y), np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    found: dict[Rule, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        features = rng.permutation(x.shape[1])[: max(4, 2 * x.shape[1] // 3)]
        paths, value = _tree(bins, edges, y - p, p * (1 - p), names, features)
        margin += 0.3 * value
        found.update((Rule(p), None) for p in paths)
    return list(found)


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty on all but the intercept, by accelerated proximal gradient."""
    mean, spread = z.mean(axis=0), np.maximum(z.std(axis=0), 0.05)
    z = (z - mean) / spread
    n, k = z.shape
    top = np.linalg.norm(z[:, :], 2) ** 2 if k else 1.0
    rate = 4 * n / (top + n)
    w, b = np.zeros(k), np.log((y.sum() + 1) / (n - y.sum() + 1))
    v, c, t = w, b, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(z @ v + c))) - y
        new = v - rate * (z.T @ r) / n
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        fresh = c - rate * r.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t2 * (new - w), fresh + (t - 1) / t2 * (fresh - b)
        w, b, t = new, fresh, t2
    return float(b - (w * mean / spread).sum()), w / spread


@dataclass
class RuleEnsemble:
    intercept: float
    rules: list[tuple[Rule, float]]

    def score(self, text: Column) -> Column:
        """Probability of label 1. The statistics are bound once, so no rule evaluates them again wherever the optimizer moves the expression."""

        def of(stats: Column) -> Column:
            margin = F.lit(self.intercept)
            for rule, weight in self.rules:
                margin = margin + F.when(rule.column(stats), F.lit(weight)).otherwise(0.0)
            return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))

        return F.element_at(F.transform(F.array(statistics(text)), of), 1)


def fit_ensemble(x: np.ndarray, y: np.ndarray, names: list[str], penalty: float = 0.002, seed: int = 8) -> RuleEnsemble:
    if not len(y):
        return RuleEnsemble(0.0, [])
    if y.min() == y.max():
        return RuleEnsemble(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), [])
    rules = _rules(x, y, names, seed)
    z = np.stack([r.holds(x, names) for r in rules], axis=1).astype(float) if rules else np.zeros((len(y), 0))
    intercept, weights = _lasso(z, y, penalty)
    return RuleEnsemble(intercept, [(r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-3])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> RuleEnsemble:
    """Fit on at most ``max_rows`` labelled rows outside the held-out fifth."""
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    usable = usable.groupBy(F.col(id_col).alias("__label_id")).agg(F.max(label_col).alias("__label"))
    sample = usable.orderBy(F.xxhash64("__label_id"), "__label_id").limit(max_rows)
    known = docs.select(id_col, text_col).join(F.broadcast(sample), docs[id_col] == sample["__label_id"])  # max_rows small rows
    names = list(NAMES)
    # Of several texts of one id, the one of smallest statistics is learned from, so no more than max_rows come to the driver.
    got = known.select("__label_id", "__label", statistics(F.col(text_col)).alias("__q")).groupBy("__label_id").agg(F.max("__label").alias("__label"), F.min("__q").alias("__q"))
    got = got.select("__label", *[f"__q.{n}" for n in names]).toPandas()
    got = got.sort_values(list(got.columns), ignore_index=True)  # the order of arrival doesn't matter
    return fit_ensemble(got.iloc[:, 1:].to_numpy(float), got["__label"].to_numpy(float), names)


def scored(docs: DataFrame, model: RuleEnsemble, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), model.score(F.col(text_col)).alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def keep_good(docs: DataFrame, model: RuleEnsemble, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not rejected; all columns stay."""
    return docs.where(model.score(F.col(text_col)) >= threshold)
