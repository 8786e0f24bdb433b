"""Evaluation: n-gram overlap, BLEU, caption diversity, cosine thresholds, score normalisation."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.filters import bound


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: x != "")


def rouge_n(df: DataFrame, key: str, candidate: str, reference: str, n: int = 1) -> DataFrame:
    """(key, precision, recall, f1) of clipped n-gram overlap, by one aggregation; no pair of tokens is formed."""

    def grams(column: str, side: str) -> DataFrame:
        none = F.array().cast("array<string>")
        spans = bound(tokens(F.col(column)), lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda k: F.array_join(F.slice(w, k, n), " "))).otherwise(none))
        return df.select(key, F.explode(spans).alias("gram"), F.lit(side).alias("side"))

    both = grams(candidate, "c").unionByName(grams(reference, "r"))
    per = both.groupBy(key, "gram").agg(F.count_if(F.col("side") == "c").alias("c"), F.count_if(F.col("side") == "r").alias("r"))
    got = per.groupBy(key).agg(F.sum(F.least("c", "r")).alias("hit"), F.sum("c").alias("c"), F.sum("r").alias("r"))
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = rate(F.col("hit"), F.col("c")), rate(F.col("hit"), F.col("r"))
    return got.select(key, p.alias("precision"), r.alias("recall"), rate(2 * p * r, p + r).alias("f1"))


def lcs(a: list[str], b: list[str]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@F.pandas_udf(T.DoubleType())
def rouge_l(candidate: pd.Series, reference: pd.Series) -> pd.Series:
    def one(c, r):
        c, r = (c or "").lower().split(), (r or "").lower().split()
        n = lcs(c, r)
        return 2 * n / (len(c) + len(r)) if n else 0.0

    return pd.Series([one(c, r) for c, r in zip(candidate, reference)], dtype=float)


def bleu(candidate: str, references: list[str], order: int = 4) -> float:
    """0 to 100; clipped by the largest count in any reference, length against the closest."""
    c, refs = candidate.split(), [r.split() for r in references]
    if not c or not refs:
        return 0.0
    grams = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    total = 0.0
    for n in range(1, order + 1):
        mine = grams(c, n)
        most = Counter()
        for r in refs:
            most |= grams(r, n)
        hit, count = sum((mine & most).values()), max(1, sum(mine.values()))
        if not hit:
            return 0.0
        total += math.log(hit / count) / order
    near = min((abs(len(r) - len(c)), len(r)) for r in refs)[1]
    return 100 * min(1.0, math.exp(1 - near / len(c))) * math.exp(total)


@F.pandas_udf(T.DoubleType())
def bleu_score(candidate: pd.Series, references: pd.Series) -> pd.Series:
    return pd.Series([bleu(c or "", [r for r in (rs if rs is not None else []) if r]) for c, rs in zip(candidate, references)], dtype=float)


def diversity(captions: list[str], order: int = 4) -> float:
    """Spread of a group's captions from the eigenvalues of their n-gram similarity; 0 for fewer than two."""
    if len(captions) < 2:
        return 0.0
    bags = [Counter(tuple(w[i : i + n]) for w in [x.split()] for n in range(1, order + 1) for i in range(len(w) - n + 1)) for x in captions]
    seen = Counter(g for b in bags for g in b)
    vectors = [{g: k * math.log(1 + len(bags) / seen[g]) for g, k in b.items()} for b in bags]
    norm = [math.sqrt(sum(v * v for v in b.values())) or 1.0 for b in vectors]
    m = np.array([[sum(v * b.get(g, 0) for g, v in a.items()) / (norm[i] * norm[j]) for j, b in enumerate(vectors)] for i, a in enumerate(vectors)])
    root = np.sqrt(np.clip(np.linalg.eigvalsh(m), 0, None))
    return 0.0 if not root.sum() else float(-math.log(root.max() / root.sum()) / math.log(len(captions)))


def diversity_of(captions: DataFrame, group: str, text: str) -> DataFrame:
    """(group, captions, diversity). The matrix of a group's captions is square in their number, so a group is the captions of one image, not of a corpus."""
    measured = F.pandas_udf(lambda rows: rows.map(lambda x: diversity(list(x))), T.DoubleType())
    rows = captions.where(F.col(text).isNotNull()).groupBy(group).agg(F.array_sort(F.collect_list(text)).alias("__t"))
    return rows.select(group, F.size("__t").alias("captions"), measured("__t").alias("diversity"))


def mean_scores(scores: DataFrame, columns: tuple[str, ...] = ("precision", "recall", "f1")) -> DataFrame:
    """One row of means over pairs; the scores come from any model."""
    return scores.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in columns])


def client_score(df: DataFrame, prompt: str, client, tries: int = 3, **options) -> DataFrame:
    """``df`` with the score of a judging model from 0 to 1 and its error: 0.0 where all tries failed or the reply is no number."""
    from millrace.operators import qa

    got = qa.complete(df, prompt, client, "__s", tries=tries, usage=True, **options)
    return got.withColumn("score", F.coalesce(unit_score(F.col("__s")), F.lit(0.0))).withColumn("error", F.col("__s_error")).select(*df.columns, "score", "error")


def image_fidelity(df: DataFrame) -> DataFrame:
    """A measure that is named and not there: every row says so."""
    return df.withColumn("status", F.lit("not_implemented")).withColumn("fidelity", F.lit(None).cast("double"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def unit_score(c: Column) -> Column:
    """A model's score as a number from 0 to 1: exp below zero, 1 above one, 0 for what is no number."""
    x = c.try_cast("double")
    return F.when(x.isNull(), 0.0).when(x <= 0, F.exp(x)).otherwise(F.least(x, F.lit(1.0)))
