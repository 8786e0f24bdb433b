"""Mixing sources to target weights with hash-threshold histograms, in DataFrame functions only.

Every document has a fixed hash of its id. A source whose target is r times its
size takes every document floor(r) times, and once more the documents whose hash
lies under the source's threshold. The threshold is found without sorting: sizes
are summed by source and by the leading bits of the hash, the running sum names
the bucket in which the budget ends, and only that bucket is refined by the next
bits, until a bucket is a single hash. Thresholds are nested: a larger budget
takes a superset of what a smaller one takes, and reruns agree.

Null sources are a source of their own, ordered last; null texts have size 0; a
null doc_id hashes like any other value. Rows that repeat a doc_id share a hash,
so they are taken or left together. Sources of size 0 have the target 0. Other
columns are not read by ``mix`` and kept by ``mixed_rows``. Tables by source are small (one row a
source); they are joined as Spark sees fit and never sent to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import settle

LEVEL_BITS = 12
LEVELS = 5  # 60 bits of the hash
#: ASCII white space, as in the words [^\\x20\\x09-\\x0D]+.
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def hash60(key: Column) -> Column:
    """The first 60 bits of the MD5 of the key as text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[float], total_share: float, most: float) -> DataFrame:
    """(source, source_size, target): shares by weight, none above ``most`` times its source's size.

    The excess of a source that is full goes to the others by weight until none
    is above: with the sources in the order of size per weight, those before the
    water level are full, and the level is what is left over the weights left.
    """
    by = sized.groupBy("source").agg(F.sum("size").cast("double").alias("source_size"))
    ranked = by.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(cycle, ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    upto = Window.orderBy("full_at", "rank").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        ranked.withColumn("budget", F.lit(float(total_share)) * F.sum("source_size").over(everything))
        .withColumn("before", F.coalesce(F.sum("cap").over(upto), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
        .withColumn("level", (F.col("budget") - F.col("before")) / F.col("weight_left"))
    )
    # The level of the first source that doesn't fill up holds for all the others.
    level = F.min(F.when(F.col("level") < F.col("full_at"), F.struct("full_at", "rank", "level"))).over(everything)["level"]
    share = F.when(level.isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * level))
    return ranked.withColumn("target", share).select("source", F.col("source_size").cast("long").alias("source_size"), "target")


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, threshold): documents with hash < threshold sum to nearly the source's ``budget``.

    ``sized`` has (source, size, h), ``budgets`` (source, budget). Each level
    reads only the rows of the boundary buckets of the level before.
    """
    at = budgets.select("source", F.col("budget").alias("left"))
    rows, found = sized, None
    for level in range(1, LEVELS + 1):
        bits = 60 - LEVEL_BITS * level
        sums = rows.groupBy("source", F.shiftright("h", bits).alias("bucket")).agg(F.sum("size").alias("n"))
        sums = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy("bucket")))
        sums = sums.withColumnRenamed("source", "s")
        # The boundary bucket is the first whose running sum passes what is left; without one every row is taken.
        passes = F.when(F.col("upto") > F.col("left"), F.struct("bucket", (F.col("left") - (F.col("upto") - F.col("n"))).alias("left"), "n"))
        ends = at.select("source", "left").join(sums, at["source"].eqNullSafe(sums["s"]), "left").groupBy("source").agg(F.min(passes).alias("end"))
        now = settle(ends.select("source", (F.col("end.bucket") * F.lit(1 << bits)).alias("prefix"), "end.left", "end.n"), "mix-boundary")
        whole = now.where("prefix is null").select("source", F.lit(1 << 60).cast("long").alias("threshold"))
        found = whole if found is None else found.unionByName(whole)
        at = now.where("prefix is not null")
        edge = at.select(F.col("source").alias("s"), F.shiftright("prefix", bits).alias("b"))
        rows = rows.join(edge, rows["source"].eqNullSafe(edge["s"]) & (F.shiftright(rows["h"], bits) == edge["b"])).select("source", "size", "h")
    # The last bucket is one hash: it is taken if that brings the sum nearer to the budget.
    last = F.col("prefix") + F.when(2 * F.col("left") >= F.col("n"), 1).otherwise(0)
    return at.select("source", last.cast("long").alias("threshold")).unionByName(found)


def _plan(sized: DataFrame, weights: Sequence[float], total_share: float, most: float) -> DataFrame:
    """(s, source_size, target, turns, threshold), a row a source."""
    targets = settle(source_targets(sized, weights, total_share, most), "mix-targets")
    # A sum of whole sizes is exact, and so is most * size for a whole ``most``: a full source has no remainder.
    turns = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = targets.withColumn("turns", turns.cast("long")).withColumn("budget", F.col("target") - F.col("turns") * F.col("source_size"))
    cut = thresholds(sized, plan.select("source", "budget")).withColumnRenamed("source", "s")
    return settle(plan.join(cut, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumnRenamed("source", "s"), "mix-plan")


def _copies() -> Column:
    return (F.col("turns") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0)).cast("long")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    return settle(rows.withColumn("h", hash60(F.col("doc_id"))), "mix-sizes")


def mix(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), total_share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies, taken) of every row.

    ``copies`` is how often the mix takes the document (at most ceil(most)) and
    ``taken`` is copies times size.
    """
    sized = _sized(docs, id_col, text_col, source_col)
    plan = _plan(sized, weights, total_share, most)
    return (
        sized.join(plan, sized["source"].eqNullSafe(plan["s"]))
        .withColumn("copies", _copies())
        .select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def mixed_rows(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), total_share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken; all columns stay."""
    plan = _plan(_sized(docs, id_col, text_col, source_col), weights, total_share, most)
    plan = plan.select(*[F.col(c).alias(f"__{c}") for c in plan.columns])
    copies = F.col("__turns") + F.when(hash60(docs[id_col]) < F.col("__threshold"), 1).otherwise(0)
    joined = docs.join(plan, docs[source_col].cast("string").eqNullSafe(plan["__s"])).withColumn("__copies", copies).where("__copies > 0")
    return joined.withColumn("__turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies").cast("long")))).select(*docs.columns)
