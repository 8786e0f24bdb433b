"""Label trees as adjacency tables (node_id, parent_id, label, ordinal)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import settle

#: Levels after which the paths so far are written, and their number is held against the number of nodes.
_LEVELS_AT_ONCE = 32


def paths(nodes: DataFrame, most_depth: int | None = None) -> DataFrame:
    """(node_id, label, path, depth) by level-wise joins until a level is empty; an error where a node is below itself, or at ``most_depth`` or more."""
    level = nodes.where("parent_id is null").select("node_id", "label", F.col("label").alias("path"), F.lit(0).alias("depth"))
    out, depth, most = level, 0, None
    while True:
        depth += 1
        up = level.select(F.col("node_id").alias("up_id"), F.col("path").alias("up_path"))
        level = nodes.join(up, nodes.parent_id == up.up_id).select("node_id", "label", F.concat_ws("/", "up_path", "label").alias("path"), F.lit(depth).alias("depth"))
        level = settle(level, "tree-level")
        if level.isEmpty():
            return out
        if most_depth is not None and depth >= most_depth:
            raise ValueError(f"the tree has nodes at depth {most_depth}")
        out = out.unionByName(level)
        if depth % _LEVELS_AT_ONCE == 0:
            most = nodes.count() if most is None else most
            if depth >= most:
                raise ValueError("the tree has a cycle")
            out = settle(out, "tree-levels")


def add(nodes: DataFrame, node_id, parent_id, label: str) -> DataFrame:
    last = F.lit(1 << 30)
    kind = nodes.schema["parent_id"].dataType
    new = nodes.sparkSession.range(1).select(F.lit(node_id).alias("node_id"), F.lit(parent_id).cast(kind).alias("parent_id"), F.lit(label).alias("label"), last.alias("ordinal"))
    return nodes.unionByName(new)


def remove(nodes: DataFrame, node_id) -> DataFrame:
    """Without the node and all below it."""
    gone = level = nodes.where(F.col("node_id") == node_id).select("node_id").distinct()
    while True:
        below = nodes.join(level.select(F.col("node_id").alias("p")), F.col("parent_id") == F.col("p")).select("node_id").distinct()
        level = settle(below.join(gone, "node_id", "left_anti"), "tree-gone")
        if level.isEmpty():
            return nodes.join(gone, "node_id", "left_anti")
        gone = gone.unionByName(level)


def rename(nodes: DataFrame, node_id, label: str) -> DataFrame:
    return nodes.withColumn("label", F.when(F.col("node_id") == node_id, label).otherwise(F.col("label")))


def find(nodes: DataFrame, label: str) -> DataFrame:
    """The first node of that label, depth first; no row where there is none."""
    return first_paths(nodes).where(F.col("label") == label)


def first_paths(nodes: DataFrame) -> DataFrame:
    """(label, node_id, path) of every label's first node, depth first by the nodes' ordinals: what a label stands for in a lookup."""
    placed = nodes.select("node_id", "parent_id", F.struct(F.coalesce("ordinal", F.lit(0)).alias("o"), F.col("node_id").cast("string").alias("n")).alias("at"))
    order = paths(nodes.select("node_id", "parent_id", F.col("label")))
    keyed = _order_keys(placed)
    w = Window.partitionBy("label").orderBy("key")
    found = order.join(keyed, "node_id").withColumn("__n", F.row_number().over(w)).where("__n = 1")
    return found.select("label", "node_id", "path")


def _order_keys(placed: DataFrame) -> DataFrame:
    """(node_id, key): arrays that sort as a walk depth first."""
    level = placed.where("parent_id is null").select("node_id", F.array("at").alias("key"))
    out = level
    while True:
        up = level.select(F.col("node_id").alias("up_id"), F.col("key").alias("up"))
        level = settle(placed.join(up, placed.parent_id == up.up_id).select("node_id", F.concat("up", F.array("at")).alias("key")), "tree-order")
        if level.isEmpty():
            return out
        out = out.unionByName(level)


def insert_between(nodes: DataFrame, node_id, label: str, parent_id, child_id) -> DataFrame:
    """A new node above ``child_id``, if that is a direct child of ``parent_id``; else ``nodes`` as they are."""
    if nodes.where((F.col("node_id") == child_id) & (F.col("parent_id") == parent_id)).isEmpty():
        return nodes
    moved = nodes.withColumn("parent_id", F.when(F.col("node_id") == child_id, F.lit(node_id)).otherwise(F.col("parent_id")))
    place = nodes.where(F.col("node_id") == child_id).select(F.lit(node_id).alias("node_id"), F.lit(parent_id).alias("parent_id"), F.lit(label).alias("label"), "ordinal")
    return moved.unionByName(place)


def visualize(nodes: DataFrame) -> str:
    """The tree as indented lines. Label trees are small metadata and are drawn on the driver."""
    rows = paths(nodes).join(_order_keys(nodes.select("node_id", "parent_id", F.struct(F.coalesce("ordinal", F.lit(0)).alias("o"), F.col("node_id").cast("string").alias("n")).alias("at"))), "node_id").orderBy("key")
    return "\n".join("  " * r.depth + "- " + r.label for r in rows.select("depth", "label").collect())


_COMMAND = re.compile(r"(?i)^\s*(add|delete|rename) node:\s*([^;]+?)\s*(?:;\s*parent:\s*([^;]*?)\s*)?(?:;\s*child:\s*([^;]*?)\s*)?(?:;\s*original:\s*([^;]*?)\s*)?$")


def edit(nodes: DataFrame, command: str) -> tuple[DataFrame, str]:
    """The tree after one written command, and done, not found, not understood or finished.

    ``Add node: A``, ``Add node: A; Parent: B``, ``Add node: A; Parent: B; Child: C``,
    ``Delete node: A``, ``Rename node: B; Original: A`` and ``Finish``. Names are labels;
    of nodes with one label the first, depth first, is meant.
    """
    if command.strip().lower() == "finish":
        return nodes, "finished"
    got = _COMMAND.match(command)
    if not got or (got[1].lower() == "rename") != (got[5] is not None):
        return nodes, "not understood"
    verb, name, parent, child, original = got.groups()
    at = {r.label: r.node_id for r in first_paths(nodes).where(F.col("label").isin([x for x in (name, parent, child, original) if x])).collect()}
    if verb.lower() == "add":
        new = f"{name}-{nodes.count()}"
        kind = nodes.schema["node_id"].dataType.simpleString()
        if kind != "string":
            new = (nodes.agg(F.max("node_id")).first()[0] or 0) + 1
        if (parent and parent not in at) or (child and child not in at):
            return nodes, "not found"
        if child:
            after = insert_between(nodes, new, name, at[parent], at[child]) if parent else nodes
            return after, "not found" if after is nodes else "done"
        return add(nodes, new, at.get(parent) if parent else None, name), "done"
    target = original if verb.lower() == "rename" else name
    if target not in at:
        return nodes, "not found"
    return (rename(nodes, at[target], name) if original else remove(nodes, at[target])), "done"
