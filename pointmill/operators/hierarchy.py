"""Joins and aggregates over the table of nodes (level, x, y, z, point_count)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["level", "x", "y", "z"]


def half(c: str | Column) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / 2)


def with_parent(nodes: DataFrame) -> DataFrame:
    """Adds (plevel, px, py, pz); null for the root."""
    below = F.col("level") > 0
    return nodes.withColumns({"plevel": F.when(below, F.col("level") - 1)} | {f"p{a}": F.when(below, half(a)) for a in "xyz"})


def child_digit() -> Column:
    """4, 2, 1 for an odd x, y, z."""
    return (F.pmod("x", F.lit(2)) * 4 + F.pmod("y", F.lit(2)) * 2 + F.pmod("z", F.lit(2))).cast("long")


def child_parent(nodes: DataFrame) -> DataFrame:
    """Each node that has its parent in the table, with the parent's key and count."""
    kids = with_parent(nodes)
    parents = nodes.select(*[F.col(c).alias("p" + c) for c in KEY], F.col("point_count").alias("parent_points"))
    return kids.join(parents, ["plevel", "px", "py", "pz"])


def lines_of_descent(nodes: DataFrame) -> DataFrame:
    """Every node with each of its ancestors and itself: (alevel, ax, ay, az) and the node's columns."""
    up = F.sequence(F.lit(0).cast("long"), F.col("level"))
    exploded = nodes.withColumn("alevel", F.explode(up))
    return exploded.withColumns({f"a{a}": F.floor(F.col(a) / F.pow(F.lit(2.0), F.col("level") - F.col("alevel"))) for a in "xyz"})


def missing_ancestors(nodes: DataFrame) -> DataFrame:
    """Keys of ancestors that the table lacks."""
    over = lines_of_descent(nodes).select(*[F.col("a" + c).alias(c) for c in KEY]).distinct()
    return over.join(nodes.select(*KEY), KEY, "left_anti")


def closed(nodes: DataFrame) -> DataFrame:
    """The table with its missing ancestors as nodes without points."""
    return nodes.select(*KEY, "point_count").unionByName(missing_ancestors(nodes).withColumn("point_count", F.lit(0).cast("long")))


def subtree_sizes(nodes: DataFrame) -> DataFrame:
    """Nodes and points at or below each node of the table."""
    sums = lines_of_descent(nodes).groupBy(*[F.col("a" + c).alias(c) for c in KEY]).agg(F.count("*").alias("subtree_nodes"), F.sum("point_count").alias("subtree_points"))
    return sums.join(nodes.select(*KEY), KEY, "left_semi")


def child_masks(nodes: DataFrame) -> DataFrame:
    """Per parent key, the bits of its children."""
    bit = F.pow(F.lit(2.0), child_digit()).cast("long")
    return with_parent(nodes).filter("level > 0").groupBy(*[F.col(f"p{c}").alias(c) for c in KEY]).agg(F.bit_or(bit).alias("child_mask"))


def with_points_below(nodes: DataFrame) -> DataFrame:
    """Nodes that have points themselves or below."""
    live = lines_of_descent(nodes.filter("point_count > 0")).select(*[F.col("a" + c).alias(c) for c in KEY]).distinct()
    return nodes.join(live, KEY, "left_semi")


def by_level(nodes: DataFrame) -> DataFrame:
    """Nodes and points of every level from 0 to the deepest, gaps included."""
    sums = nodes.groupBy("level").agg(F.count("*").alias("nodes"), F.sum("point_count").alias("points"))
    levels = nodes.agg(F.max("level").alias("d")).select(F.explode(F.sequence(F.lit(0).cast("long"), "d")).alias("level"))
    return levels.join(sums, "level", "left").select("level", F.coalesce("nodes", F.lit(0)).cast("long").alias("nodes"), F.coalesce("points", F.lit(0)).cast("long").alias("points"))


def statistics(nodes: DataFrame) -> DataFrame:
    """One row: nodes, depth, total points, largest node, arrays of nodes and points by level."""
    levels = by_level(nodes).agg(F.sort_array(F.collect_list(F.struct("level", "nodes", "points"))).alias("l"))
    whole = nodes.agg(F.count("*").alias("nodes"), F.max("level").alias("depth"), F.sum("point_count").alias("points"), F.max("point_count").alias("largest"))
    return whole.crossJoin(F.broadcast(levels)).select("nodes", "depth", "points", "largest", F.col("l.nodes").alias("nodes_by_level"), F.col("l.points").alias("points_by_level"))


def offsets(nodes: DataFrame, stride: int, order: list[str]) -> DataFrame:
    """Byte sizes, and the offset of each node when all are written in order.

    The running sum is over blocks of nodes of one level first, then over the blocks' totals, so no task sees all nodes.
    """
    sized = nodes.withColumn("byte_size", F.col("point_count") * stride).withColumn("block", F.floor(F.col(order[1]) / 8))
    inside = Window.partitionBy(order[0], "block").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy(order[0], "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sized.groupBy(order[0], "block").agg(F.sum("byte_size").alias("total")).withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0)).cast("long")).drop("total")
    placed = sized.withColumn("inner", F.coalesce(F.sum("byte_size").over(inside), F.lit(0)))
    return placed.join(blocks, [order[0], "block"]).withColumn("byte_offset", (F.col("base") + F.col("inner")).cast("long")).drop("block", "inner", "base")


def differences(one: DataFrame, other: DataFrame) -> DataFrame:
    """Nodes that only one table has, or that differ in their count."""
    a = one.select(*KEY, F.col("point_count").alias("left_points"))
    b = other.select(*KEY, F.col("point_count").alias("right_points"))
    return a.join(b, KEY, "full_outer").filter(~F.col("left_points").eqNullSafe(F.col("right_points")))
