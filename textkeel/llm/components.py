"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to its least neighbour (or itself)."""
    near = _both(edges)
    least = near.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m"))
    return near.join(least, near["a"] == least["n"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
    moved = down.join(least, down["a"] == least["n"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select(F.col("n").alias("a"), F.col("m").alias("b"))
    return moved.union(own).filter("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the least node reachable.

    Nodes are 64-bit values; loops are ignored; repeated edges count once. Each
    round is a written table, so nothing is recomputed and nothing is collected.
    """
    now = scratch.save(f"{label}_0", edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark, round_ = None, 0
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == mark:
            break
        mark, round_ = state, round_ + 1
        now = scratch.save(f"{label}_{round_}", _small(_large(now)))
        if round_ > 1:
            scratch.drop(f"{label}_{round_ - 2}")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
