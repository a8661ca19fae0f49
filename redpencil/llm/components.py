"""Connected components of links between rows, without bringing the links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redpencil.llm.common import stored


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for each node of the links (a, b); component is the smallest node reached.

    Alternating large-star and small-star steps: every node hangs its larger neighbours, then its
    smaller ones, onto the smallest node it sees, until nothing moves. Each step is one grouping
    and one join on narrow rows, stored in the shared folder; a chain of n links needs about
    log n rounds. A node with very many links is counted before it is shuffled (min), and its
    rows are split by the join's skew handling, never gathered into a list.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    now = _seen(edges)
    for _ in range(rounds):
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.join(low, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                                               F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = stored(small.select("e.*").where("u <> v").distinct(), "edges")
        edges, before, now = after, now, _seen(after)
        if now == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _seen(edges: DataFrame) -> tuple:
    """Number of edges and a digest of them, to tell whether a step changed anything."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first())
