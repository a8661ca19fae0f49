"""Groups of rows whose texts contain each other, found without comparing every pair."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redpencil.functions.exprs import fresh
from redpencil.session import shared_folder

GRAM = 4


def kept_rows(df: DataFrame, name: str) -> DataFrame:
    """Written once to the shared folder and read back, so that a lost executor costs only its tasks."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _grams(text: str, sizes: str) -> str:
    n, i = fresh("n"), fresh("i")
    return (f"array_distinct(concat(array(''), flatten(transform({sizes}, {n} -> if(length({text}) < {n}, cast(array() as array<string>), "
            f"transform(sequence(1, length({text}) - {n} + 1), {i} -> substring({text}, {i}, {n})))))))")


def containing_pairs(nodes: DataFrame, block: list[str], text: str, node: str = "node") -> DataFrame:
    """(a, b): pairs of nodes of a block where the text of ``a`` contains that of ``b``.

    A text that is contained must have its rarest run of ``GRAM`` letters (all of it, if it is shorter)
    in the other one; the two meet by that run and are compared once.

    Texts and numbers of nodes compress so well that the size of their files says little about the rows,
    and a list of runs is far larger than its text: joins of nodes are merges, so that no side is gathered
    in the driver to be sent to all.
    """
    sizes = f"sequence(1, {GRAM})"
    held = nodes.select(*block, node, text, F.explode(F.expr(_grams(text, sizes))).alias("gram"))
    n = f"least(length({text}), {GRAM})"
    own = nodes.select(*block, node, text, F.explode(F.expr(f"if(length({text}) = 0, array(''), {_grams(text, f'array({n})')})")).alias("gram")).where(
        f"length(gram) = {n}")
    count = held.groupBy(*block, "gram").agg(F.count(F.lit(1)).alias("n"))
    rare = own.join(count.hint("merge"), [*block, "gram"]).groupBy(*block, node, text).agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    inner = rare.select(*block, "gram", F.col(node).alias("b"), F.col(text).alias("_inner"))
    met = held.withColumnRenamed(node, "a").join(inner.hint("merge"), [*block, "gram"])
    return met.where(f"a <> b and contains({text}, _inner)").select("a", "b")


def connected(nodes: DataFrame, pairs: DataFrame, node: str = "node", rounds: int = 200) -> DataFrame:
    """(node, group): ``group`` is the smallest node that pairs reach; nodes without pairs are their own.

    Each round takes the smallest group of the neighbours and then the group of that group, so a
    chain shortens by half; labels are counted down before they are shuffled. Nodes without pairs stay out of the rounds.
    """
    edges = kept_rows(pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = kept_rows(edges.select(F.col("a").alias("node")).distinct().withColumn("group", F.col("node")), "labels")
    for _ in range(rounds):
        near = edges.join(labels.hint("merge"), edges["b"] == labels["node"]).groupBy("a").agg(F.min("group").alias("m"))
        low = labels.join(near.hint("merge"), labels["node"] == near["a"], "left").select("node", "group", F.least("group", F.coalesce("m", "group")).alias("new"))
        low = kept_rows(low, "labels")
        up = low.select(F.col("node").alias("k"), F.col("new").alias("up"))
        after = kept_rows(low.join(up.hint("merge"), low["new"] == up["k"]).select("node", "group", F.least("new", "up").alias("new")), "labels")
        moved = after.where(F.col("group") != F.col("new")).limit(1).count()
        labels = after.select("node", F.col("new").alias("group"))
        if not moved:
            joined = labels.select(F.col("node").alias("_node"), "group")
            return nodes.select(F.col(node)).join(joined.hint("merge"), F.col(node) == F.col("_node"), "left").select(
                node, F.coalesce("group", node).alias("group"))
    raise RuntimeError(f"groups did not settle in {rounds} rounds")
