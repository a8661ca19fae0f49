"""Mixing sources to target weights: hierarchical token budgets and seeded prefixes of epochs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from redpencil.llm.common import stored

MAX_LEAVES = 100_000    # a tree beyond this is refused: it comes to the driver
BUCKET_ROWS = 4_096     # rows of a leaf that are put in order together, on average
_RING = 1 << 40


def words_of(text: Column) -> Column:
    """Tokens of a text for the budgets: its runs of non-spaces."""
    bare = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(bare == "", 0).otherwise(F.length(bare) - F.length(F.replace(bare, F.lit(" "), F.lit(""))) + 1).cast("long")


def first_words(text: Column, n: Column) -> Column:
    """The text up to its n-th token."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"\s*\S+"), F.lit(0)), F.lit(1), n.cast("int")), "")


def water_fill(budget: float, weights: list[float], room: list[float]) -> list[float]:
    """Split a budget by weights, but give no child more than its room; what is left over goes to its siblings by weight."""
    given, open_ = [0.0] * len(weights), [k for k, w in enumerate(weights) if w > 0 and room[k] > 0]
    left = min(budget, sum(room[k] for k in open_))
    while open_ and left > 1e-9:
        total = sum(weights[k] for k in open_)
        full = [k for k in open_ if left * weights[k] / total >= room[k]]
        if not full:
            for k in open_:
                given[k] = left * weights[k] / total
            break
        for k in full:
            given[k] = room[k]
        left -= sum(room[k] for k in full)
        open_ = [k for k in open_ if k not in set(full)]
    return given


def budgets(leaves: dict[tuple, float], weight: Callable[[tuple], float], total: float) -> dict[tuple, int]:
    """Whole-token budget of each leaf of the tree that the leaves' paths spell.

    ``leaves`` has each leaf's capacity, ``weight`` the weight of a node by its path, against its
    siblings. A node can take what the leaves below it can; what it cannot take is shared by its
    siblings first, and only what they cannot take either goes back to its parent's siblings.
    """
    children: dict[tuple, list[tuple]] = {}
    room: dict[tuple, float] = {}
    for path in sorted(leaves):
        for depth in range(len(path) + 1):
            room[path[:depth]] = room.get(path[:depth], 0.0) + (leaves[path] if all(weight(path[:d + 1]) > 0 for d in range(len(path))) else 0.0)
            if depth and path[:depth] not in children.setdefault(path[:depth - 1], []):
                children[path[:depth - 1]].append(path[:depth])
    share: dict[tuple, float] = {(): min(float(total), room.get((), 0.0))}
    for node in sorted(children, key=len):
        for child, amount in zip(children[node], water_fill(share.get(node, 0.0), [weight(c) for c in children[node]],
                                                            [room[c] for c in children[node]]), strict=True):
            share[child] = amount
    whole = {path: int(share[path] + 1e-6) for path in leaves}
    spare = int(share[()] + 1e-6) - sum(whole.values())
    # the tokens lost in rounding go to the leaves that lost most
    for path in sorted(leaves, key=lambda p: (whole[p] - share[p], p)):
        if spare > 0 and whole[path] < leaves[path] and share[path] > 0:
            whole[path], spare = whole[path] + 1, spare - 1
    return whole


def mix(df: DataFrame, levels: dict[str, Column], weight: Callable[[tuple], float], total_tokens: int | None = None, max_epochs: int = 4,
        seed: int = 17, id_col: str = "doc_id", text_col: str = "text", tokens: Callable[[Column], Column] = words_of) -> DataFrame:
    """Select documents so that the tokens of a tree of sources follow its weights.

    ``levels``: the columns that spell a document's path, outermost first (say domain, language,
    source). ``weight`` gives a node's weight by its path. ``total_tokens`` defaults to all there
    are. A leaf can give each document at most ``max_epochs`` times.

    A leaf whose budget is e times its tokens and r more gives every document in e epochs, then
    the first r tokens of epoch e in its seeded order; the document at the cut is taken in part.
    Returns the input's columns with mix_path (array), epoch, tokens and taken (tokens taken; the
    text itself is left whole, see ``cut_texts``).

    Leaf totals are the only thing that reaches the driver. The order inside a leaf is cut into
    buckets of about BUCKET_ROWS rows; token sums of the buckets show in which one a leaf's
    prefix ends, and only that bucket's rows are sorted, so a leaf with a third of all rows
    needs no task for itself.

    Defined cases: a null in a level counts as the empty name; null and empty texts have no
    tokens and come with the full epochs and with the buckets before the cut; a leaf without
    tokens gives none; weights of 0 or less exclude a node; rows that repeat an id share its
    place in the order and count each; an empty table gives no rows.
    """
    names = df.columns
    path = F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in levels.values()])
    rows = df.withColumn("__path", path).withColumn("__tokens", tokens(F.col(text_col)))
    stats = rows.groupBy("__path").agg(F.count("*").alias("rows"), F.sum("__tokens").alias("tokens")).limit(MAX_LEAVES + 1).collect()
    if len(stats) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves")
    supply = {tuple(r["__path"]): int(r["tokens"]) for r in stats}
    goal = budgets({p: n * max_epochs for p, n in supply.items()}, weight, sum(supply.values()) if total_tokens is None else total_tokens)
    plan = [(k, list(p), goal[p] // supply[p] if supply[p] else 0, goal[p] % supply[p] if supply[p] else 0, max(1, -(-r["rows"] // BUCKET_ROWS)))
            for k, r in enumerate(stats) for p in [tuple(r["__path"])]]
    spark = df.sparkSession
    leaves = spark.createDataFrame(plan, "__leaf int, __leaf_path array<string>, __full long, __rest long, __buckets long")
    rows = rows.join(F.broadcast(leaves), F.col("__path") == F.col("__leaf_path"))  # at most MAX_LEAVES rows
    key = F.pmod(F.xxhash64(F.lit(seed), F.col("__full"), F.col(id_col).cast("string")), F.lit(_RING))
    rows = rows.withColumn("__key", key).withColumn("__bucket", F.expr(f"__key * __buckets div {_RING}L"))

    sums = rows.where("__rest > 0").groupBy("__leaf", "__bucket").agg(F.sum("__tokens").alias("__sum"), F.first("__rest").alias("__rest"))
    inside = Window.partitionBy("__leaf").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(inside), F.lit(0)))
    cuts = stored(before.where("__before < __rest and __before + __sum >= __rest").groupBy("__leaf").agg(
        F.min(F.struct("__bucket", "__before")).alias("c")).select("__leaf", F.col("c.__bucket").alias("__cut"), F.col("c.__before").alias("__before")), "cuts")
    rows = rows.join(F.broadcast(cuts), "__leaf", "left")  # one row for each leaf at most

    everything = rows.where("__full > 0").withColumn("__epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__full") - 1))).withColumn(
        "__taken", F.col("__tokens"))
    ahead = rows.where("__bucket < __cut").withColumn("__epoch", F.col("__full")).withColumn("__taken", F.col("__tokens"))
    order = Window.partitionBy("__leaf").orderBy("__key", F.col(id_col)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_cut = (rows.where("__bucket = __cut").withColumn("__start", F.col("__before") + F.sum("__tokens").over(order) - F.col("__tokens"))
              .where("__start < __rest").withColumn("__epoch", F.col("__full")).withColumn("__taken", F.least("__tokens", F.col("__rest") - F.col("__start"))))
    out = [F.col(f"`{c}`") for c in names if c not in ("mix_path", "epoch", "tokens", "taken")] + [
        F.col("__path").alias("mix_path"), F.col("__epoch").cast("int").alias("epoch"), F.col("__tokens").alias("tokens"), F.col("__taken").alias("taken")]
    return everything.select(*out).unionByName(ahead.select(*out)).unionByName(at_cut.select(*out))


def cut_texts(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """Cut the texts that are taken in part; all others stay as they are."""
    part = F.col("taken") < F.col("tokens")
    return mixed.withColumn(text_col, F.when(part, first_words(F.col(text_col), F.col("taken"))).otherwise(F.col(text_col)))
