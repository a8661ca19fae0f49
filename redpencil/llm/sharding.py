"""Hilbert-curve sharding: rows near each other in several metadata dimensions share a shard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from redpencil.llm.common import stored


def _number(df: DataFrame, name: str) -> Column:
    """A number that keeps the order of a column: numbers and times as they are, strings by their first six bytes."""
    c, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return F.conv(F.rpad(F.substring(F.hex(c.cast("binary")), 1, 12), 12, "0"), 16, 10).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return c.cast("timestamp").cast("double")
    return c.cast("double")


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """Position on the Hilbert curve of a cell with ``bits`` bits in each dimension.

    One fold over the bit levels, highest first: the state holds the index so far, the entry
    corner and the direction of the current sub-cube (Hamilton's compact formulation).
    """
    n = len(cells)
    if n * bits > 62:
        raise ValueError("dimensions times bits must fit a long")
    gray = [w ^ (w >> 1) for w in range(1 << n)]
    trailing = [len(bin(w)) - len(bin(w).rstrip("1")) for w in range(1 << n)]
    rank = F.array(*[F.lit(gray.index(g)) for g in range(1 << n)])
    entry = F.array(*[F.lit(0 if w == 0 else gray[2 * ((w - 1) // 2)]) for w in range(1 << n)])
    turn = F.array(*[F.lit(0 if w == 0 else trailing[w - 1 if w % 2 == 0 else w] % n) for w in range(1 << n)])
    mask = (1 << n) - 1

    def corner(b: Column) -> Column:
        at = F.lit(0)
        for k, c in enumerate(cells):
            at = at.bitwiseOR(F.shiftleft(F.call_function("shiftright", c, b).bitwiseAND(1), k))
        return at

    def roll(v: Column, by: Column) -> Column:
        """Rotate the n bits of v to the left by ``by`` (0 to n)."""
        wide = F.call_function("shiftleft", v, by)
        return wide.bitwiseOR(F.call_function("shiftright", v, F.lit(n) - by)).bitwiseAND(mask)

    def step(at: Column, here: Column) -> Column:
        w = F.element_at(rank, roll(here.bitwiseXOR(at["e"]), F.lit(n - 1) - at["d"]) + 1)
        return F.struct(
            F.shiftleft(at["h"], n).bitwiseOR(w.cast("long")).alias("h"),
            at["e"].bitwiseXOR(roll(F.element_at(entry, w + 1), at["d"] + 1)).alias("e"),
            ((at["d"] + F.element_at(turn, w + 1) + 1) % n).cast("int").alias("d"))

    levels = F.transform(F.array(*[F.lit(b) for b in range(bits - 1, -1, -1)]), corner)
    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("e"), F.lit(0).alias("d"))
    return F.aggregate(levels, start, step)["h"]


def quantise(df: DataFrame, dims: list[str], bits: int) -> DataFrame:
    """Add a cell number 0 .. 2^bits - 1 for each dimension, cut at its quantiles over all rows.

    The cut points are the only thing that reaches the driver: 2^bits - 1 numbers a dimension.
    A null goes to cell 0; a value that fills several quantiles takes the highest of them.
    """
    parts = 1 << bits
    shares = [k / parts for k in range(1, parts)]
    cuts = df.agg(*[F.percentile_approx(_number(df, d), shares).alias(f"c{i}") for i, d in enumerate(dims)]).first()
    for i, d in enumerate(dims):
        below = F.lit(0)
        for cut in cuts[i] or []:
            below = below + F.when(_number(df, d) >= cut, 1).otherwise(0)
        df = df.withColumn(f"__cell{i}", below)
    return df


def hilbert_shards(df: DataFrame, shards: int, dims: list[str], size_col: str, id_col: str = "doc_id",
                   law: str = "rows", bits: int = 4, carry: list[str] | None = None,
                   partitions: int | None = None) -> DataFrame:
    """Deal rows into ``shards`` runs of the Hilbert curve over ``dims``.

    ``law``: ``rows`` (counts differ by at most one) or ``bytes`` (a run ends where the running
    size passes its share; a row belongs to the run that holds its first byte). Returns id,
    size, the columns named in ``carry``, curve, position, shard, slot and the cells ``__cell*``.

    The narrow rows are range-partitioned by (curve, id) once and stored in that order; rank and
    running size are the offsets of the partitions (one row each) plus the place inside them, so
    neither a hot cell nor a shard has to pass through one task.

    Defined cases: null in a dimension is cell 0; null sizes count 0; a null id comes first in
    its cell; rows that repeat an id are all dealt, in any order among themselves; an empty table
    gives no rows; with fewer rows than shards the last shards may stay empty.
    """
    if law not in ("rows", "bytes"):
        raise ValueError("law is rows or bytes")
    spark = df.sparkSession
    cells = [f"__cell{i}" for i in range(len(dims))]
    carried = [F.col(f"`{c}`").alias(f"__carry{i}") for i, c in enumerate(carry or [])]
    curve = hilbert_index([F.col(c) for c in cells], bits)
    narrow = quantise(df, dims, bits).select(
        F.col(id_col).alias("id"), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("size"),
        curve.alias("curve"), *cells, *carried)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = narrow.repartitionByRange(n, "curve", "id").sortWithinPartitions("curve", "id")
    inside = Window.partitionBy("part").orderBy("place")
    place = F.monotonically_increasing_id()
    kept = stored(ordered.withColumn("at", place).select(
        "*", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("place")), "curve")
    parts = kept.groupBy("part").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = parts.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("row0"),
                          F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte0"))
    total = kept.agg(F.count("*").alias("n"), F.sum("size").alias("b")).first()
    met = kept.join(F.broadcast(starts), "part").withColumn("position", F.col("row0") + F.col("place"))
    if law == "rows":
        met = met.withColumn("shard", F.expr(f"int(position * {shards} div {max(total['n'], 1)})"))
        met = met.withColumn("slot", F.expr(f"position - (shard * {total['n']}L + {shards - 1}) div {shards}"))
    else:
        running = F.col("byte0") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
        met = met.withColumn("__run", running).withColumn(
            "shard", F.expr(f"int(least(__run * {shards} div {max(total['b'] or 0, 1)}, {shards - 1}))"))
        first = met.groupBy("shard").agg(F.min("position").alias("first"))  # one row for each shard
        met = met.join(F.broadcast(first), "shard").withColumn("slot", F.col("position") - F.col("first"))
    return met.select(F.col("id").alias(id_col), "size", *[F.col(f"__carry{i}").alias(c) for i, c in enumerate(carry or [])],
                      "curve", "position", "shard", "slot", *cells)


def write_shards(df: DataFrame, dealt: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write the rows as one folder a shard, in curve order, so that readers skip files by their column ranges."""
    places = dealt.select(F.col(id_col).alias("__id"), "shard", "position")
    met = df.join(places, F.col(id_col).eqNullSafe(F.col("__id"))).drop("__id")
    (met.repartitionByRange("shard", "position").sortWithinPartitions("shard", "position").drop("position")
     .write.partitionBy("shard").parquet(path))
