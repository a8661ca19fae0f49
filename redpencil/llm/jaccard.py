"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redpencil.llm.common import arrow_rows, by_bytes, small_batches, stored
from redpencil.llm.components import components

COUNTER_BITS = 20   # counters that order the shingles from rare to frequent
COUNTER_BLOCK = 1 << 12  # counters that travel as one row
COUNTER_PARTS = 8   # tasks that add the counters up
SUFFIX_PARTS = 32   # ranges of hash values that the suffix filter counts
TEXT_BYTES = 1 << 20  # texts that a worker turns into sets at a time
BLOCK = 200_000     # shingles of a component that meet another such block in one task, about
COLUMNS = 1 << 12   # distinct shingles that two blocks are compared by at a time
_GAPS = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, in order: A-Z lower-cased, cut at ASCII white space."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    gap = _GAPS[b]
    starts = np.flatnonzero(~gap & np.r_[True, gap[:-1]]) if len(b) else np.zeros(0, np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64)
    first = np.zeros(len(b), np.int64)
    first[starts] = starts
    place = (np.arange(len(b)) - np.maximum.accumulate(first)).astype(np.uint64)
    m = _mix((b.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + place * np.uint64(0xC2B2AE3D27D4EB4F))
    m[gap] = 0
    return _mix(np.add.reduceat(m, starts))


def shingles(text: str, words: int) -> np.ndarray:
    """The distinct hashed word n-grams of a text, sorted; a shorter text is one shingle, one without words none."""
    h = word_hashes(text)
    n = min(words, len(h))
    if n == 0:
        return h
    s = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        s = _mix(s * np.uint64(0xA0761D6478BD642F) + h[k:len(h) - n + 1 + k])
    return np.unique(s)


def _counter(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def _ceil(num: int, den: int) -> int:
    return -(-num // den)


def counters(texts: DataFrame, words: int) -> np.ndarray:
    """How many documents' shingles fall on each counter, over all rows.

    The table has a fixed number of counters (4 bytes each once broadcast). It only orders the
    shingles, rarest first; any order gives the same links, so counters that several shingles
    share cost time, not results.
    """
    def rows(blocks: dict[int, np.ndarray]) -> pa.RecordBatch:
        # the bytes of the counts by their place, so that the shuffle compresses the high ones, which are zeros, to nothing
        planes = [np.minimum(n, 2**31 - 1).astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes() for n in blocks.values()]
        return pa.RecordBatch.from_pydict({"block": pa.array(list(blocks), pa.int32()), "n": pa.array(planes, pa.binary())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTER_BITS, np.int64)
        for batch in by_bytes(batches):
            for text in batch.column(0).to_pylist():
                np.add.at(total, _counter(shingles(text, words)), 1)
        blocks = {k: n for k, n in enumerate(total.reshape(-1, COUNTER_BLOCK)) if n.any()}
        if blocks:
            yield rows(blocks)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, planes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total[k] = total.get(k, 0) + _counts(planes)
        if total:
            yield rows(total)

    # each task sends its counters as blocks of bytes, not as a row for each counter; the sums come to the driver the same way
    kind = "block int, n binary"
    found = texts.mapInArrow(count, kind).repartition(COUNTER_PARTS, "block").mapInArrow(added, kind).toLocalIterator()
    out = np.zeros(1 << COUNTER_BITS, np.int32)
    for row in found:
        out[row["block"] * COUNTER_BLOCK:(row["block"] + 1) * COUNTER_BLOCK] = _counts(row["n"])
    return out


def _counts(planes: bytes) -> np.ndarray:
    return np.frombuffer(planes, np.uint8).reshape(4, -1).T.copy().view("<i4").ravel().astype(np.int64)


def _joined(df: DataFrame, words: int, num: int, den: int, id_col: str, text_col: str, count: bool) -> DataFrame:
    """The join of :func:`_linked`, all steps of which run here, in small batches."""
    with small_batches(df.sparkSession):
        return _linked(df, words, num, den, id_col, text_col, count)


def _linked(df: DataFrame, words: int, num: int, den: int, id_col: str, text_col: str, count: bool) -> DataFrame:
    """Link documents whose shingle sets have intersection * den >= union * num, and join them into components.

    Returns a row for each document: id, a hash of its text, its set's size and key, the head of its
    component (the smallest id, then the smallest text hash) and, with ``count``, how many other documents it links to.

    Documents with equal sets are one node, found by a 128-bit hash of the set. Each node is listed
    under the rarest shingles of its set, as many as any partner must share one of. A pair becomes a
    candidate if the length filter and the positional filter hold at a common shingle; candidates
    must pass the suffix filter (shingles counted in ranges of hash values bound the overlap) and
    are verified once on whole sets. So that a group of near copies is not written out as all its
    pairs, the join runs in two rounds: first every node meets only the first node of each list,
    and the links found join into components; then, in lists that still hold several components,
    the nodes outside the list's largest one meet all nodes of the other components. Every pair
    the second round leaves out is inside a component already, so the components are exact, and the
    links inside each component can be counted afterwards without one row a link (:func:`_counted`).
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = spark.sparkContext.broadcast(counters(rows.select("text"), words))
    listed = T.StructType([T.StructField("id", kind), T.StructField("n", T.LongType()), T.StructField("key", T.BinaryType()),
                           T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("parts", T.ArrayType(T.IntegerType())),
                           T.StructField("uid", T.LongType()), T.StructField("text_key", T.LongType())])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        def made() -> Iterator[list[dict]]:
            uid = TaskContext.get().partitionId() << 40
            for batch in by_bytes(batches, TEXT_BYTES):
                out = []
                for key, text, text_key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    uid += 1
                    s = shingles(text, words)
                    m = len(s)
                    take = m - _ceil(num * m, den) + 1 if m else 0
                    rare = s[np.lexsort((s, order.value[_counter(s)]))[:take]]
                    parts = np.bincount((s >> np.uint64(59)).astype(np.int64), minlength=SUFFIX_PARTS)
                    out.append({"id": key, "n": m, "key": hashlib.md5(s.tobytes()).digest(), "prefix": rare.view(np.int64).tolist(),
                                "parts": parts.tolist(), "uid": uid, "text_key": text_key})
                yield out
        return arrow_rows(made(), listed)

    docs = stored(rows.withColumn("text_key", F.xxhash64("text")).mapInArrow(lists, listed), "sets")
    order.destroy()
    # a node is one distinct set; it is named by a row's number, since rows of unlike texts may repeat an id
    nodes = stored(docs.where("id is not null and n > 0").groupBy("key").agg(
        F.min("uid").alias("node"), F.min(F.struct("id", "text_key")).alias("own"), F.count("*").alias("docs"),
        F.min(F.struct("n", "prefix", "parts")).alias("s")).select("key", "node", "own", "docs", "s.*"), "nodes")
    posts = nodes.select("node", "n", F.col("own.id").alias("id"), F.posexplode("prefix").alias("at", "token"))
    several = posts.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    posts = stored(posts.join(several, "token"), "postings")

    # lengths, then what can still be shared from the common shingle on
    may = (f"least(n, n2) * {den} >= greatest(n, n2) * {num} and "
           f"(1 + least(n - at - 1, n2 - at2 - 1)) * {num + den} >= (n + n2) * {num}")
    # the first node of a list is the one with the smallest id, which is the first of the same nodes in all their lists
    firsts = posts.groupBy("token").agg(F.min(F.struct("id", "node", "n", "at")).alias("f")).select(
        "token", F.col("f.node").alias("node2"), F.col("f.n").alias("n2"), F.col("f.at").alias("at2"))
    star = posts.join(firsts, "token").where(f"node <> node2 and {may}")
    pair = [F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")]
    links = _verified(rows, nodes, star.select(*pair).distinct(), words, num, den)
    hung = components(links)

    labelled = stored(posts.drop("id").join(hung, "node", "left").withColumn("component", F.coalesce("component", "node")), "labelled")
    share = labelled.groupBy("token", "component").agg(F.count("*").alias("c"))
    mixed = share.groupBy("token").agg(F.max(F.struct("c", "component")).alias("top"), F.count("*").alias("k")).where("k > 1").select(
        "token", F.col("top.component").alias("top"))
    # lists of one component are done; elsewhere the nodes outside the largest one look for partners
    open_ = stored(labelled.join(mixed, "token"), "open")
    other = open_.select("token", *[F.col(c).alias(f"{c}2") for c in ("node", "n", "at", "component")])
    rest = open_.where("component <> top").join(other, "token").where(
        f"component <> component2 and (component2 = top or node < node2) and {may}")
    more = _verified(rows, nodes, rest.select(*pair).distinct(), words, num, den)
    links = stored(links.unionByName(more), "links")
    final = components(links)
    links = F.lit(0).cast("long")
    if count:
        members = stored(final.join(nodes.select("node", "key", "own", "docs", "n"), "node"), "members")
        final = stored(members.select("node", "component").join(_counted(rows, members, words, num, den), "node", "left"), "linked")
        links = F.coalesce("links", links) + F.col("docs") - 1  # those of other sets, and its copies
    joined = nodes.select("key", "node", "own", "docs").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    joined = stored(joined.select("key", "own", "component", links.alias("n_links")), "joined")
    names = joined.groupBy("component").agg(F.min("own").alias("head"))
    settled = stored(joined.join(names, "component").select("key", "head", "n_links"), "settled")
    return docs.select("id", "text_key", "n", "key").join(settled, "key", "left")


def jaccard_components(df: DataFrame, words: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """One row for each document (and distinct set, where an id repeats), see :func:`_linked`.

    Returns id, n_shingles, component_id (the smallest id reachable by links) and n_links (how many other
    documents, copies included, it links to; rows that repeat an id count as documents).

    Defined cases: null and wordless texts have an empty set, link with nothing and are their own
    component; a row without an id gets a null component and links with nothing; rows that repeat
    an id give one output row for each distinct set, in their own set's component; an empty table
    gives no rows.
    """
    met = _joined(df, words, num, den, id_col, text_col, count=True).select("id", "n", "key", "head", "n_links").distinct()
    linked = (F.col("n") > 0) & F.col("id").isNotNull()
    return met.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.when(linked, F.col("head.id")).otherwise(F.col("id")).alias("component_id"),
                      F.when(linked, F.col("n_links")).otherwise(0).alias("n_links"))


def _texts(rows: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, text): a text of each of the nodes (node, key, id)."""
    key = stored(wanted, "needed")
    need = stored(key.select("id").distinct(), "needed-ids")
    kind = rows.schema["id"].dataType
    whole = T.StructType([T.StructField("id", kind), T.StructField("key", T.BinaryType()), T.StructField("text", T.StringType())])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[list[dict]]:
            for batch in by_bytes(batches, TEXT_BYTES):
                yield [{"id": k, "key": hashlib.md5(shingles(t, words).tobytes()).digest(), "text": t}
                       for k, t in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        return arrow_rows(made(), whole)

    # the texts stay where they are while Spark can broadcast the ids that are needed; pairs then meet
    # the texts, which are smaller than their sets, and each text is shingled where it is compared
    found = rows.join(need, "id", "left_semi").select("id", "text").mapInArrow(keyed, whole)
    return stored(found.join(key, ["id", "key"]).dropDuplicates(["node"]).select("node", "text"), "texts")


def linked_rows(one: list[np.ndarray], two: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Which sets of the one list link with which of the other, as a matrix of booleans."""
    shared = np.zeros((len(one), len(two)), np.float32)
    every, at = np.unique(np.concatenate([*one, *two]), return_inverse=True)
    row = np.repeat(np.arange(len(one) + len(two)), [len(s) for s in (*one, *two)])
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    for low in range(0, len(every), COLUMNS):
        some = slice(*np.searchsorted(at, [low, low + COLUMNS]))
        m = np.zeros((len(one) + len(two), min(COLUMNS, len(every) - low)), np.float32)
        m[row[some], at[some] - low] = 1
        shared += m[:len(one)] @ m[len(one):].T
    shared = shared.astype(np.int64)
    n_one, n_two = (np.array([len(s) for s in x], np.int64) for x in (one, two))
    return shared * den >= (n_one[:, None] + n_two[None, :] - shared) * num


def _counted(rows: DataFrame, members: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(node, links): documents of other sets that a node's set links to, for the nodes of components of several.

    ``members``: node, key, own, docs, n, component. All links of a node are inside its component. A
    component's nodes are dealt into blocks of about ``BLOCK`` shingles and every two blocks meet in one
    group, where the shared shingles of all their sets are one product of matrices; so the time goes
    with the square of a component, as the number of its links does, but rows and memory do not.
    """
    wide = members.groupBy("component").agg(F.count("*").alias("k"), F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks")).where("k > 1")
    inside = stored(members.join(wide.drop("k"), "component").select(
        "node", "key", F.col("own.id").alias("id"), "docs", "component", "blocks",
        F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")), "inside")
    text = _texts(rows, inside.select("node", "key", "id"), words)
    dealt = inside.join(text, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "docs", "text")

    def count(group: pa.Table) -> pa.Table:
        block, node, docs = (group.column(k).to_numpy() for k in ("block", "node", "docs"))
        sets = [shingles(t, words) for t in group.column("text").to_pylist()]
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        a, b = np.flatnonzero(block == low), np.flatnonzero(block == high)
        links = np.zeros(len(sets), np.int64)
        if len(a) and len(b):
            met = linked_rows([sets[k] for k in a], [sets[k] for k in b], num, den)
            if low == high:
                np.fill_diagonal(met, False)
            else:
                links[b] = docs[a] @ met
            links[a] = met @ docs[b]
        return pa.table({"node": node, "links": links})

    return dealt.groupBy("component", "low", "high").applyInArrow(count, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def _verified(rows: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are alike enough: suffix filter, then one comparison each."""
    one = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("parts").alias("parts_a"))
    two = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("parts").alias("parts_b"))
    apart = F.aggregate(F.zip_with("parts_a", "parts_b", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, v: s + v)
    # union >= intersection + what differs in each range; the rest follows from the threshold
    kept = stored(pairs.join(one, "a").join(two, "b").where(
        (F.col("n_a") + F.col("n_b") - apart) * (num + den) >= (F.col("n_a") + F.col("n_b")) * (2 * num)).select("a", "b"), "candidates")
    wanted = kept.select(F.col("a").alias("node")).union(kept.select(F.col("b").alias("node"))).distinct()
    found = _texts(rows, nodes.select("node", "key", F.col("own.id").alias("id")).join(wanted, "node"), words)
    both = kept.join(found.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(
        found.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    out = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[list[dict]]:
            last, x = None, None
            for batch in by_bytes(batches, TEXT_BYTES):
                some = []
                for a, b, s, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if a != last:
                        last, x = a, shingles(s, words)
                    y = shingles(t, words)
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    if shared * den >= (len(x) + len(y) - shared) * num:
                        some.append({"a": a, "b": b})
                yield some
        return arrow_rows(made(), out)

    return stored(both.select("a", "b", "text_a", "text_b").mapInArrow(compare, out), "verified")


def keep_representatives(df: DataFrame, words: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """One document of each component stays, the one with the smallest id, with all columns of the input.

    Documents without words or without an id stay. Rows that repeat an id are judged by their own
    texts; rows that repeat both stay or go together.
    """
    joined = _joined(df, words, num, den, id_col, text_col, count=False)
    other = F.struct("id", "text_key") != F.col("head")
    gone = joined.where((F.col("n") > 0) & F.col("id").isNotNull() & other).select(
        F.col("id").alias("__gone"), F.col("text_key").alias("__text")).distinct()
    same = (F.col(id_col) == F.col("__gone")) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("__text"))
    return df.join(gone, same, "left_anti")
