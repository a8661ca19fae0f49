"""Benchmark decontamination: an FM-index per shard of documents, searched for the phrases of test items."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redpencil.llm.common import arrow_rows, by_bytes, scratch, stored
from redpencil.llm.fm_index import FmIndex

SHARD_WORDS = 1 << 20  # words of a shard; a longer text is cut, its parts overlap by a phrase
BLOCK_PHRASES = 100_000  # phrases that one search carries to the shards
WORDS = 10
# Words are runs of digits, letters a-z and everything beyond ASCII, after A-Z are lower-cased
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """The words of a text, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class _Numbers(dict):
    """Numbers words in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def build_index(df: DataFrame, words_max: int = WORDS, id_col: str = "doc_id", text_col: str = "text",
                shard_words: int = SHARD_WORDS) -> DataFrame:
    """Index the whole texts, stored as one row a shard: its texts (``parts``) and the index bytes.

    A shard takes texts in order until it holds ``shard_words`` words. Texts beyond that are cut, and
    a part repeats the last ``words_max`` - 1 words of the one before, so that each phrase of up to
    ``words_max`` words lies whole in a part. The index serves any number of searches.
    """
    kind = df.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("parts", T.ArrayType(T.StructType([
            T.StructField("id", kind), *T.StructType.fromDDL("row long, first long, n_words long, text_key long").fields]))),
        T.StructField("index", T.BinaryType())])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40

        def made() -> Iterator[list[dict]]:
            nonlocal row
            known, parts, symbols, size = _Numbers(), [], [], 0

            def shard() -> list[dict]:
                flat = np.concatenate(symbols) if symbols else np.zeros(0, np.int64)
                built = FmIndex.build(flat, np.array([len(s) for s in symbols]), list(known))
                return [{"parts": parts, "index": built.to_bytes()}]

            for batch in by_bytes(batches):
                for key, text, text_key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    found = words(text)
                    row += 1
                    first = 0
                    while True:
                        some = found[first:first + shard_words]
                        if size and size + len(some) > shard_words:
                            yield shard()
                            known, parts, symbols, size = _Numbers(), [], [], 0
                        parts.append({"id": key, "row": row, "first": first, "n_words": len(found), "text_key": text_key})
                        symbols.append(np.fromiter(map(known.__getitem__, some), np.int64, len(some)))
                        size += len(some) + 1
                        if first + shard_words >= len(found):
                            break
                        first += shard_words - words_max + 1
            if parts:
                yield shard()
        return arrow_rows(made(), schema)

    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_key"))
    return stored(narrow.mapInArrow(index, schema), "fm-index")


def phrases(items: DataFrame, n: int = WORDS, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item (as string) and phrase: every ``n`` consecutive words of an item, or all of a shorter one."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w = words(text)
                out += [(item, b" ".join(w[k:k + n])) for k in range(max(1, len(w) - n + 1)) if w]
            yield pa.RecordBatch.from_pydict({"item": pa.array([i for i, _ in out], pa.string()),
                                              "phrase": pa.array([p for _, p in out], pa.binary())})

    return items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).mapInArrow(
        cut, "item string, phrase binary").distinct()


_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])
_HIT = T.StructType([T.StructField("row", T.LongType()), T.StructField("spans", T.ArrayType(_SPAN)),
                     T.StructField("items", T.ArrayType(T.StringType()))])


def _merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and touching spans made one."""
    turn = np.argsort(start, kind="stable")
    start, stop = start[turn], np.maximum.accumulate(stop[turn])
    opens = np.append(True, start[1:] > stop[:-1])
    return start[opens], stop[np.append(opens[1:], True)]


def _found(index: FmIndex, by_length: dict[int, list[list[bytes]]], owners: dict[int, list[list]], parts: list[dict]) -> list[dict]:
    """The texts of one shard that hold phrases: merged spans of words and the phrases' items."""
    text, start, stop, items = [], [], [], []
    for n, some in by_length.items():
        which, low, high = index.search(index.numbers(some))
        count = high - low
        rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        t, at = index.locate(rows)
        text.append(t)
        start.append(at)
        stop.append(at + n)
        # an item is noted once a text, however often its phrases stand there
        mine = [(i, w) for w, p in enumerate(which.tolist()) for i in owners[n][p]]
        begin = np.cumsum(count) - count
        items += [(x, i) for i, w in mine for x in np.unique(t[begin[w]:begin[w] + count[w]]).tolist()]
    text, start, stop = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (text, start, stop))
    if not len(text):
        return []
    turn = np.argsort(text, kind="stable")
    text, start, stop = text[turn], start[turn], stop[turn]
    held: dict[int, set] = {}
    for x, i in items:
        held.setdefault(x, set()).add(i)
    out = []
    for x, a, b in zip(*np.unique(text, return_index=True), np.append(np.flatnonzero(np.diff(text)) + 1, len(text)), strict=True):
        s, e = _merged(start[a:b], stop[a:b])
        first = parts[x]["first"]
        out.append({"row": parts[x]["row"], "items": list(held[x]),
                    "spans": [{"start": u + first, "stop": v + first} for u, v in zip(s.tolist(), e.tolist(), strict=True)]})
    return out


def search(index: DataFrame, wanted: DataFrame, block: int = BLOCK_PHRASES) -> DataFrame:
    """Find all ``phrases`` in the indexed texts: one row for each text, with id, text_key, n_words, spans and items.

    ``spans`` are merged ranges of words [start, stop); ``items`` the sorted items of the phrases that
    occur. The phrases visit the shards in blocks of ``block``, so neither the driver nor a task
    holds more of them at once, however many there are.
    """
    spark = index.sparkSession
    path = scratch(spark, "hits")
    spark.createDataFrame([], _HIT).write.parquet(path)

    def visit(some: list[tuple]) -> None:
        by_length: dict[int, list[list[bytes]]] = {}
        owners: dict[int, list[list]] = {}
        place: dict[bytes, tuple[int, int]] = {}
        for item, phrase in some:
            phrase = bytes(phrase)
            if phrase not in place:
                w = phrase.split(b" ")
                place[phrase] = (len(w), len(by_length.setdefault(len(w), [])))
                by_length[len(w)].append(w)
                owners.setdefault(len(w), []).append([])
            n, at = place[phrase]
            owners[n][at].append(item)
        carried = spark.sparkContext.broadcast((by_length, owners))

        def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def made() -> Iterator[list[dict]]:
                for batch in batches:
                    for k in range(batch.num_rows):
                        parts, data = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                        yield _found(FmIndex.from_bytes(data), *carried.value, parts)
            return arrow_rows(made(), _HIT)

        index.select(F.expr("transform(parts, p -> struct(p.row, p.first))").alias("parts"), "index").mapInArrow(
            shards, _HIT).write.mode("append").parquet(path)
        carried.destroy()

    some: list[tuple] = []
    for r in wanted.toLocalIterator():
        some.append((r["item"], r["phrase"]))
        if len(some) == block:
            visit(some)
            some = []
    if some:
        visit(some)
    hits = spark.read.schema(_HIT).parquet(path).groupBy("row").agg(
        F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    texts = index.select(F.explode("parts").alias("p")).select("p.*").where("first = 0")
    return texts.join(hits, "row", "left").select("id", "text_key", "n_words", "spans", "items")


def contamination(df: DataFrame, items: DataFrame, n: int = WORDS, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", shard_words: int = SHARD_WORDS,
                  block: int = BLOCK_PHRASES) -> DataFrame:
    """How far each text repeats the items: n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies in an occurrence of ``n`` consecutive words of an item (of all words of
    an item that has fewer).

    Defined cases: null and empty texts and items have no words and hit nothing; a text of any
    length is searched whole; phrases never run from one text into the next; items that repeat an id
    count once; an item without id hits but is neither counted nor listed; rows that repeat a
    document id are rows of their own; empty tables give no rows or no hits; other columns are not read.
    """
    found = search(build_index(df, n, id_col, text_col, shard_words), phrases(items, n, item_col, item_text_col), block)
    out = T.StructType([T.StructField("id", df.schema[id_col].dataType), *T.StructType.fromDDL(
        "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean").fields])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[list[dict]]:
            for batch in batches:
                rows = []
                for key, total, spans, names in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    hit = 0
                    if spans:
                        s, e = _merged(*(np.array([x[k] for x in spans]) for k in ("start", "stop")))
                        hit = int((e - s).sum())
                    names = [i for i in names or [] if i is not None]
                    rows.append({"id": key, "n_words": total, "n_hit": hit, "n_items": len(names), "contaminated": hit > 0,
                                 "items_sha256": hashlib.sha256(",".join(names).encode()).hexdigest()})
                yield rows
        return arrow_rows(made(), out)

    return found.select("id", "n_words", "spans", "items").mapInArrow(judge, out).withColumnRenamed("id", id_col)


def cut_passages(df: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table with all hit spans of :func:`search` cut out of its texts, from a span's first word to its last.

    Rows meet their spans by id and a hash of the text, so rows that repeat an id keep apart.
    """
    spans = found.where("spans is not null").select(
        F.col("id").alias("__id"), F.col("text_key").alias("__key"), F.col("spans").alias("__spans")).dropDuplicates(["__id", "__key"])

    @F.udf(T.StringType())
    def cut(text: str | None, ranges: list | None) -> str | None:
        if text is None or not ranges:
            return text
        at = [m.span() for m in _WORD.finditer(text)]
        s, e = _merged(np.array([r["start"] for r in ranges]), np.array([r["stop"] for r in ranges]))
        kept, last = [], 0
        for a, b in zip(s.tolist(), e.tolist(), strict=True):
            kept.append(text[last:at[a][0]])
            last = at[b - 1][1]
        return "".join([*kept, text[last:]])

    same = df[id_col].eqNullSafe(spans["__id"]) & (F.xxhash64(df[text_col]) == spans["__key"])
    return df.join(spans, same, "left").withColumn(text_col, cut(F.col(text_col), F.col("__spans"))).select(
        *[F.col(f"`{c}`") for c in df.columns])
