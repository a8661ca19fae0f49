"""Alignment of two tokenizers' tokens over the same bytes, by divide and conquer at shared cuts."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from redpencil.llm.common import arrow_rows, by_bytes, stored

BLOCK_BYTES = 1 << 20  # text that is aligned together; a longer text is a block of its own
# Characters whose classes are the same in every Unicode version that the two libraries may carry
_SETTLED = re.compile("[\t\n\r -~¡-¬®-ȳ‐-‧‰-⁞€]*")


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte, and back."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class ByteTokens:
    """Tokens of a byte-level BPE file.

    With the same vocabulary as ranks a faster library encodes the texts whose characters both
    libraries class alike (a test compares them character by character); all others go by the file.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.file = Tokenizer.from_file(path)
        self.file.encode_special_tokens = True
        letters = _byte_letters()
        # an added token, such as a special one, is written as it is
        raw = {t.content: t.content.encode() for t in self.file.get_added_tokens_decoder().values()}
        known = self.file.get_vocab(with_added_tokens=True)
        self.data = [b""] * (max(known.values()) + 1)
        for token, k in known.items():
            self.data[k] = raw[token] if token in raw else bytes(letters[c] for c in token)
        self.fast = None
        if ranks is not None:
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(t): int(k) for t, k in (line.split() for line in lines)}
            self.fast = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def __call__(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int] | None] = [None] * len(texts)
        if self.fast is not None:
            encode = self.fast.encode_ordinary
            for n, text in enumerate(texts):
                if text.isascii() or _SETTLED.fullmatch(text):
                    out[n] = encode(text)
        rest = [n for n, ids in enumerate(out) if ids is None]
        for n, found in zip(rest, self.file.encode_batch_fast([texts[n] for n in rest], add_special_tokens=False), strict=True):
            out[n] = found.ids
        return out


class PieceTokens:
    """Tokens of a piece model with byte fallback; the model adds the leading space itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.data = [bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode()
                     for k, p in enumerate(self.model.id_to_piece(list(range(n))))]

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def _tokenizers(a: str, ranks: str | None, pattern: str | None, b: str):
    """Both tokenizers, the lengths of their tokens, and all ids as they are written; kept by the worker."""
    made: list = []
    for tokens in (ByteTokens(a, ranks, pattern), PieceTokens(b)):
        made += [tokens, np.array([len(d) for d in tokens.data], np.int64)]
    written = [f"{k}{end}" for tokens in made[::2] for k in range(len(tokens.data)) for end in ",|;"]
    return [*made, written]


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Positions in ``ends_a`` of all token ends that ``ends_b`` has as well.

    ``low`` and ``high`` bound the intervals to divide: tokens [low, high) of A, whose last end is
    shared. An interval takes the shared end nearest its middle, found by bisection of B's ends,
    and both halves go on; an interval without one inside is a leaf. All intervals of a level
    are divided together.
    """
    cut = np.zeros(len(ends_a), bool)
    cut[high[high > low] - 1] = True
    while True:
        inner = high - low > 1
        low, high = low[inner], high[inner]
        if not len(low):
            return np.flatnonzero(cut)
        middle, found = (low + high - 2) // 2, np.full(len(low), -1)
        looking, step = np.arange(len(low)), 0
        while len(looking):
            for side in ((0,) if step == 0 else (step, -step)):
                at = middle[looking] + side
                inside = (at >= low[looking]) & (at < high[looking] - 1)
                end = ends_a[np.where(inside, at, 0)]
                place = np.minimum(np.searchsorted(ends_b, end), len(ends_b) - 1)
                hit = inside & (ends_b[place] == end)
                found[looking[hit]] = at[hit]
                looking = looking[~hit]
            step += 1
            looking = looking[(middle[looking] + step < high[looking] - 1) | (middle[looking] - step >= low[looking])]
        split = found >= 0
        cut[found[split]] = True
        low, high = np.concatenate([low[split], found[split] + 1]), np.concatenate([found[split] + 1, high[split]])


def links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of an A and a B token whose byte ranges overlap, as positions; empty tokens link with nothing."""
    start_a, start_b = np.concatenate([[0], ends_a[:-1]]), np.concatenate([[0], ends_b[:-1]])
    owner = np.repeat(np.arange(len(ends_b)), ends_b - start_b)  # the B token of each byte
    first = owner[np.minimum(start_a, len(owner) - 1)]
    n = np.where(ends_a > start_a, owner[ends_a - 1] - first + 1, 0)
    a = np.repeat(np.arange(len(ends_a)), n)
    b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    full = ends_b[b] > start_b[b]
    return a[full], b[full]


def aligned(texts: list[str | None], tools: list) -> list[tuple]:
    """For each text: A ids, B ids, the ends of its groups in A and in B tokens, link pairs, the groups' text."""
    tokens_a, length_a, tokens_b, length_b, written = tools
    empty = np.zeros(0, np.int64)
    out = [(empty, empty, empty, empty, empty, None)] * len(texts)
    some = [n for n, t in enumerate(texts) if t]
    ids_a, ids_b, kept = [], [], []
    for n, a, b in zip(some, tokens_a([" " + texts[n] for n in some]), tokens_b([texts[n] for n in some]), strict=True):
        whole = (" " + texts[n]).encode()
        if b"".join(map(tokens_a.data.__getitem__, a)) == whole and b"".join(map(tokens_b.data.__getitem__, b)) == whole:
            kept.append(n)
            ids_a.append(np.array(a, np.int64))
            ids_b.append(np.array(b, np.int64))
    if not kept:
        return out
    a, b = np.concatenate(ids_a), np.concatenate(ids_b)
    ends_a, ends_b = np.cumsum(length_a[a]), np.cumsum(length_b[b])
    stop_a, stop_b = np.cumsum([len(i) for i in ids_a]), np.cumsum([len(i) for i in ids_b])
    cuts = shared_cuts(ends_a, ends_b, np.concatenate([[0], stop_a[:-1]]), stop_a)
    cut_b = np.searchsorted(ends_b, ends_a[cuts], side="right") - 1  # a text's last end is shared, so no text runs into the next
    pair_a, pair_b = links(ends_a, ends_b)
    pairs = a[pair_a] << 32 | b[pair_b]
    # what follows each id: a comma, a bar after the last A id of a group, a semicolon after its last B id
    mark_a, mark_b = 3 * a, 3 * (b + len(tokens_a.data))
    mark_a[cuts] += 1
    mark_b[cut_b] += 2
    group_stop, pair_stop = np.searchsorted(cuts, stop_a), np.searchsorted(pair_a, stop_a)
    a0 = b0 = g0 = p0 = 0
    for n, a1, b1, g1, p1 in zip(kept, stop_a.tolist(), stop_b.tolist(), group_stop.tolist(), pair_stop.tolist(), strict=True):
        ga, gb = cuts[g0:g1] + 1 - a0, cut_b[g0:g1] + 1 - b0
        out[n] = (a[a0:a1], b[b0:b1], ga, gb, pairs[p0:p1], _written(mark_a[a0:a1], mark_b[b0:b1], ga, gb, written))
        a0, b0, g0, p0 = a1, b1, g1, p1
    return out


def _written(mark_a: np.ndarray, mark_b: np.ndarray, ga: np.ndarray, gb: np.ndarray, written: list[str]) -> str:
    """``a1,a2|b1;a3|b2,b3``: the A ids of a group stand before its B ids."""
    parts = np.empty(len(mark_a) + len(mark_b), np.int64)
    parts[np.arange(len(mark_a)) + np.repeat(np.concatenate([[0], gb[:-1]]), np.diff(ga, prepend=0))] = mark_a
    parts[np.arange(len(mark_b)) + np.repeat(ga, np.diff(gb, prepend=0))] = mark_b
    return "".join([written[k] for k in parts.tolist()])[:-1]


def _narrow(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def token_groups(df: DataFrame, a: str, b: str, ranks: str | None = None, pattern: str | None = None,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``groups``: the shortest runs of A and of B tokens that cover the same bytes, in order.

    ``a`` is a byte-level BPE file (it encodes space + text), ``b`` a piece model (it adds the space),
    ``ranks`` and ``pattern`` the same vocabulary as A for the faster library. Defined cases as in
    :func:`link_statistics`; a text without tokens has no groups.
    """
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("groups", T.ArrayType(
        T.StructType([T.StructField("a", T.ArrayType(T.IntegerType())), T.StructField("b", T.ArrayType(T.IntegerType()))])))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = _tokenizers(a, ranks, pattern, b)

        def made() -> Iterator[list[dict]]:
            for batch in by_bytes(batches, BLOCK_BYTES):
                keys, texts = (c.to_pylist() for c in batch.columns)
                yield [{"id": key, "groups": [
                    {"a": x.tolist(), "b": y.tolist()} for x, y in zip(np.split(ids_a, ga), np.split(ids_b, gb), strict=True) if len(x)]}
                    for key, (ids_a, ids_b, ga, gb, _, _) in zip(keys, aligned(texts, tools), strict=True)]
        return arrow_rows(made(), schema)

    return _narrow(df, id_col, text_col).mapInArrow(cut, schema).withColumnRenamed("id", id_col)


_BLOCK = ("block long, pairs array<long>, pair_n array<long>, doc struct<n_a: array<int>, n_b: array<int>, n_groups: array<int>, "
          "n_links: array<int>, groups_sha256: array<string>>, packed binary")


def _packed(at: np.ndarray, n: np.ndarray, size: np.ndarray) -> bytes:
    """Three whole-number lists, small once they are written as steps."""
    return zlib.compress(b"".join([np.array([len(at), len(size)], "<i8").tobytes(), np.diff(at, prepend=0).astype("<i4").tobytes(),
                                   n.astype("<i4").tobytes(), size.astype("<i4").tobytes()]), 1)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = zlib.decompress(data)
    k, m = np.frombuffer(data[:16], "<i8").tolist()
    rest = np.frombuffer(data[16:], "<i4")
    return np.cumsum(rest[:k], dtype=np.int64), rest[k:2 * k].astype(np.int64), rest[2 * k:2 * k + m]


def link_statistics(df: DataFrame, a: str, b: str, ranks: str | None = None, pattern: str | None = None,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How firmly the tokens of each text are linked, by the counts of their id pairs in the corpus.

    Returns per row: id, n_a, n_b, n_groups, n_links (pairs of an A and a B token over a common byte),
    n_best (links whose pair is the most frequent one of its B id, ties included), count_sum (the
    links' corpus-wide counts added up), groups_sha256.

    Texts are tokenised once, in blocks of bounded bytes. A block is stored as one row: its distinct
    pairs with their counts, and which of them each text holds. The pairs are counted over all
    blocks; each block then gets back the counts of its own pairs, one row a block and pair, so a
    pair that every text holds makes one row a block and none makes a hot key.

    Defined cases: null and empty texts, and texts that either tokenizer does not give back byte for
    byte, have zeros and an empty digest; a text of any length is one block; rows that repeat an
    id are rows of their own; an empty table gives no rows; other columns are not read.
    """
    kind = df.schema[id_col].dataType
    n_b = 1 << 32

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tools, base = _tokenizers(a, ranks, pattern, b), TaskContext.get().partitionId() << 32

        def made() -> Iterator[list[dict]]:
            for number, batch in enumerate(by_bytes(batches, BLOCK_BYTES)):
                keys, texts = (c.to_pylist() for c in batch.columns)
                rows = aligned(texts, tools)
                pairs, place, total = np.unique(np.concatenate([r[4] for r in rows]), return_inverse=True, return_counts=True)
                owner = np.repeat(np.arange(len(rows)), [len(r[4]) for r in rows])
                held, n = np.unique(owner * (len(pairs) + 1) + place, return_counts=True)
                size = np.bincount(held // (len(pairs) + 1), minlength=len(rows))
                yield [{"block": base + number, "pairs": pairs, "pair_n": total, "ids": keys, "doc": {
                    "n_a": [len(r[0]) for r in rows], "n_b": [len(r[1]) for r in rows], "n_groups": [len(r[2]) for r in rows],
                    "n_links": [len(r[4]) for r in rows],
                    "groups_sha256": ["" if r[5] is None else hashlib.sha256(r[5].encode()).hexdigest() for r in rows]},
                    "packed": _packed(held, n, size)}]
        return arrow_rows(made(), blocks_schema)

    blocks_schema = T.StructType([*T.StructType.fromDDL(_BLOCK).fields, T.StructField("ids", T.ArrayType(kind))])
    blocks = stored(_narrow(df, id_col, text_col).mapInArrow(block, blocks_schema), "blocks")
    held = blocks.select("block", F.explode(F.arrays_zip("pairs", "pair_n")).alias("p")).select(
        "block", F.col("p.pairs").alias("pair"), F.col("p.pair_n").alias("n"))
    counts = held.groupBy("pair").agg(F.sum("n").alias("n"))
    # an A vocabulary bounds the pairs of one B id
    of_b = Window.partitionBy(F.col("pair") % n_b)
    rated = counts.select("pair", F.struct("n", (F.col("n") == F.max("n").over(of_b)).alias("best")).alias("rated"))
    back = held.select("block", "pair").join(rated, "pair").groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("pair", "rated"))).alias("rated"))
    whole = blocks.select("block", "ids", "doc", "packed").join(back, "block", "left").select(
        "ids", "doc", "packed", F.col("rated.rated.n").alias("n"), F.col("rated.rated.best").alias("best"))
    out = T.StructType([T.StructField("id", kind), *T.StructType.fromDDL(
        "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string").fields])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[list[dict]]:
            for batch in batches:
                for row in range(batch.num_rows):
                    one = batch.slice(row, 1).to_pydict()
                    ids, doc, packed = one["ids"][0], one["doc"][0], one["packed"][0]
                    count, best = np.array(one["n"][0] or [], np.int64), np.array(one["best"][0] or [], bool)
                    at, n, size = _unpacked(packed)
                    at %= len(count) + 1
                    owner = np.repeat(np.arange(len(size)), size)
                    n_best, count_sum = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
                    np.add.at(n_best, owner, n * best[at])
                    np.add.at(count_sum, owner, n * count[at])
                    yield [{"id": key, "n_best": x, "count_sum": y} | {k: v[i] for k, v in doc.items()}
                           for i, (key, x, y) in enumerate(zip(ids, n_best.tolist(), count_sum.tolist(), strict=True))]
        return arrow_rows(made(), out)

    return whole.mapInArrow(finish, out).withColumnRenamed("id", id_col)
