"""Best-fit packing with swap-based local search: as few sequences of a fixed length as can be."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redpencil.llm.common import arrow_rows, by_bytes, stored
from redpencil.llm.tokens import word_ids

GROUP = 50_000  # pieces that one task packs at a time
TEXT_BYTES = 1 << 20  # texts that a worker tokenises at a time


def token_pieces(df: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id",
                 text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenise whole texts, end each with ``end_id``, cut those longer than ``capacity``.

    Returns id, piece, start, length, ids_crc32 and, with ``with_ids``, the ids as bytes. A null or
    empty text is the end id alone. Rows that repeat an id stay separate documents.
    """
    kind = df.schema[id_col].dataType
    fields = [T.StructField("id", kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
              T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    fields += [T.StructField("ids", T.BinaryType())] if with_ids else []
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(tokenizer)

        def made() -> Iterator[list[dict]]:
            for batch in by_bytes(batches, TEXT_BYTES):
                keys, texts = (c.to_pylist() for c in batch.columns)
                out = []
                for key, ids in zip(keys, encode(texts), strict=True):
                    ids += end
                    for piece, b in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[b:b + 4 * capacity]
                        out.append({"id": key, "piece": piece, "start": b // 4, "length": len(part) // 4,
                                    "ids_crc32": zlib.crc32(part)} | ({"ids": part} if with_ids else {}))
                yield out
        return arrow_rows(made(), T.StructType(fields))

    narrow = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return narrow.mapInArrow(cut, T.StructType(fields)).withColumnRenamed("id", id_col)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each item goes to the fullest bin that still takes it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set while a bin with r tokens of room exists
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[at].append(item)
        else:
            room, at = capacity, len(bins)
            bins.append([item])
        by_room[room - size].append(at)
        rooms |= 1 << (room - size)
    return bins


class _Others:
    """The items of all bins but one, by what could stand in their place.

    An item of size y in a bin with room r can give way to any item of up to y + r. ``smallest(x)``
    is the smallest item that can give way to one of size x, which fills its bin the most.
    """

    def __init__(self, capacity: int) -> None:
        self.heaps: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]
        self.least = np.full(capacity + 2, capacity + 1, np.int64)
        self.fits: np.ndarray | None = None

    def add(self, bin_: int, stamp: int, sizes: list[int], room: int) -> None:
        for y in sizes:
            heapq.heappush(self.heaps[y + room], (y, bin_, stamp))
            if y < self.least[y + room]:
                self.least[y + room] = y
        self.fits = None

    def smallest(self, x: int, stamps: list[int], giver: int) -> tuple[int, int] | None:
        """Size and bin of that item, if it is smaller than x."""
        while True:
            if self.fits is None:
                self.fits = np.minimum.accumulate(self.least[::-1])[::-1]
            y = int(self.fits[x])
            if y >= x:
                return None
            at = x + int(np.argmax(self.least[x:] == y))
            heap = self.heaps[at]
            aside = []
            while heap and (stamps[heap[0][1]] != heap[0][2] or heap[0][1] == giver):
                top = heapq.heappop(heap)  # the bin has changed since, or it is the giver itself
                if stamps[top[1]] == top[2]:
                    aside.append(top)
            found = heap[0] if heap else None
            for top in aside:
                heapq.heappush(heap, top)
            if found is not None and found[0] == y:
                return y, found[1]
            if not aside:
                self.least[at] = heap[0][0] if heap else len(self.least)
                self.fits = None
                continue
            # the giver's own items hide the others of this size: look past them once
            best = None
            for t in range(x, len(self.heaps)):
                for size, bin_, stamp in self.heaps[t]:
                    if size < x and bin_ != giver and stamps[bin_] == stamp and (best is None or size < best[0]):
                        best = (size, bin_)
            return best


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Empty underfull bins by moves and exchanges that each raise the sum of squared fills.

    The emptiest bin gives: an item moves to the fullest bin that takes it; else one or two of its
    items change places with one smaller item of a fuller bin. A step moves tokens from the emptiest
    bin to one that is as full at least, so the sum rises and the search ends: when no bin can give
    any more, or at the least possible number of bins.
    """
    size = lengths.tolist()
    contents = [list(b) for b in bins]
    fills = [sum(size[i] for i in b) for b in contents]
    total = sum(fills)
    best = -(-total // capacity)
    stamps = [0] * len(bins)
    others = _Others(capacity)
    by_room: dict[int, set[int]] = {}
    rooms = 0

    def enter(k: int) -> None:
        nonlocal rooms
        room = capacity - fills[k]
        if room and contents[k]:
            others.add(k, stamps[k], [size[i] for i in contents[k]], room)
            by_room.setdefault(room, set()).add(k)
            rooms |= 1 << room

    def leave(k: int) -> None:
        nonlocal rooms
        room = capacity - fills[k]
        if k in by_room.get(room, ()):
            by_room[room].remove(k)
            if not by_room[room]:
                del by_room[room]
                rooms &= ~(1 << room)
        stamps[k] += 1

    def step_of(giver: int) -> tuple[list[int], int, list[int]] | None:
        """Items to give, the bin that takes them, sizes it gives back. The taker ends fuller than the giver was."""
        own = contents[giver]
        for one in sorted(own, key=size.__getitem__, reverse=True):
            fitting = rooms >> size[one]
            while fitting:
                room = size[one] + (fitting & -fitting).bit_length() - 1
                to = next((k for k in by_room[room] if k != giver), None)
                if to is not None:
                    if fills[to] + size[one] > fills[giver]:
                        return [one], to, []
                    break  # all others are emptier still
                fitting &= fitting - 1
        gain, step, tried = 0, None, set()
        for group in [[a] for a in own] + [[a, b] for n, a in enumerate(own) for b in own[n + 1:]]:
            x = sum(size[i] for i in group)
            if x > capacity or x in tried:
                continue
            tried.add(x)
            found = others.smallest(x, stamps, giver)
            if found is not None and x - found[0] > gain and fills[found[1]] + x - found[0] > fills[giver]:
                gain, step = x - found[0], (group, found[1], [found[0]])
        return step

    for k in range(len(bins)):
        enter(k)
    used, improved = sum(map(bool, contents)), True
    while improved and used > best:  # until a whole pass over the bins moves nothing
        improved = False
        giving = [(fills[k], k, stamps[k]) for k in range(len(bins)) if fills[k] < capacity and contents[k]]
        heapq.heapify(giving)
        while giving and used > best:
            _, giver, stamp = heapq.heappop(giving)
            step = step_of(giver) if stamp == stamps[giver] and contents[giver] else None
            if step is None:
                continue
            improved = True
            group, to, back_sizes = step
            back = [next(i for i in contents[to] if size[i] == y) for y in back_sizes]
            leave(giver)
            leave(to)
            contents[giver] = [i for i in contents[giver] if i not in group] + back
            contents[to] = [i for i in contents[to] if i not in back] + group
            for k in (giver, to):
                fills[k] = sum(size[i] for i in contents[k])
                enter(k)
                if contents[k] and fills[k] < capacity:
                    heapq.heappush(giving, (fills[k], k, stamps[k]))
            used -= not contents[giver]
    assert sum(fills) == total
    return [b for b in contents if b]


def pack(pieces: DataFrame, capacity: int = 4096, length_col: str = "length", group: int = GROUP) -> DataFrame:
    """Add sequence_id and offset to each piece, so that few sequences hold them all.

    Pieces are dealt evenly into groups of about ``group`` rows, each packed by one task: best fit
    decreasing, then local search. The sequences with room of all groups are opened again and
    packed together in a next round, until one group holds them, their number is the least possible
    for their tokens, or a round lowers it no more. :func:`against_least` compares the outcome with
    the least possible number.

    Defined cases: lengths below 1 or null take no room and share sequences freely; a length above
    ``capacity`` stops the job; ties and repeated rows are packed like any others; an empty table
    gives no rows; other columns pass through (sequence_id and offset are replaced).
    """
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    schema = T.StructType([pieces.schema[c] for c in columns] + [
        T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
        T.StructField("__fill", T.LongType()), T.StructField("__first", T.BooleanType())])

    def packed(level: int):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            frames = [f for f in frames if len(f)]
            if not frames:
                return
            rows = pd.concat(frames, ignore_index=True)
            lengths = np.maximum(rows[length_col].fillna(0).to_numpy(np.int64), 0)
            if lengths.max() > capacity:
                raise ValueError(f"a piece is longer than {capacity}")
            bins = local_search(best_fit(lengths, capacity), lengths, capacity)
            base = (level << 52) | (TaskContext.get().partitionId() << 32)
            at, place, wide = (np.zeros(len(rows), np.int64) for _ in range(3))
            first = np.zeros(len(rows), bool)
            for k, items in enumerate(bins):
                fill = np.cumsum(lengths[items])
                at[items], place[items], wide[items] = base + k, fill - lengths[items], fill[-1]
                first[items[0]] = True
            yield rows.assign(sequence_id=at, offset=place, __fill=wide, __first=first)
        return run

    todo, done, level, before = pieces.select(*[F.col(f"`{c}`") for c in columns]), [], 0, None
    todo = stored(todo, "pieces")
    n = todo.count()
    while True:
        tasks = max(1, -(-n // group))
        out = stored(todo.repartition(tasks).mapInPandas(packed(level), schema), "packed")
        is_open = F.col("__fill") < capacity
        s = out.agg(F.count_if("__first").alias("all"), F.count_if(is_open).alias("rows"), F.count_if(is_open & F.col("__first")).alias("open"),
                    F.sum(F.when(is_open & F.col("__first"), F.col("__fill"))).alias("tokens")).first()
        least = -(-(s["tokens"] or 0) // capacity)
        if tasks == 1 or s["open"] <= max(least, 1) or (before is not None and s["all"] >= before):
            done.append(out)
            break
        done.append(out.where(~is_open))
        todo, n, before, level = out.where(is_open).select(*[F.col(f"`{c}`") for c in columns]), s["rows"], s["open"], level + 1
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    return whole.drop("__fill", "__first")


def against_least(packed: DataFrame, capacity: int = 4096, length_col: str = "length") -> DataFrame:
    """One row: the sequences used and the least number that could hold the tokens."""
    length = F.greatest(F.coalesce(F.col(length_col), F.lit(0)), F.lit(0))
    return packed.agg(F.count_distinct("sequence_id").alias("sequences"), F.ceil(F.coalesce(F.sum(length), F.lit(0)) / capacity).alias("least"))


def sequences(packed: DataFrame, length_col: str = "length", ids_col: str = "ids") -> DataFrame:
    """One row for each sequence: its length, pieces and, where the ids are carried, the joined ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", ids_col)))
    return packed.groupBy("sequence_id").agg(
        F.sum(length_col).alias("tokens"), F.count("*").alias("pieces"), parts.alias("parts")).select(
        "sequence_id", "tokens", "pieces",
        F.aggregate("parts", F.lit(b""), lambda all_, p: F.concat(all_, p[ids_col])).alias("ids"))
