"""Hashed text features and bounded samples that the classifiers share."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MULTIPLIERS = tuple(np.uint32(m) for m in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))
_NO_LETTER = re.compile(r"[\W\d_]+")


def codes(text: str) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def letters(text: str) -> str:
    """Lower case, with one space for each run of anything but letters."""
    return _NO_LETTER.sub(" ", text.lower())


def ngram_buckets(points: np.ndarray, sizes: tuple[int, ...], bits: int) -> list[np.ndarray]:
    """Bucket of each n-gram of code points, for each n in ``sizes`` (up to 3)."""
    out = []
    for n in sizes:
        if len(points) >= n:
            h = np.full(len(points) - n + 1, n * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
            for k in range(n):
                h += points[k:len(points) - n + 1 + k] * _MULTIPLIERS[k]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            out.append(h >> np.uint32(32 - bits))
    return out


def counted(buckets: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that occur and how often."""
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0)
    total = np.bincount(np.concatenate(buckets), minlength=1 << bits)
    at = np.flatnonzero(total)
    return at, total[at].astype(float)


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, kind: str, id_col: str, text_col: str, per_label: int) -> DataFrame:
    """Whole texts and labels of a bounded sample.

    The sample is drawn from the narrow label rows and is broadcast (about ``per_label`` rows of
    each label), so the texts of all other documents never leave the scan.
    """
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast(kind).alias("label"))
    chosen = bounded_sample(known, "label", "id", per_label)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.join(F.broadcast(chosen), "id").select("text", "label")


def bounded_sample(labelled: DataFrame, label: str, id_col: str, per_label: int) -> DataFrame:
    """About ``per_label`` rows of each label, chosen by a hash of the id.

    The share of each label follows from its count over all rows, so the sample keeps its size
    whatever the size of the input. Labels are few; their counts are all that the driver sees.
    """
    sizes = labelled.groupBy(label).count().collect()
    chance = F.lit(0.0)
    for row in sizes:
        if row[label] is not None:
            chance = F.when(F.col(label) == row[label], per_label / row["count"]).otherwise(chance)
    draw: Column = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)) / float(1 << 30)
    return labelled.where(draw < chance)
