"""Hashed character n-grams over byte buffers, and labelled samples of bounded size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A-Z lower-cased; ASCII that is neither letter nor digit becomes blank; bytes of other characters stay.
STREAM = np.full(256, 32, np.uint8)
for _b in range(256):
    if _b >= 128 or chr(_b).isalnum():
        STREAM[_b] = _b + 32 if 65 <= _b <= 90 else _b


def gram_cells(stream: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The cell, of 2^bits, of the n bytes from each position; one short of the end by n - 1."""
    if len(stream) < n:
        return np.zeros(0, np.uint32)
    m = len(stream) - n + 1
    h = stream[:m].astype(np.uint32)
    for k in range(1, n):
        h *= np.uint32(0x01000193)
        h += stream[k : k + m]
    h += np.uint32(n * 0x2545F491 & 0xFFFFFFFF)
    h *= np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return h >> np.uint32(32 - bits)


def sample_labelled(labelled: DataFrame, most: int, id_col: str = "id") -> DataFrame:
    """About `most` rows at most, chosen by the hash of the id: the same on every run and for any partitioning."""
    n = labelled.count()
    if n <= most:
        return labelled
    share = int(most / n * (1 << 31))
    return labelled.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(1 << 31)) < share)


def labels_of(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """id, y: one label per id (of repeated rows the largest); null labels and ids are left out."""
    return labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("y"))


def flag(condition: Column) -> Column:
    """False where the condition is null."""
    return F.coalesce(condition, F.lit(False))
