"""What the operators share: Arrow batches of bounded size, word shingles; tables cut from lineage come from the engine."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexibond.tables import Table as Table
from lexibond.tables import hot_keys as hot_keys
from lexibond.tables import lookup as lookup

# Fixed value: what separates words.
WORD = r"[^\x20\x09-\x0D]+"
ROWS_PER_BATCH = 256


BYTES_PER_BATCH = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, since single texts may be long. All operators set the same values, so it doesn't
    matter which of several lazy plans runs first."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BYTES_PER_BATCH)


def blank_text(df: DataFrame) -> DataFrame:
    return df.withColumn("text", F.coalesce(F.col("text"), F.lit("")))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BYTE_CODE = np.random.RandomState(7).randint(1, 2**62, 256).astype(np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text, A-Z lower-cased."""
    b = _LOWER[np.frombuffer(text, np.uint8)]
    if not len(b):
        return np.zeros(0, np.uint64)
    inside = ~_SPACE[b]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    # Sum of code(byte) * base^(place in its word): places restart at each word.
    place = np.arange(len(b)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(b)]]))) if starts[0] == 0 else None
    if place is None:
        first = np.concatenate([[0], starts])
        place = np.arange(len(b)) - np.repeat(first, np.diff(np.concatenate([first, [len(b)]])))
    terms = _BYTE_CODE[b] * _powers(int(place.max()) + 1)[place]
    terms[~inside] = 0
    sums = np.add.reduceat(terms, starts)
    return mix64(sums + (ends - starts).astype(np.uint64))


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of the whole sequence, if it has fewer words."""
    w = word_hashes(text)
    n = len(w)
    if not n:
        return w
    size = min(k, n)
    h = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        h = mix64(h * _BASE + w[i : n - size + 1 + i])
    return np.unique(h + np.uint64(size))
