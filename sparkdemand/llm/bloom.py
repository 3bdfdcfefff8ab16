"""Bloom filters whose bits Spark sets, and rows that may match them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 10
HASHES = 5
#: Largest filter that is sent to tasks: 8 MB.
MOST_BITS = 1 << 26


def positions(h1: np.ndarray, h2: np.ndarray, level: int, bits: int) -> Iterator[np.ndarray]:
    """Bit places of keys: double hashing, with another step for each level."""
    a, b = h1.astype(np.uint64), h2.astype(np.uint64) | np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(HASHES):
            mixed = a + np.uint64(1 + k + HASHES * level) * b
            mixed ^= mixed >> np.uint64(29)
            yield (mixed % np.uint64(bits)).astype(np.int64)


def knows(words: np.ndarray, h1: np.ndarray, h2: np.ndarray, level: int = 0) -> np.ndarray:
    found = np.ones(len(h1), dtype=bool)
    for place in positions(h1, h2, level, 64 * len(words)):
        found &= (words[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
    return found


def bloom_words(keys: DataFrame, n: int, level: int = 0, most_bits: int = MOST_BITS) -> np.ndarray:
    """64-bit words of a filter of ``n`` keys (columns h1, h2); bits are joined per word before they meet.

    A filter never grows beyond ``most_bits``; with more keys it lets more rows through.
    """
    size = max(1, -(-min(n * BITS_PER_KEY, most_bits) // 64))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = (batch.column(i).to_numpy() for i in range(2))
            place = np.concatenate([*positions(h1, h2, level, 64 * size), np.empty(0, np.int64)])
            bit = (np.uint64(1) << (place & 63).astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(place >> 6), pa.array(bit)], ["word", "bits"])

    set_bits = keys.select("h1", "h2").mapInArrow(work, "word long, bits long").groupBy("word").agg(F.expr("bit_or(bits)").alias("bits"))
    found = set_bits.toArrow()  # at most ``size`` rows
    words = np.zeros(size, dtype=np.uint64)
    words[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return words


def sent_words(column: str, keys: DataFrame) -> Broadcast:
    """Filter of the longs of ``keys`` (a kept table) for tasks; the second hash is Spark's xxhash64 of the long."""
    hashed = keys.select(F.col(column).alias("h1"), F.xxhash64(column).alias("h2"))
    return keys.sparkSession.sparkContext.broadcast(bloom_words(hashed, keys.count()))


def may_be_in(column: str, keys: DataFrame, words: Broadcast | None = None) -> Column:
    """Whether a long column may be among the longs of ``keys`` (a kept table, same column name).

    Every row that is there passes, and about one in a hundred of the others while the filter is below its bound.
    ``words``: the filter, if it was sent before.
    """
    words = words or sent_words(column, keys)

    @F.pandas_udf("boolean")
    def probe(a, b):
        return a.__class__(knows(words.value, a.to_numpy(), b.to_numpy()))

    return probe(F.col(column), F.xxhash64(column))
