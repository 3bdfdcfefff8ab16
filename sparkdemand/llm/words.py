"""Words and shingles of texts as DataFrame expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of all rules here: white space is space and \\t to \\r.
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside one expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    """Array of the words of a text; null counts as empty."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def shingle_hashes(words: Column, size: int) -> Column:
    """Hash of every run of ``size`` words; of the whole sequence if there are fewer; none without words."""
    n = F.size(words)
    runs = F.transform(
        F.slice(words, F.lit(1), n - (size - 1)),
        lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, size)]),
    )
    whole = F.array(F.xxhash64(F.array_join(words, " ")))
    return F.when(n >= size, runs).when(n > 0, whole).otherwise(F.array().cast("array<bigint>"))
