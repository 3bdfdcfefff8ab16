"""Helpers that several operators share: kept tables, global prefix sums, text blocks inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkdemand.session import cut_lineage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there: read several times, made once."""
    return cut_lineage(df)


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_prefix_sums(df: DataFrame, order_by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Add ``before_<value>``: the sum of ``value`` over all rows that come earlier in the order ``order_by``.

    Rows are dealt into contiguous ranges; each range is summed by itself, and the totals of the ranges (one row
    per range) are cumulated and added.  Rows equal in all order columns are spread by their place in the input,
    so no key gathers in one task.  ``df`` is read twice (bounds, then rows): pass a narrow kept table.
    """
    placed = df.withColumn("at__", F.monotonically_increasing_id())
    order = [*order_by, "at__"]
    # The ranges follow from a sample of the rows, so they are fixed by writing them down.
    dealt = kept(placed.repartitionByRange(shuffle_width(df), *order).withColumn("range__", F.spark_partition_id()))
    ranges = Window.orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        dealt.groupBy("range__")
        .agg(*[F.sum(v).alias(v) for v in values])
        .select("range__", *[F.coalesce(F.sum(v).over(ranges), F.lit(0)).alias(f"offset_{v}__") for v in values])
    )
    inside = Window.partitionBy("range__").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # One row per range, and the number of ranges is the shuffle width: a bounded broadcast.
    joined = dealt.join(F.broadcast(totals), "range__")
    sums = {f"before_{v}": F.coalesce(F.sum(v).over(inside), F.lit(0)) + F.col(f"offset_{v}__") for v in values}
    return joined.withColumns(sums).drop("range__", "at__", *[f"offset_{v}__" for v in values])


#: Rows that a task turns into Python objects at once; Spark's batches hold up to 10,000.
SLICE = 512


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that a worker's objects don't grow with Spark's batches."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def text_blocks(texts: Sequence[str | None], limit: int = 1 << 21) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts (null as empty) in blocks of about ``limit`` characters, with the place of the first."""
    start, size, block = 0, 0, []
    for i, text in enumerate(texts):
        text = text or ""
        if block and size + len(text) > limit:
            yield start, block
            start, size, block = i, 0, []
        block.append(text)
        size += len(text)
    if block:
        yield start, block


_TABLES: list = []


def worker_table(make: Callable) -> Callable:
    """What ``make`` returns is held by the worker process between tasks, until a step that has no use for it gives it back."""
    held = lru_cache(maxsize=1)(make)
    _TABLES.append(held)
    return held


def give_back() -> None:
    """Return to the system what earlier tasks of other steps left in this worker process, which lives on between tasks."""
    held = [t for t in _TABLES if t.cache_info().currsize]
    for t in held:
        t.cache_clear()
    if held:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps freed pages otherwise
        if trim:
            trim(0)


#: The longest key that a cache keeps, which bounds the bytes of an entry.
LONGEST = 64


class Cache(dict):
    """Values by text; keys over ``LONGEST`` characters stay for one block only."""

    def __init__(self) -> None:
        super().__init__()
        self.passing: list[str] = []


def add_missing(cache: Cache, keys: Iterable[str], make, most: int = 300_000) -> None:
    """Fill ``cache`` for ``keys``, so that until the next call all of them are there.

    When it has grown beyond ``most`` entries only those of ``keys`` stay, so frequent ones are not made again; if they
    are most of it, none.
    """
    for k in cache.passing:
        cache.pop(k, None)
    if len(cache) > most:
        keys = set(keys)
        stay = {k: cache[k] for k in keys if k in cache}
        cache.clear()
        if 2 * len(stay) <= most:
            cache.update(stay)
    new = [k for k in keys if k not in cache]
    cache.passing = [k for k in new if len(k) > LONGEST]
    if new:
        cache.update(zip(new, make(new), strict=True))
