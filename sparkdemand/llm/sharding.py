"""Contiguous shards of near equal bytes, from global prefix sums of sizes.

Only narrow rows (id, size, checksum) are dealt into ranges of the document order; the totals of the ranges are
cumulated, and a document goes to the shard that holds its middle byte when the whole corpus is cut at equal
targets.  Everything is DataFrame functions.

Defined results: a null text counts ``overhead`` bytes and has the checksum of no bytes; null ids come first;
repeated rows and equal ids are ordered by a hash of the text, then by their place in the input; an empty table
gives no rows; equal texts are not held together, since a group may be larger than a shard; other columns of
the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdemand.llm.common import kept, with_prefix_sums

N_SHARDS = 40
OVERHEAD = 16


def _sizes(docs: DataFrame, id_col: str, text_col: str, overhead: int) -> list[Column]:
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + overhead
    crc = F.crc32(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")))
    return [F.col(id_col).alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), F.xxhash64(text_col).alias("tie")]


def assign_shards(
    docs: DataFrame, n_shards: int = N_SHARDS, id_col: str = "doc_id", text_col: str = "text", overhead: int = OVERHEAD
) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, tie, shard, slot``; slots count from 0 in each shard."""
    narrow = kept(docs.select(*_sizes(docs, id_col, text_col, overhead), F.lit(1).cast("long").alias("one")))
    placed = with_prefix_sums(narrow, ["doc_id", "tie"], ["size", "one"])
    total = F.broadcast(narrow.agg(F.sum("size").alias("total")))
    # Twice the middle byte against twice the total, in whole numbers.
    middle = f"((2 * before_size + size) * {n_shards}) div greatest(1, 2 * total)"
    placed = kept(placed.crossJoin(total).withColumn("shard", F.expr(f"cast(least({n_shards - 1}, {middle}) as int)")))
    first = placed.groupBy("shard").agg(F.min("before_one").alias("first"))  # at most n_shards rows
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "tie", "shard", (F.col("before_one") - F.col("first")).alias("slot")
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = N_SHARDS) -> None:
    """Write all columns of the documents in Parquet folders ``shard=0`` ... under ``path``.

    Texts are not shuffled: the first (doc_id, tie) of each shard are ``n_shards`` bounds that every row is compared
    with.  Rows that are equal in both go to the earlier shard together.
    """
    bounds = (
        assign_shards(docs, n_shards)
        .groupBy("shard")
        .agg(F.min(F.struct("doc_id", "tie")).alias("from"))
        .agg(F.sort_array(F.collect_list(F.struct("from", "shard"))).alias("bounds__"))
    )
    key = F.struct(F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("tie"))
    shard = F.array_max(F.transform(F.filter("bounds__", lambda b: b["from"] <= F.col("key__")), lambda b: b["shard"]))
    (
        docs.withColumn("key__", key)
        .crossJoin(F.broadcast(bounds))
        .withColumn("shard", F.coalesce(shard, F.lit(0)))
        .drop("key__", "bounds__")
        .write.mode("overwrite")
        .partitionBy("shard")
        .parquet(path)
    )


def shard_digest(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """The columns of the query: the assignment under the law ``bytes``."""
    return assign_shards(docs, n_shards).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
