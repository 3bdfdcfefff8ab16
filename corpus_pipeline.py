"""The corpus pipeline: stages that each apply one text operator to all that the stage before kept.

Language id drops texts without a language; quality rules drop texts that a rule rejects; near-dedup keeps one
document of each group (five-word shingles, 80 %); suffix dedup cuts later copies of passages of 200 bytes and more
and drops texts of which nothing is left; packing gives the sequences.  All but the last return the columns of
``documents``.  SQL can't express the trained classifier, so there is no SQL twin.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdemand.llm import language, near_dedup, packing, quality, suffix_dedup
from sparkdemand.llm.common import table
from sparkdemand.session import ensure_checkpoint_dir

#: Passages of some fifty words have more bytes than this.
REPEATED_BYTES = 200


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    machines = language.fit(docs.where(~language.held_out()))
    # Names of their own, so that columns of the input that are called alike stay as they are.
    return language.predict(docs, machines, names=("lang__", "sure__")).where("lang__ <> 'und'").select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rest = suffix_dedup.cut_repeats(docs, length=REPEATED_BYTES).where("text <> ''")
    return rest.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", keep_quality),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
