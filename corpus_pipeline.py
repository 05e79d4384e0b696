"""A training corpus from `documents`, in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; it works on all that the one before it
kept, and its result is written as Parquet and read again for the next.

    quality rules   documents that the rules reject go
    near dedup      one document of each group of near duplicates stays
    secret scan     secrets are masked in the text; n_chars follows
    mixing          documents as often as their source's target weight asks, up to twice
    packing         pieces of documents in sequences of 1024 tokens

The stages are defined for rows without doc_id, null and empty texts, and repeated rows as
their operators are: a null or empty text fails the quality rules; rows without a doc_id are
near duplicates of nothing; of rows that repeat a doc_id the near dedup keeps one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheetgrid.llm import minhash, mixing, packing, quality, secrets
from sheetgrid.llm.common import boxed, stored

VOCABULARY = "byte_bpe_50k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep."""
    kept = quality.judge(docs).where("kept").select("doc_id", "text_hash")
    rows = boxed(docs, _id=docs["doc_id"].cast("long"), _hash=F.xxhash64(docs["text"]))
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("text_hash"))
    return rows.join(kept, same, "left_semi").select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id."""
    kept = minhash.near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    rows = boxed(docs, _id=docs["doc_id"].cast("long"), _hash=F.xxhash64(docs["text"]))
    first = Window.partitionBy("_id").orderBy("_hash")
    one = rows.join(kept, F.col("_id") == F.col("doc_id")).withColumn("_nth", F.row_number().over(first))
    return one.where("_nth = 1").select("doc.*").unionByName(docs.where(docs["doc_id"].isNull()))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    findings = secrets.scan(docs, public_tokenizers.path(VOCABULARY), path="source")
    return secrets.redact(docs, findings, length="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs, mixing.mix(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences."""
    return packing.pack(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("secret scan", secret_scan),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: Estimates, candidate rounds, a trained forest and a tokenizer are beyond SQL; tests compare the
#: stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
