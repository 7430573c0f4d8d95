"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame: all that the stage
before it kept, with its own decisions carried out. All but the last return the
columns of ``documents``, with their own values whatever their names are.

Rows of null doc_id are judged by the quality rules and mixed like others, but are
compared with no other row; rows that share a doc_id get one decision of each stage
after the first.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.llm import bpe, mixing, neardup, quality, suffix
from strataline.llm._store import Stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy corpus 3 keeps."""
    names = [c if c == "text" else f"column{i}" for i, c in enumerate(docs.columns)]
    kept = quality.apply_policy(quality.ledger(docs.toDF(*names)), "corpus", 3).filter("kept")
    return kept.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one of smallest doc_id."""
    return neardup.apply(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 100 bytes and more that stand earlier too; n_chars follows the text."""
    return suffix.apply(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    return mixing.apply(docs)


def bpe_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each remaining row, and whether decoding gives the text back."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    both = bpe.encode(docs, path, decoded=True)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", suffix_dedup),
    ("mixing sources to target weights", source_mix),
    ("BPE encoding and decoding", bpe_ids),
]
#: Suffix arrays, length fits and BPE have no SQL form; tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet in the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: Stored | None = None
    for name, stage in STAGES[:-1]:
        stored = Stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            before.drop()
        docs, before = stored.df, stored
    return STAGES[-1][1](spark, docs, sf_dir)
