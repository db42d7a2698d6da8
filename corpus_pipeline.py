"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
docs of the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import bpe, lines, minhash, mixing, repetition
from skein.llm.common import saved

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the repetition limits."""
    return repetition.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that repeat earlier ones; documents of which no line is left go."""
    d = lines.cut(docs, exact=1)
    empty = (F.col("n_copies") + F.col("n_near") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    n_chars = F.when(F.col("text").isNotNull(), F.char_length("text").cast("bigint"))
    return d.where(~F.coalesce(empty, F.lit(False))).select(*lines.unpacked(docs.columns, text=F.col("text"), n_chars=n_chars))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates (similarity of 0.8 or more): the least doc_id."""
    gone = minhash.near_duplicates(docs, percent=80, share=0.4).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, written by shard and in each shard's shuffled order."""
    return mixing.in_order(mixing.mixed(docs)).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with digests of the ids and of the bytes they decode to."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("mixing", mix),
    ("byte_bpe", encode),
]

#: Suffix arrays, sketches and byte-pair merges have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
