"""Evidence and audit: digests, Merkle roots, hash chains, tamper alerts, certificates. The ledger is a Parquet table."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sha256


def digest_files(spark, path: str) -> DataFrame:
    """path, size, sha256, md5 of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), sha256("content").alias("sha256"), F.md5("content").alias("md5"))


def hash_log(df: DataFrame, key: str, data: str) -> DataFrame:
    return df.select(key, sha256(data).alias("sha256"), F.md5(data).alias("md5"))


def merkle_root(df: DataFrame, order_by: str, leaf: str) -> DataFrame:
    """root, n: leaves (hex digests) in order; a parent is SHA-256 of both children's bytes; a lone last node moves up.

    Leaves get their places from a sort by range and sizes of ranges, not from one task; each level halves the rows.
    """
    ranged = df.select(order_by, leaf).repartitionByRange(order_by).sortWithinPartitions(order_by)
    marked = ranged.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    from .graph import cut_lineage

    marked = cut_lineage(marked)
    sizes = marked.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    starts = sizes.withColumn("_s", F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).select(F.col("_p").alias("_p2"), F.coalesce("_s", F.lit(0)).alias("_s"), "_first")
    level = marked.join(starts, F.col("_p") == F.col("_p2")).select((F.col("_s") + F.col("_m") - F.col("_first")).alias("i"), F.lower(leaf).alias("h"))
    n = level.count()
    left = n
    while left > 1:
        g = level.groupBy(F.floor(F.col("i") / 2).alias("i2")).agg(F.max(F.when(F.col("i") % 2 == 0, F.col("h"))).alias("l"), F.max(F.when(F.col("i") % 2 == 1, F.col("h"))).alias("r"))
        level = cut_lineage(g.select(F.col("i2").alias("i"), F.when(F.col("r").isNull(), F.col("l")).otherwise(F.sha2(F.concat(F.unhex("l"), F.unhex("r")), 256)).alias("h")))
        left = (left + 1) // 2
    return level.select(F.col("h").alias("root"), F.lit(n).cast("bigint").alias("n"))


def chain(df: DataFrame, case: str, seq: str, record: str) -> DataFrame:
    """case, seq, record, prev, hash: h = SHA-256(previous hex + record), from 64 zeros; one task a case, as it must be."""
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([seq, record], kind="stable")
        prev, before, after = "0" * 64, [], []
        for r in pdf[record]:
            before.append(prev)
            prev = hashlib.sha256((prev + (r or "")).encode()).hexdigest()
            after.append(prev)
        return pdf.assign(prev=before, hash=after)

    return df.select(case, seq, record).groupBy(case).applyInPandas(run, f"`{case}` {kinds[case]}, `{seq}` {kinds[seq]}, `{record}` {kinds[record]}, prev string, hash string")


def verify(stored: DataFrame, current: DataFrame) -> DataFrame:
    """evidence_id, status: OK, MISMATCH, MISSING (stored only) or UNKNOWN (current only); sha256 in any case."""
    s, c = stored.select("evidence_id", F.lower("sha256").alias("s")), current.select("evidence_id", F.lower("sha256").alias("c"), F.lit(1).alias("there"))
    j = s.withColumn("known", F.lit(1)).join(c, "evidence_id", "full_outer")
    status = F.when(F.col("there").isNull(), "MISSING").when(F.col("known").isNull(), "UNKNOWN").when(F.coalesce(F.col("s") == F.col("c"), F.lit(False)), "OK").otherwise("MISMATCH")
    return j.select("evidence_id", status.alias("status"))


def lookup(ledger: DataFrame, digest: str) -> DataFrame:
    return ledger.where(F.col("sha256") == F.lower(F.lit(digest)))


def certificate_rows(evidence: DataFrame, legal_basis: str) -> DataFrame:
    """One record for each exported item (evidence_id, sha256) with the Merkle root of them all; the legal basis is data, not a claim."""
    root = merkle_root(evidence, "evidence_id", "sha256").select(F.col("root").alias("merkle_root"), F.col("n").alias("n_items"))
    return evidence.select("evidence_id", "sha256").join(F.broadcast(root)).withColumn("legal_basis", F.lit(legal_basis))  # one row


def audit_stats(df: DataFrame, officer: str, action: str) -> DataFrame:
    return df.groupBy(officer, F.to_date("ts").alias("day"), action).agg(F.count("*").alias("n"))


def explain(df: DataFrame, template: str, *cols: str, evidence: str = "evidence") -> DataFrame:
    """A sentence from a row's own values; always GENERATED, always with its evidence."""
    return df.select(F.format_string(template, *map(F.col, cols)).alias("reason"), F.col(evidence).alias("evidence"), F.lit("GENERATED").alias("tier"))
