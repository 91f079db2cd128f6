"""Exact dedup by a tree-merge of digest runs, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the holder that one round exchanges (a merge of 16 runs) and the number of rounds (256 holders).
ROUND_BITS = 4
ROUNDS = 2


def _digest_rows(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """Identifier, SHA-256 and an independent check (length and 64-bit hash) of each row's text."""
    body = F.coalesce(text, F.lit(""))
    return docs.select(
        F.col(id_col).alias("__id"),
        F.unhex(F.sha2(body.cast("binary"), 256)).alias("__digest"),
        F.octet_length(body).cast("long").alias("__length"),
        F.xxhash64(body).alias("__check"),
    )


def merge_runs(rows: DataFrame, keep: str = "min") -> DataFrame:
    """Merges per-partition digest runs into groups (__digest, __length, __check, keep_id, group_size).

    Every partition starts as the holder of one run. In each round holders exchange digests so that
    ROUND_BITS bits of the holder's number become bits of the digest; sixteen sorted runs meet in one
    and equal digests collapse to the retained identifier and a count. A frequent digest stays spread
    over the bits not yet exchanged: each round receives at most one row of it from each holder, and
    Spark combines on the map side before. The length and second hash are part of the key at every
    level, so that only verified equal texts merge.
    """
    best = {"min": F.min, "max": F.max}[keep]
    key = ["__digest", "__length", "__check"]
    mask = (1 << ROUND_BITS) - 1
    holder = F.pmod(F.spark_partition_id(), F.lit(1 << (ROUND_BITS * ROUNDS)))
    runs = rows.select(holder.alias("__holder"), *key, F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    bits = F.conv(F.substring(F.hex("__digest"), 1, 4), 16, 10).cast("int")
    for level in range(ROUNDS):
        shift = ROUND_BITS * level
        own = F.shiftright(bits, shift).bitwiseAND(mask)
        moved = F.col("__holder").bitwiseAND(~(mask << shift)).bitwiseOR(F.shiftleft(own, shift))
        runs = (
            runs.withColumn("__holder", moved)
            .groupBy("__holder", *key)
            .agg(best("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
            .sortWithinPartitions("__holder", "__digest")
        )
    return runs.drop("__holder")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per input row: id, keep_id, group_size (long), kept, text_sha256.

    Texts are equal when byte-identical; null counts as empty. Of equal texts the row with the smallest
    (keep="min") or largest ("max") id stays. Repeated rows (same id and text) count in group_size and
    all say kept. A null id is kept only if its group has no other id. Other columns are ignored; an
    empty table gives an empty result.
    """
    rows = _digest_rows(docs, id_col, F.col(text_col))
    groups = merge_runs(rows, keep).where("group_size > 1")
    key = ["__digest", "__length", "__check"]
    # rows of a frequent digest: the skew join of adaptive execution splits the left side
    found = rows.join(groups, key, "left")
    keep_id = F.when(F.col("group_size").isNull(), F.col("__id")).otherwise(F.col("keep_id"))
    return found.select(
        F.col("__id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("__id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("__digest")).alias("text_sha256"),
    )


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="max")


ORACLE_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
