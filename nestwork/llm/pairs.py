"""Helpers for operators on pairs: set fingerprints and pairs within groups in blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 512


def fingerprints(rows: DataFrame, group: str, item: str) -> DataFrame:
    """Per group of distinct items: ``group``, ``n`` and 128 bits (``x1``, ``x2``) that equal sets share.

    XOR of hashes is combined before the shuffle and needs no list of the items, however many there are.
    """
    return rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64(F.col(item))).alias("x1"),
        F.bit_xor(F.xxhash64(F.lit("second"), F.col(item))).alias("x2"),
    )


def pairs_in_blocks(rows: DataFrame, group: str, item: str, size: Column, a: str, b: str) -> DataFrame:
    """All pairs ``a < b`` of the items of each group, with the left row's other columns.

    A group of ``size`` rows is cut into blocks of about ``BLOCK`` left rows that may lie in different
    tasks; the right rows go to each block. Meant for groups that pruning has left small, or whose
    pairs are all wanted.
    """
    k = F.greatest(F.ceil(size / F.lit(BLOCK)), F.lit(1)).cast("int")
    left = rows.withColumn("_blk", F.pmod(F.xxhash64(F.col(item)), k).cast("int")).withColumnRenamed(item, a)
    right = rows.select(group, F.col(item).alias(b), F.explode(F.sequence(F.lit(0), k - 1)).alias("_blk"))
    return left.join(right, [group, "_blk"]).filter(F.col(a) < F.col(b)).drop("_blk")
