"""Change-logs: deletes, deciding changes and current state.

A log row carries the record's columns and ``op``, ``change_seq``, ``arrived_at``. ``change_seq``
alone decides which change is newer.

Defined results: a null ``op`` or one that begins with ``d`` after trimming, in any case, deletes;
a null ``change_seq`` is older than every other; rows that share key and ``change_seq`` are copies
of one change, of which the first delivered is taken (a null ``arrived_at`` is the last); a null
key is a key like any other; an empty log has an empty state. Columns besides the named ones are
ignored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OLDEST = -(2**63)


def is_delete(op: Column) -> Column:
    """True where ``op`` marks a delete; never null."""
    return F.coalesce(F.lower(F.trim(op)).startswith("d"), F.lit(True))


def deciding_change(
    log: DataFrame,
    keys: Mapping[str, Column],
    values: Mapping[str, Column],
    *,
    seq: str = "change_seq",
    op: str = "op",
    arrived: str | None = None,
) -> DataFrame:
    """One row per key: the keys, ``is_deleted``, ``last_seq``, the values of the deciding change and,
    with ``arrived``, ``first_arrival`` of that change.

    One aggregate, combined before its shuffle: a key with a third of the rows sends one row per
    task. Values must be orderable, as they break ties among copies.
    """
    order = [F.coalesce(F.col(seq), F.lit(OLDEST)).alias("last_seq")]
    if arrived is not None:
        order.append((-F.coalesce(F.unix_micros(arrived), F.lit(2**63 - 1))).alias("_neg"))
    parts = [*order, is_delete(F.col(op)).alias("is_deleted"), *(c.alias(f"v_{n}") for n, c in values.items())]
    best = (
        log.select(*(c.alias(f"k_{n}") for n, c in keys.items()), F.struct(*parts).alias("_c"))
        .groupBy(*(f"k_{n}" for n in keys))
        .agg(F.max("_c").alias("_c"))
    )
    out = [F.col(f"k_{n}").alias(n) for n in keys]
    out += [F.col("_c.is_deleted").alias("is_deleted"), F.col("_c.last_seq").alias("last_seq")]
    if arrived is not None:
        out.append(F.when(F.col("_c._neg") > OLDEST + 1, F.timestamp_micros(-F.col("_c._neg"))).alias("first_arrival"))
    return best.select(*out, *(F.col(f"_c.v_{n}").alias(n) for n in values))


def current_state(log: DataFrame, keys: Sequence[str], values: Sequence[str], **names: str) -> DataFrame:
    """The live records: keys, then the named values of their deciding changes."""
    found = deciding_change(log, {k: F.col(k) for k in keys}, {v: F.col(v) for v in values}, **names)
    return found.filter(~F.col("is_deleted")).select(*keys, *values)
