"""Joins and aggregates that a few very frequent keys cannot hold up."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

HEAVY_PARTS = 2000  # a key is heavy from 1/HEAVY_PARTS of the rows on, so there are no more heavy keys than that
FEW = 10_000  # compact states of no more rows are broadcast
SPREAD = 1_000_000  # a join key that makes more rows of compact states is divided


def heavy_keys(rows: DataFrame, key: str, total: int | None = None, parts: int = HEAVY_PARTS) -> DataFrame:
    """Keys holding at least 1/``parts`` of ``rows``: columns ``key``, ``n``; at most ``parts`` rows.

    Counts are combined before the shuffle. Nulls are no key. ``total`` saves the count if known.
    """
    total = rows.count() if total is None else total
    counts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") * parts >= total)


def lookup(facts: DataFrame, dim: DataFrame, key: str, heavy: DataFrame, how: str = "left") -> DataFrame:
    """``facts`` left-joined (or as ``how`` says: ``inner``) to ``dim`` (one row per ``key``), in two parts that are put together.

    Rows of heavy keys meet the dimension's rows of those keys by broadcast, which
    :func:`heavy_keys` bounds to ``HEAVY_PARTS`` rows; they are never shuffled. All other rows are
    shuffled, none of their keys being frequent. Rows with a null key stay, without a match, on the
    light side.
    """
    few = heavy.select(key)
    hot = facts.join(F.broadcast(few), key, "left_semi").join(
        F.broadcast(dim.join(F.broadcast(few), key, "left_semi")), key, how
    )
    rest = facts.join(F.broadcast(few), key, "left_anti").join(dim, key, how)
    return hot.unionByName(rest)


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_by: Sequence[str] = (),
    right_by: Sequence[str] = (),
    left_sums: Mapping[str, Column] | None = None,
    right_sums: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Aggregate of ``left`` joined to ``right`` on ``on`` without making the joined rows.

    Both inputs are aggregated to ``on`` and their group columns, the compact states are joined and
    counts multiplied (a left sum counts once for every right row and the other way round), then
    rolled up to ``left_by + right_by``. Result: the group columns, ``n_left`` and ``n_right`` (rows
    of either side that have a partner in the other's group), ``n_pairs`` (joined rows) and the sums.
    Where groups are finer than ``on``, a join key may have many on either side: a right state of at
    most ``FEW`` rows is broadcast after counting it, otherwise keys that make more than ``SPREAD`` rows
    are divided, the left groups into parts and the right ones copied to each. A table joined with
    itself is read once, its coarser state made from the finer one.

    Null ``on`` values join nothing; null group values are a group; null summands count as absent
    (a sum of nothing but nulls is null). An empty side gives an empty result. ``n_pairs`` is a
    decimal, as products of counts leave 64 bits soon.
    """
    left_sums, right_sums = dict(left_sums or {}), dict(right_sums or {})
    clash = (set(left_by) & set(right_by)) | (set(left_sums) & set(right_sums))
    if clash:
        raise ValueError(f"both sides name {sorted(clash)}")

    def compact(df: DataFrame, by: Sequence[str], sums: Mapping[str, Column], n: str) -> DataFrame:
        have = df.select(*on, *(b for b in by if b not in on), *(c.alias(k) for k, c in sums.items()))
        for k in on:
            have = have.filter(F.col(k).isNotNull())
        return have.groupBy(*dict.fromkeys([*on, *by])).agg(
            F.count(F.lit(1)).alias(n), *(F.sum(k).alias(k) for k in sums)
        )

    a = compact(left, left_by, left_sums, "n_left")
    big = "decimal(38,0)"
    if set(left_by) | set(right_by) <= set(on):
        both = a.join(compact(right, right_by, right_sums, "n_right"), list(on))
    else:
        a = materialize(a, "left-state")
        if left is right and not right_sums and set(right_by) <= {*on, *left_by}:
            b = a.groupBy(*dict.fromkeys([*on, *right_by])).agg(F.sum("n_left").alias("n_right"))
        else:
            b = compact(right, right_by, right_sums, "n_right")
        b = materialize(b, "right-state")
        both = a.join(F.broadcast(b), list(on)) if b.limit(FEW + 1).count() <= FEW else _divided_join(a, b, list(on))
    n = F.col("n_left").cast(big) * F.col("n_right").cast("decimal(19,0)")
    sums = [F.sum(F.col(k) * F.col("n_right")).alias(k) for k in left_sums]
    sums += [F.sum(F.col(k) * F.col("n_left")).alias(k) for k in right_sums]
    by = list(dict.fromkeys([*left_by, *right_by]))
    return both.groupBy(*by).agg(
        F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right"), F.sum(n).alias("n_pairs"), *sums
    )


def _divided_join(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """``a`` joined to ``b``; keys that make more than ``SPREAD`` rows are divided by a hash of the left row."""
    n = lambda df, c: df.groupBy(*on).agg(F.count(F.lit(1)).alias(c))
    made = F.col("_a").cast("decimal(38,0)") * F.col("_b")
    hot = n(a, "_a").join(n(b, "_b"), on).filter(made > SPREAD)
    hot = hot.select(*on, F.least(F.ceil(made / SPREAD), F.col("_a")).cast("int").alias("_k"))
    hot = materialize(hot, "hot-states")
    if hot.isEmpty():
        return a.join(b, on)
    left = a.join(hot, on).withColumn("_part", F.pmod(F.xxhash64(*a.columns), F.col("_k")).cast("int")).drop("_k")
    right = b.join(hot, on).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_k") - 1))).drop("_k")
    return left.join(right, [*on, "_part"]).drop("_part").unionByName(a.join(hot, on, "left_anti").join(b, on))


def key_counts(rows: DataFrame, within: str, key: str) -> DataFrame:
    """Rows per ``key`` inside each ``within`` and their share of it: ``within, key, n, total``.

    The join is a table with itself on ``within``: eagerly aggregated, one side is the counts per key and the other one total
    per ``within``, made from these counts. Null keys are left out.
    """
    have = rows.filter(F.col(key).isNotNull())
    return eager_join_aggregate(have, have, [within], left_by=[within, key]).select(
        within, key, F.col("n_left").alias("n"), F.col("n_right").alias("total")
    )
