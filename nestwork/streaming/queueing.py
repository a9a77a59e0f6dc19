"""Queues of root documents to create, by priority."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIGH, MEDIUM, LOW, NONE = "HIGH", "MEDIUM", "LOW", "NONE"
RANK = {HIGH: 0, MEDIUM: 1, LOW: 2, NONE: 3}
NAMES = {v: k for k, v in RANK.items()}
QUEUE = "pk binary, rank int, since bigint"

#: ``(denormalized name, changed entity) -> priority``, or a column of it over ``pk``, the root's key bytes
Strategy = Callable[[str, str], str | Column]


def medium(name: str, entity: str) -> str:
    """The default strategy."""
    return MEDIUM


def ranked(affected: DataFrame, name: str, strategy: Strategy, entities: list[str]) -> DataFrame:
    """Affected roots (``pk, entity``) with their best rank: ``pk, rank``; a root that only entities of
    priority NONE touch has the rank of NONE and is dropped by :func:`enqueue`."""
    if not entities:
        return affected.select("pk", F.lit(RANK[NONE]).alias("rank")).limit(0)
    rank = F.lit(None).cast("int")
    for entity in entities:
        rank = F.when(F.col("entity") == entity, rank_of(strategy(name, entity))).otherwise(rank)
    return affected.groupBy("pk").agg(F.min(rank).alias("rank"))


def rank_of(priority: str | Column) -> Column:
    """A priority, fixed or per root, as its rank; an unknown one raises."""
    if isinstance(priority, str):
        return F.lit(RANK[priority])
    ranks = F.create_map(*(F.lit(x) for pair in RANK.items() for x in pair))
    return F.coalesce(ranks[priority], F.raise_error(F.lit("unknown priority")).cast("int"))


def enqueue(queue: DataFrame, new: DataFrame, batch_id: int) -> DataFrame:
    """``queue`` and the new roots, each root once with its best rank and the batch since when it waits."""
    rows = new.filter(F.col("rank") < RANK[NONE]).select("pk", "rank", F.lit(batch_id).cast("long").alias("since"))
    both = queue.select("pk", "rank", "since").unionByName(rows)
    return both.groupBy("pk").agg(F.min("rank").alias("rank"), F.min("since").alias("since"))


def drain(queue: DataFrame, low_budget: int | None, budget: int | None = None, held: int | None = None) -> DataFrame:
    """The roots to create now: all of HIGH and MEDIUM, of LOW the ``low_budget`` longest waiting (None: all).

    ``held`` lets so many of MEDIUM and of LOW wait for later, those that came last. ``budget`` bounds
    the whole, most urgent and longest waiting first.
    """
    oldest = lambda rank, n: queue.filter(F.col("rank") == RANK[rank]).orderBy("since", "pk").limit(max(0, n))
    out = queue
    if held is not None:
        counts = by_priority(queue)
        n = {rank: counts.get(rank, 0) - held for rank in (MEDIUM, LOW)}
        if low_budget is not None:
            n[LOW] = min(n[LOW], low_budget)
        out = queue.filter(F.col("rank") < RANK[MEDIUM]).unionByName(oldest(MEDIUM, n[MEDIUM])).unionByName(oldest(LOW, n[LOW]))
    elif low_budget is not None:
        out = queue.filter(F.col("rank") < RANK[LOW]).unionByName(oldest(LOW, low_budget))
    return out if budget is None else out.orderBy("rank", "since", "pk").limit(budget)


def by_priority(queue: DataFrame) -> dict[str, int]:
    return {NAMES[r["rank"]]: r["count"] for r in queue.groupBy("rank").count().collect()}  # at most 4 rows
