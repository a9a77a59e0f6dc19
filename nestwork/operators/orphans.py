"""References to records that are missing, deleted, or arrived later.

Defined results: a null reference is none; a reference to a key that occurs in no row of the
target's log is ``missing``; to one whose deciding change deletes it, or whose current record the
``gone`` condition holds for, ``deleted``; to one whose every insert and update was delivered after
the first delivery of the referring record's deciding change, ``late``. The first that holds is
reported. The period is the month, in UTC, of the deciding change's own time, ``unknown`` where that
is null. Empty logs give no rows, or ``missing`` for every reference to them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize, side_by_side
from .changelog import deciding_change, is_delete
from .skew import HEAVY_PARTS, lookup


@dataclass(frozen=True)
class Reference:
    """``table``'s records, identified by ``keys`` and reported as ``rec_id``, point by ``ref`` to ``target``."""

    table: str
    keys: tuple[str, ...]
    rec_id: str
    ref: str
    target: str
    target_key: str
    gone: str | None = None  # SQL condition on the target's current record


def month_utc(ts: Column) -> Column:
    """``yyyy-MM`` in UTC whatever the session's time zone, ``unknown`` where null."""
    utc = F.to_utc_timestamp(ts, F.current_timezone())
    return F.coalesce(F.date_format(utc, "yyyy-MM"), F.lit("unknown"))


def target_summary(log: DataFrame, key: str, gone: str | None) -> DataFrame:
    """Per key of the target's log: ``ref_id``, ``live``, ``first_seen`` (earliest insert or update)."""
    gone_now = F.coalesce(F.expr(gone), F.lit(False)) if gone else F.lit(False)
    dead = is_delete(F.col("op"))
    return (
        log.select(
            F.col(key).alias("ref_id"),
            F.struct(F.coalesce("change_seq", F.lit(-(2**63))).alias("s"), (dead | gone_now).alias("dead")).alias("c"),
            F.when(~dead, F.col("arrived_at")).alias("seen"),
        )
        .groupBy("ref_id")
        .agg((~F.max("c")["dead"]).alias("live"), F.min("seen").alias("first_seen"))
    )


def live_references(log: DataFrame, r: Reference) -> DataFrame:
    """The live records of ``log`` that refer to something: ``rec_id, ref_id, period, first_arrival``."""
    state = deciding_change(
        log,
        {f"key{i}": F.col(k) for i, k in enumerate(r.keys)},
        {"rec_id": F.col(r.rec_id), "ref_id": F.col(r.ref), "ts": F.col("ts")},
        arrived="arrived_at",
    )
    state = state.filter(~F.col("is_deleted") & F.col("ref_id").isNotNull())
    return state.select("rec_id", "ref_id", month_utc(F.col("ts")).alias("period"), "first_arrival")


@dataclass(frozen=True)
class Suspects:
    """What :func:`suspects` finds of one reference."""

    live: DataFrame  # rec_id, ref_id, period, first_arrival of every live reference
    heavy: DataFrame  # ref_id: frequent keys, at most skew.HEAVY_PARTS
    states: DataFrame  # ref_id, period, all, arrived, low, high, live, first_seen of those that may be at fault


def suspects(tables: dict[str, DataFrame], r: Reference) -> Suspects:
    """References combined per key and period, without those that cannot be at fault.

    A state is a count and the bounds of the first arrivals. It is sound if its target is live and was
    there before the first of them. Heavy keys' states meet the sound targets by broadcast, all others
    by a shuffled anti-join; what is left of both is united. No single reference is shuffled by its key.
    """
    live = materialize(live_references(tables[r.table], r), "live-references")
    states = live.groupBy("ref_id", "period").agg(
        F.count(F.lit(1)).alias("all"),
        F.count("first_arrival").alias("arrived"),
        F.min("first_arrival").alias("low"),
        F.max("first_arrival").alias("high"),
    )
    states = materialize(states, "reference-states")
    targets = materialize(target_summary(tables[r.target], r.target_key, r.gone), "reference-targets")
    heavy = states.groupBy("ref_id").agg(F.sum("all").alias("n")).filter(F.col("n") * HEAVY_PARTS >= live.count()).select("ref_id")
    few = materialize(heavy, "heavy-references")
    sound = targets.filter("live").select(F.col("ref_id").alias("_id"), F.col("first_seen").alias("_seen"))
    there = (F.col("ref_id") == F.col("_id")) & ~F.coalesce(F.col("_seen") > F.col("low"), F.lit(False))
    of_few = sound.join(F.broadcast(few).withColumnRenamed("ref_id", "_id"), "_id", "left_semi")
    left = states.join(F.broadcast(few), "ref_id", "left_semi").join(F.broadcast(of_few), there, "left_anti")
    left = left.unionByName(states.join(F.broadcast(few), "ref_id", "left_anti").join(sound, there, "left_anti"))
    return Suspects(live, few, materialize(left.join(targets, "ref_id", "left"), "suspects"))


def orphan_references(tables: dict[str, DataFrame], refs: list[Reference]) -> DataFrame:
    """Every reference at fault: ``tab, rec_id, ref_id, fault, period``.

    Only the keys of :func:`suspects` are joined back to their records, heavy ones by broadcast.
    """

    def one(r: Reference) -> DataFrame:
        s = suspects(tables, r)
        keys = materialize(s.states.select("ref_id", "live", "first_seen").distinct(), "suspect-keys")
        seen = lookup(s.live, keys, "ref_id", s.heavy, how="inner")
        fault = (
            F.when(F.col("live").isNull(), "missing")
            .when(~F.col("live"), "deleted")
            .when(F.col("first_seen") > F.col("first_arrival"), "late")
        )
        return (
            seen.select(
                F.lit(r.table).alias("tab"),
                F.col("rec_id").cast("long").alias("rec_id"),
                F.col("ref_id").cast("long").alias("ref_id"),
                fault.alias("fault"),
                "period",
            )
        ).filter(F.col("fault").isNotNull())

    return reduce(DataFrame.unionByName, side_by_side(partial(one, r) for r in refs))


def orphan_counts(found: DataFrame) -> DataFrame:
    """References at fault per table, period and fault: ``tab, period, fault, n, n_keys``."""
    per_key = found.groupBy("tab", "period", "fault", "ref_id").agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy("tab", "period", "fault").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_keys")
    )


def orphan_totals(tables: dict[str, DataFrame], refs: list[Reference]) -> DataFrame:
    """As :func:`orphan_counts` of :func:`orphan_references`, from the states of :func:`suspects`.

    Only where a target's first insert falls between the bounds of a state are the single references
    counted; both counts are united.
    """

    def one(r: Reference) -> DataFrame:
        s = suspects(tables, r)
        gone = s.states.filter(F.col("live").isNull() | ~F.col("live"))
        fault = F.when(F.col("live").isNull(), "missing").otherwise("deleted")
        late = s.states.filter("live")
        whole = late.filter(F.col("first_seen") > F.col("high"))
        split = late.filter(F.col("first_seen") <= F.col("high")).select("ref_id", "first_seen").distinct()
        some = lookup(s.live, split, "ref_id", s.heavy, how="inner").filter(F.col("first_seen") > F.col("first_arrival"))
        # a key may be late as a whole in one period and in part in another
        some = some.join(late.filter(F.col("first_seen") <= F.col("high")).select("ref_id", "period"), ["ref_id", "period"], "left_semi")
        parts = [
            gone.select("ref_id", "period", fault.alias("fault"), F.col("all").alias("n")),
            whole.select("ref_id", "period", F.lit("late").alias("fault"), F.col("arrived").alias("n")),
            some.groupBy("ref_id", "period").agg(F.count(F.lit(1)).alias("n")).select("ref_id", "period", F.lit("late").alias("fault"), "n"),
        ]
        per_key = reduce(DataFrame.unionByName, parts)
        totals = per_key.groupBy("period", "fault").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_keys"))
        return totals.select(F.lit(r.table).alias("tab"), "period", "fault", "n", "n_keys")

    return reduce(DataFrame.unionByName, side_by_side(partial(one, r) for r in refs))
