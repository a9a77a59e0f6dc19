"""Three-way filters of changes: update, skip or delete.

A filter maps a change to a mode. An empty or null value is always a DELETE; what a custom rule says
counts for the others. SKIP leaves state and documents alone, DELETE removes the record.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import materialize

UPDATE, SKIP, DELETE = "UPDATE", "SKIP", "DELETE"
MODES = (UPDATE, SKIP, DELETE)

#: ``(entity, new value, old value) -> mode``; a null mode means UPDATE.
Rule = Callable[[str, Column, Column], Column]
#: The same on plain dictionaries, called change by change.
Fold = Callable[[str, dict, dict | None], str | None]


@dataclass(frozen=True)
class Filter:
    """``rule`` refines the default; ``uses_old`` gives it the last version that was kept (null at first
    and after a delete).

    ``equality`` declares that a version which the rule skips is as good as the kept one for it, as
    where unchanged versions are skipped: then the version just before is taken, in one pass.
    ``fold`` is for rules that no expression can say: Python code that sees each change of a key in
    order with the last kept version. ``config`` holds the topic's settings for rules that ask for them.
    """

    rule: Rule | None = None
    uses_old: bool = False
    fold: Fold | None = None
    equality: bool = False
    config: Mapping[str, str] = field(default_factory=dict)

    def mode(self, entity: str, value: Column, old: Column) -> Column:
        own = self.rule(entity, value, old) if self.rule else F.lit(None).cast("string")
        return F.when(value.isNull(), DELETE).otherwise(F.coalesce(own, F.lit(UPDATE)))


def is_equal(new: Column, old: Column, dtype: T.StructType, ignored: Sequence[str] = ()) -> Column:
    """Whether two values agree in all fields but the ignored; two nulls do, a null and a value don't."""
    same = F.lit(True)
    for f in dtype.fields:
        if f.name not in ignored:
            same = same & new[f.name].eqNullSafe(old[f.name])
    return F.when(new.isNull() | old.isNull(), new.isNull() & old.isNull()).otherwise(same)


def skip_unchanged(dtype: T.StructType, ignored: Sequence[str] = ()) -> Filter:
    """Skips versions equal to the previous kept one, but for ignored fields."""
    return Filter(lambda _, new, old: F.when(is_equal(new, old, dtype, ignored), SKIP), uses_old=True, equality=True)


def with_modes(
    changes: DataFrame, entity: str, rules: Filter, *, pk: str = "pk", seq: str = "seq", value: str = "value", old: DataFrame | None = None
) -> DataFrame:
    """``changes`` with a column ``mode``.

    ``old`` (``pk``, ``value``) holds the versions before these changes. A rule that uses the old
    version is first held against each change's immediate predecessor. That decides a rule that
    declares ``equality``; for any other the last kept version according to these modes is taken and
    the rule held against that, until no mode changes. Each round is right for at least one more change
    of every key, so the end is exact; a rule that needs many rounds is better given as ``fold``.
    """
    if rules.fold:
        return _folded(changes, entity, rules.fold, pk, seq, value, old)
    if not rules.uses_old:
        none = F.lit(None).cast(changes.schema[value].dataType)
        return changes.withColumn("mode", rules.mode(entity, F.col(value), none))
    order = Window.partitionBy(pk).orderBy(seq)
    dtype = changes.schema[value].dataType
    known = F.lit(None).cast(dtype)
    rows = changes
    if old is not None:
        rows = rows.join(old.select(F.col(pk), F.col(value).cast(dtype).alias("_known")), pk, "left")
        known = F.col("_known")
    before = F.when(F.row_number().over(order) == 1, known).otherwise(F.lag(value).over(order))
    moded = rows.withColumn("_old", before).withColumn("mode", rules.mode(entity, F.col(value), F.col("_old")))
    if rules.equality:
        return moded.select(*changes.columns, "mode")
    # copies of a change have a fixed order, so that rounds agree
    moded = materialize(moded.select(*rows.columns, "mode", F.monotonically_increasing_id().alias("_n")), "modes")
    upto = Window.partitionBy(pk).orderBy(seq, "_n").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        kept = F.when(F.col("mode") == UPDATE, F.col(value))
        last = F.last(F.when(F.col("mode") != SKIP, F.struct(kept.alias("v"))), ignorenulls=True).over(upto)
        again = moded.withColumn("_last", last).withColumn("_old", F.when(F.col("_last").isNull(), known).otherwise(F.col("_last")["v"]))
        again = again.withColumn("_mode", rules.mode(entity, F.col(value), F.col("_old")))
        again = materialize(again.select(*rows.columns, "mode", "_mode", "_n"), "modes")
        if again.filter(F.col("mode") != F.col("_mode")).isEmpty():
            return again.select(*changes.columns, "mode")
        moded = again.drop("mode").withColumnRenamed("_mode", "mode")


def _folded(changes: DataFrame, entity: str, fold: Fold, pk: str, seq: str, value: str, old: DataFrame | None) -> DataFrame:
    """Sequential modes: keys are shuffled together and sorted, and each task walks its rows once,
    holding one version; a key with very many changes needs time but no memory."""
    first = changes.withColumn("_first", F.lit(False))
    if old is not None:
        known = old.select(F.col(pk), F.col(value).cast(changes.schema[value].dataType).alias(value), F.lit(True).alias("_first"))
        first = first.unionByName(known.join(changes.select(pk).distinct(), pk, "left_semi"), allowMissingColumns=True)
    ordered = first.repartition(pk).sortWithinPartitions(F.col(pk), F.col("_first").desc(), F.col(seq))
    columns = changes.columns

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kept = None, None
        for batch in batches:
            modes: list[str | None] = []
            rows = zip(*(batch.column(c).to_pylist() for c in (pk, value, "_first")))
            for k, new, known in rows:
                if k != key:
                    key, kept = k, None
                if known:
                    kept = new
                    modes.append(None)
                    continue
                mode = DELETE if new is None else fold(entity, new, kept) or UPDATE
                kept = new if mode == UPDATE else None if mode == DELETE else kept
                modes.append(mode)
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(modes, pa.string())], [*columns, "mode"])
            yield out.filter(pa.array([m is not None for m in modes]))

    return ordered.mapInArrow(walk, T.StructType([*changes.schema.fields, T.StructField("mode", T.StringType())]))


def mode_counts(moded: DataFrame) -> DataFrame:
    """Changes per mode: ``mode, n``."""
    return moded.groupBy("mode").agg(F.count(F.lit(1)).alias("n"))
