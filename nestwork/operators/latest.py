"""The latest version of every record.

Changes are rows ``pk`` (bytes), ``seq``, ``key`` (struct), ``value`` (struct, null for a tombstone).
Equal ``pk`` with equal ``seq`` is one change delivered twice; which copy is taken is not defined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import encode_columns
from .filters import DELETE, SKIP, Filter, with_modes


def as_changes(df: DataFrame, keys: Sequence[str], seq: Column, deleted: Column | None = None, drop: Sequence[str] = ()) -> DataFrame:
    """Rows as changes: the key of ``keys``, the value of all columns but ``drop``, null where ``deleted``."""
    fields = [c for c in df.columns if c not in drop]
    value = F.struct(*fields)
    if deleted is not None:
        value = F.when(~F.coalesce(deleted, F.lit(False)), value)
    return df.select(encode_columns(df, keys).alias("pk"), seq.cast("long").alias("seq"), F.struct(*keys).alias("key"), value.alias("value"))


def last_changes(changes: DataFrame, entity: str = "", rules: Filter | None = None, old: DataFrame | None = None) -> DataFrame:
    """The last change of each key that is not skipped: ``pk, seq, key, value``, value null where deleted.

    One aggregate with partial combination, so frequent keys are reduced before the shuffle.
    """
    moded = with_modes(changes, entity, rules or Filter(), old=old).filter(F.col("mode") != SKIP)
    value = F.when(F.col("mode") != DELETE, F.col("value"))
    best = moded.groupBy("pk").agg(F.max_by(F.struct("seq", "key", value.alias("value")), "seq").alias("c"))
    return best.select("pk", "c.seq", "c.key", "c.value")


def latest(changes: DataFrame, entity: str = "", rules: Filter | None = None) -> DataFrame:
    """The current records: ``pk, value``."""
    return last_changes(changes, entity, rules).filter(F.col("value").isNotNull()).select("pk", "value")


def before_images(changed: DataFrame, state: DataFrame) -> DataFrame:
    """``pk, old, new`` for the last changes of a batch against the records before it."""
    return changed.select("pk", F.col("value").alias("new")).join(
        state.select("pk", F.col("value").alias("old")), "pk", "left"
    )
