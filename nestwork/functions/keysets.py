"""Sets of keys, as sorted arrays of BINARY in a column or as distinct rows of a DataFrame.

Empty and null keys are never members. Arrays are kept sorted in byte order, so equal sets are equal
columns. The ``rows_`` forms work on any number of keys; the array forms on what fits a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE = "array<binary>"


def make(keys: Column) -> Column:
    """A key set of an array column: distinct, sorted, without null and empty keys; null gives the empty set."""
    kept = F.filter(F.coalesce(keys, F.array().cast(NONE)), lambda k: k.isNotNull() & (F.length(k) > 0))
    return F.array_sort(F.array_distinct(kept))


def add(keys: Column, key: Column) -> Column:
    return make(F.concat(keys, F.array(key)))


def union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def minus(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(a, b))


def intersect(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def contains(keys: Column, key: Column) -> Column:
    return F.coalesce(F.array_contains(keys, key), F.lit(False))


def contains_all(a: Column, b: Column) -> Column:
    return F.size(F.array_except(b, a)) == 0


def changed(before: Column, after: Column) -> Column:
    """Whether an add or remove did anything."""
    return ~before.eqNullSafe(after)


def size(keys: Column) -> Column:
    return F.size(keys)


def is_empty(keys: Column) -> Column:
    return F.size(keys) == 0


def collect(keys: Column) -> Column:
    """Aggregate: the key set of a group."""
    return make(F.collect_set(keys))


def rows_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of both."""
    return a.unionByName(b).distinct()


def rows_minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` that are not in ``b``."""
    return a.distinct().join(b.distinct(), a.columns, "left_anti")


def rows_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.distinct().join(b.distinct(), a.columns, "left_semi")
