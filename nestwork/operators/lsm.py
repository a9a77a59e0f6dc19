"""A log-structured merge table: sorted runs of changes, merged when read, compacted now and then.

Every run is a bucketed Spark table of its own: the newest change per key of a batch, one file per
bucket, sorted by key; a delete is kept as a tombstone. Reading merges the sorted runs: a row of one
run stands if no other run has a newer change of its key, which is a merge join of two sorted files
per bucket and pair of runs, without a shuffle, without a sort, and with one row of either side in
memory. ``append`` compacts the runs into one when there are more than ``max_runs``; compaction keeps
tombstones, as an older change of a deleted key may still arrive; only ``read`` leaves them out.

Changes may come repeatedly and in any order, within a batch or between batches; the result is the
same for every division into batches. See :mod:`changelog` for nulls; copies of one change share key
and ``change_seq`` and are alike, of any that are not, the first batch's is taken. The payload's
columns are named by the caller and may be none. ``close`` drops the tables.

Spark trusts the order of bucket files only with a setting of its own, which this module turns on for
the session; it changes plans, not results.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..storage import fresh_path, on_cleanup, remove
from .changelog import OLDEST, deciding_change

ROWS_PER_BUCKET = 2_000_000
SORTED_BUCKETS = "spark.sql.legacy.bucketedTableScan.outputOrdering"


class LsmTable:
    def __init__(
        self,
        spark: SparkSession,
        keys: Sequence[str],
        payload: Sequence[str] = (),
        buckets: int = 16,
        max_runs: int = 4,
    ):
        clash = set(keys) & set(payload) | {"change_seq", "is_deleted"} & {*keys, *payload}
        if clash:
            raise ValueError(f"clashing column names {sorted(clash)}")
        self.spark, self.keys, self.payload = spark, list(keys), list(payload)
        self.buckets, self.max_runs = buckets, max(1, max_runs)
        self.runs: list[tuple[str, str]] = []  # table and folder, oldest first
        self.written = 0
        self.null_keys = False  # whether any run has keys with nulls, which no join equates
        spark.conf.set(SORTED_BUCKETS, "true")

    def append(self, log: DataFrame) -> None:
        """Add ``log`` as a run; compaction follows when there are more than ``max_runs`` runs."""
        newest = deciding_change(log, {k: F.col(k) for k in self.keys}, {p: F.col(p) for p in self.payload})
        self.runs.append(self._write(newest.withColumnRenamed("last_seq", "change_seq")))
        if len(self.runs) > self.max_runs:
            self.compact()

    def _write(self, rows: DataFrame) -> tuple[str, str]:
        name, path = f"lsm_{uuid.uuid4().hex[:12]}", fresh_path(self.spark, "lsm")
        rows = rows.select(*self.keys, "change_seq", "is_deleted", *self.payload).repartition(self.buckets, *self.keys)
        on_cleanup(self.spark, f"DROP TABLE IF EXISTS {name}")
        seen = Observation()
        (
            rows.observe(seen, F.count_if(self._null_key()).alias("nulls")).write.format("parquet")
            .option("path", path)
            .option("maxRecordsPerFile", 0)  # one file per bucket, whatever the session says
            .bucketBy(self.buckets, *self.keys)
            .sortBy(*self.keys)
            .saveAsTable(name)
        )
        self.written += 1
        self.null_keys |= seen.get["nulls"] > 0
        return name, path

    def _null_key(self) -> F.Column:
        return reduce(lambda x, y: x | y, (F.col(k).isNull() for k in self.keys))

    def merged(self, tombstones: bool = True) -> DataFrame:
        """The newest change of every key over all runs: keys, ``change_seq``, ``is_deleted``, payload."""
        if not self.runs:
            raise ValueError("nothing was appended")
        out = reduce(DataFrame.unionByName, (self._standing(i) for i in range(len(self.runs))))
        if self.null_keys and len(self.runs) > 1:
            rows = reduce(DataFrame.unionByName, (self.spark.table(t).withColumn("_run", F.lit(-i)) for i, (t, _) in enumerate(self.runs)))
            order = F.struct(F.coalesce("change_seq", F.lit(OLDEST)), "_run")
            fields = F.struct("change_seq", "is_deleted", *self.payload)
            newest = rows.filter(self._null_key()).groupBy(*self.keys).agg(F.max_by(fields, order).alias("c"))
            out = out.filter(~self._null_key()).unionByName(newest.select(*self.keys, "c.*"))
        return out if tombstones else out.filter(~F.col("is_deleted"))

    def _standing(self, i: int) -> DataFrame:
        """The rows of run ``i`` that no other run outdates; those with nulls in the key all stand."""
        mine = self.spark.table(self.runs[i][0])
        for j, (other, _) in enumerate(self.runs):
            if j == i:
                continue
            theirs = self.spark.table(other).select(*(F.col(k).alias(f"_{n}") for n, k in enumerate(self.keys)), F.col("change_seq").alias("_seq"))
            same = [F.col(k) == F.col(f"_{n}") for n, k in enumerate(self.keys)]
            newer = F.col("_seq") >= F.col("change_seq") if j < i else F.col("_seq") > F.col("change_seq")
            mine = mine.join(theirs.hint("merge"), reduce(lambda x, y: x & y, [*same, newer]), "left_anti")
        return mine

    def read(self) -> DataFrame:
        """The current state: live keys with ``change_seq`` and payload."""
        return self.merged(tombstones=False).drop("is_deleted")

    def compact(self) -> None:
        """Merge all runs into one, tombstones included; a reader of the old runs must have finished."""
        if len(self.runs) < 2:
            return
        old, self.runs = self.runs, [self._write(self.merged())]
        self._drop(old)

    def _drop(self, runs: list[tuple[str, str]]) -> None:
        for name, path in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, path)

    def close(self) -> None:
        """Drop all tables and their files; what was read from them must have been used."""
        self._drop(self.runs)
        self.runs = []


def buckets_for(spark: SparkSession, rows: int, least: int = 8) -> int:
    """So many buckets that one holds about ``ROWS_PER_BUCKET`` rows, as far as Spark allows that many."""
    return min(max(least, -(-rows // ROWS_PER_BUCKET)), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))


def from_log(
    log: DataFrame, keys: Sequence[str], payload: Sequence[str] = (), runs: int = 6, max_runs: int = 3
) -> LsmTable:
    """The table that ``log``, delivered in ``runs`` batches by time of arrival, leaves behind.

    Every batch is an append of its own, so with more batches than ``max_runs`` the table is compacted
    between them and late changes meet what compaction left.
    """
    lo, hi, n = log.agg(
        F.min(F.unix_micros("arrived_at")), F.max(F.unix_micros("arrived_at")), F.count(F.lit(1))
    ).first()
    table = LsmTable(log.sparkSession, keys, payload, buckets=buckets_for(log.sparkSession, n), max_runs=max_runs)
    if lo is None or hi == lo:
        runs = 1
    width = 1 if lo is None else (hi - lo) // runs + 1
    at = F.coalesce(F.floor((F.unix_micros("arrived_at") - F.lit(lo)) / width), F.lit(0)) if lo is not None else F.lit(0)
    for i in range(runs):
        table.append(log.filter(at == i))
    return table
