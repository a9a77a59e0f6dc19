"""Sinks of documents: ``(denormalized name, rows of key and value, batch id)``.

Keys are bytes, values JSON text, null for a root that is gone.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Mapping
from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class MemorySink:
    """Keeps what was written, for tests: ``rows[name]`` lists (key, value, batch id) in order."""

    def __init__(self):
        self.rows: dict[str, list[tuple[bytes, str | None, int]]] = {}

    def __call__(self, name: str, docs: DataFrame, batch_id: int) -> None:
        self.rows.setdefault(name, []).extend((bytes(r.key), r.value, batch_id) for r in docs.collect())

    def latest(self, name: str) -> dict[bytes, str | None]:
        return {k: v for k, v, _ in self.rows.get(name, [])}


def parquet_sink(path: str) -> Callable[[str, DataFrame, int], None]:
    """A folder per document type and batch; a batch that is written again replaces itself."""

    def write(name: str, docs: DataFrame, batch_id: int) -> None:
        docs.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}/batch={batch_id}")

    return write


def latest_documents(df: DataFrame) -> DataFrame:
    """From all batches of a parquet sink the documents that stand: ``key, value``."""
    best = df.groupBy("key").agg(F.max_by(F.struct("value"), "batch").alias("c"))
    return best.select("key", "c.value").filter(F.col("value").isNotNull())


def console_sink(out: TextIO | None = None) -> Callable[[str, DataFrame, int], None]:
    """Prints every document with a readable key, fetched one task's rows at a time."""

    def write(name: str, docs: DataFrame, batch_id: int) -> None:
        to = out or sys.stdout
        print(f"-- {name}, batch {batch_id}", file=to)
        for r in docs.select(F.hex("key").alias("key"), "value").toLocalIterator():
            print(f"{r.key}\t{'DELETE' if r.value is None else 'UPDATE'}\t{r.value}", file=to)

    return write


def black_hole(name: str, docs: DataFrame, batch_id: int) -> None:
    """Computes everything and keeps nothing."""
    docs.write.format("noop").mode("overwrite").save()


def kafka_sink(configs: Mapping[str, Mapping[str, object]]) -> Callable[[str, DataFrame, int], None]:
    """Produces to the topic of each document type; needs Spark's Kafka package on the class path."""

    def write(name: str, docs: DataFrame, batch_id: int) -> None:
        c = configs[name]
        options = {"kafka.bootstrap.servers": str(c["bootstrap.servers"]), "topic": str(c["topic.name"])}
        if "acks" in c:
            options["kafka.acks"] = str(c["acks"])
        docs.write.format("kafka").options(**options).save()

    return write


def by_name(sinks: Mapping[str, Callable[[str, DataFrame, int], None]]) -> Callable[[str, DataFrame, int], None]:
    """One sink per document type."""

    def write(name: str, docs: DataFrame, batch_id: int) -> None:
        sinks[name](name, docs, batch_id)

    return write
