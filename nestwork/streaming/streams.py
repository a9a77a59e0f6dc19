"""Structured Streaming around the engine.

All inputs are united into one stream of raw rows with their entity's name, so that one query with
one checkpoint drives the engine: a micro-batch is a batch of all entities, numbered by the stream.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.logs import parse_log
from .engine import Engine, Entity


def united(inputs: Mapping[str, DataFrame]) -> DataFrame:
    """Raw logs (``key, value, part, pos``) of several entities as one, with the column ``entity``."""
    parts = [df.select(F.lit(e).alias("entity"), "key", "value", "part", "pos") for e, df in sorted(inputs.items())]
    return reduce(DataFrame.unionByName, parts)


def split(batch: DataFrame, inputs: Mapping[str, Entity]) -> dict[str, DataFrame]:
    """A united micro-batch as changes per entity; entities without rows are left out."""
    there = {r["entity"] for r in batch.select("entity").distinct().collect()}  # names of entities only
    return {e: parse_log(batch.filter(F.col("entity") == e), inputs[e].keys, inputs[e].schema) for e in sorted(there)}


def start(
    engine: Engine,
    inputs: Mapping[str, DataFrame],
    checkpoint: str,
    available_now: bool = False,
    every: str | None = None,
    after: Callable[[int], None] | None = None,
    lag_trigger: int | None = None,
) -> StreamingQuery:
    """Start the query that feeds ``engine`` from streaming raw logs; ``after`` runs after each batch.

    With ``lag_trigger``, documents wait (see :meth:`Engine.process_batch`) while more rows than that are
    known to be unread behind the batch before.
    """
    running: list[StreamingQuery] = []

    def run(batch: DataFrame, batch_id: int) -> None:
        behind = lags(running[0]) if running else {}
        engine.metrics.lag(behind)
        batch.persist()
        try:
            engine.process_batch(split(batch, engine.inputs), batch_id, lag_trigger is not None and sum(behind.values()) > lag_trigger)
        finally:
            batch.unpersist()
        if after:
            after(batch_id)

    writer = united(inputs).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif every:
        writer = writer.trigger(processingTime=every)
    running.append(writer.start())
    return running[0]


def reset(engine: Engine, checkpoint: str) -> None:
    """Forget how far the inputs were read; the next query reads them from the start.

    The engine's state stays: what it holds already has no effect when it comes again. The query must
    have stopped. Its batches are numbered from 0 again, and the state takes them again.
    """
    engine.state.files.delete(checkpoint)
    engine.state.commit(-1)


def lags(query: StreamingQuery) -> dict[str, int]:
    """Unread rows per topic after the last progress report, as far as the sources tell: of sources that
    report offsets per topic and partition the difference to the latest ones, of others nothing."""
    progress = query.lastProgress
    return behind(progress["sources"]) if progress else {}


def behind(sources: Iterable[Mapping]) -> dict[str, int]:
    """:func:`lags` of the sources of a progress report."""
    out: dict[str, int] = {}
    for source in sources:
        end, latest = (_offsets(source.get(name)) for name in ("endOffset", "latestOffset"))
        for topic, parts in latest.items():
            done = end.get(topic) or {}
            out[topic] = out.get(topic, 0) + sum(max(0, int(n) - int(done.get(p, 0))) for p, n in parts.items())
    return out


def _offsets(found) -> dict[str, dict]:
    """Offsets by topic and partition; empty if they are of another form."""
    try:
        parsed = json.loads(found) if isinstance(found, str) else found
    except ValueError:
        return {}
    return {t: p for t, p in parsed.items() if isinstance(p, dict)} if isinstance(parsed, dict) else {}


def lag(query: StreamingQuery) -> int:
    """All unread rows that :func:`lags` knows of."""
    return sum(lags(query).values())
