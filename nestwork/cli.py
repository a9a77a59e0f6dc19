"""Command line: build documents from configured topics, verify, delete or restore state."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from . import config as settings
from .plans.relations import Relation, entities, load, local_path
from .registry import filter_of, strategy_of
from .sources import logs, sinks
from .streaming.engine import Engine, Entity
from .streaming.metrics import Reporter
from .streaming.state import State
from .streaming.streams import start


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="nestwork", description=__doc__)
    p.add_argument("--config", required=True, help="path of the YAML configuration")
    p.add_argument("--relations", required=True, nargs="+", help="paths of relation files")
    p.add_argument("--build", action="store_true", help="build documents from what is there, then end")
    p.add_argument("--continuous", action="store_true", help="with --build: go on as changes arrive")
    p.add_argument("--delete-backup", action="store_true", help="delete all backups")
    p.add_argument("--delete-state", action="store_true", help="delete the state")
    p.add_argument("--restore", action="store_true", help="restore the newest backup")
    p.add_argument("--verify-state", action="store_true", help="compare the indices with the records and end")
    return p


def inputs_of(config: dict, roots: Sequence[Relation]) -> dict[str, Entity]:
    """The input entities: each topic section gives ``keys`` and ``schema`` (a DDL string)."""
    found = {}
    for entity in entities(roots):
        section = settings.topic(config, entity)
        if not section.get("schema") or not section.get("keys"):
            raise ValueError(f"topic {entity}: keys and schema must be given")
        schema = T.StructType.fromDDL(section["schema"])
        found[entity] = Entity(list(section["keys"]), schema, filter_of(entity, schema, section))
    return found


def sink_of(config: dict, roots: Sequence[Relation]):
    """The sink of every document type by its topic's class: kafka, console, noop or parquet."""
    chosen = {}
    for root in roots:
        section = settings.topic(config, root.denormalized_name)
        kind = settings.kind(str(section.get("topic.class", "console")))
        if kind == "kafka":
            chosen[root.denormalized_name] = sinks.kafka_sink({root.denormalized_name: section})
        elif kind == "parquet":
            chosen[root.denormalized_name] = sinks.parquet_sink(str(section["path"]))
        elif kind == "noop":
            chosen[root.denormalized_name] = sinks.black_hole
        elif kind == "console":
            chosen[root.denormalized_name] = sinks.console_sink()
        else:
            raise ValueError(f"{root.denormalized_name}: {kind} is no sink")
    return sinks.by_name(chosen)


def streams_of(spark: SparkSession, config: dict, roots: Sequence[Relation]):
    found = {}
    for entity in entities(roots):
        section = settings.topic(config, entity)
        kind = settings.kind(str(section.get("topic.class", "kafka")))
        if kind == "kafka":
            found[entity] = logs.kafka_stream(spark, section)
        elif kind == "files":
            found[entity] = logs.file_stream(spark, str(section["path"]))
        else:
            raise ValueError(f"{entity}: {kind} is no streaming source")
    return found


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """Runs in the order: verify (and end), delete backups, delete state, restore, build."""
    asked = parser().parse_args(args)
    config = settings.load(local_path(asked.config).read_text())
    roots = load(asked.relations)
    spark = spark or SparkSession.builder.appName("nestwork").getOrCreate()
    s = settings.Settings.of(config)

    state = State(spark, s.state_uri, s.backup_uri, s.backups_to_keep, s.auto_rollback, s.restore_mode)
    engine = lambda: Engine(
        spark, roots, inputs_of(config, roots), state, sink_of(config, roots),
        strategy=strategy_of(config), low_budget=s.low_budget, compact_every=s.compact_every, backup_every=s.backup_every,
        budget=s.budget, create_trigger=s.create_trigger,
    )
    if asked.verify_state:
        wrong = engine().verify()
        counts = wrong.groupBy("root", "edge", "missing").count().collect()  # a row per edge at most twice
        for r in counts:
            print(f"{r['root']} {r['edge']}: {r['count']} entries lacking in what is {r['missing']}", file=sys.stderr)
        state.close()
        return 1 if counts else 0
    if asked.delete_backup:
        state.delete_backups()
    if asked.delete_state:
        state.delete()
    if asked.restore:
        state.restore()
    if asked.build:
        running = engine()
        report = Reporter(running.metrics, s.report_seconds)
        query = start(
            running, streams_of(spark, config, roots), f"{s.state_uri.rstrip('/')}-checkpoint",
            available_now=not asked.continuous, after=report, lag_trigger=s.lag_trigger,
        )
        query.awaitTermination()
        print(running.report())
        state.close()
    return 0


if __name__ == "__main__":
    sys.exit(main())
