"""Configuration from YAML: engine settings, and one section per topic over a default section."""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

#: Settings that mean nothing here: caches, batching and threads that Spark manages itself.
UNUSED = (
    "backup.on.shutdown",
    "create.records.time.s",
    "index.lru.cache.size",
    "index.write.batch.size",
)
UNUSED_PREFIXES = ("rocks.db.compaction", "rocks.db.max", "rocks.db.memtable", "rocks.db.parallelism", "rocks.db.put", "rocks.db.log", "aws.s3")


@dataclass(frozen=True)
class Settings:
    """Engine settings. Times of the configuration count in batches here: see the README."""

    state_uri: str
    backup_uri: str | None = None
    backups_to_keep: int = 5
    auto_rollback: bool = False
    restore_mode: str = "never"
    low_budget: int | None = None
    budget: int | None = None
    create_trigger: int = 250_000
    lag_trigger: int = 1000
    report_seconds: float = 30
    compact_every: int = 16
    backup_every: int = 0

    @staticmethod
    def of(config: Mapping[str, Any]) -> Settings:
        for key in config:
            if key in UNUSED or key.startswith(UNUSED_PREFIXES):
                warnings.warn(f"the setting {key} has no effect", stacklevel=2)
        uri = config.get("state.uri", config.get("rocks.db.uri"))
        if not uri:
            raise ValueError("state.uri is not set")
        number = lambda name: None if config.get(name) is None else int(config[name])
        return Settings(
            state_uri=str(uri),
            backup_uri=config.get("state.backup.uri", config.get("rocks.db.backup.uri")),
            backups_to_keep=int(config.get("rocks.db.backups.to.keep", 5)),
            auto_rollback=bool(config.get("rocks.db.backups.auto.rollback", False)),
            restore_mode=str(config.get("rocks.db.restore.mode", "never")),
            low_budget=number("low.records.per.batch"),
            budget=number("records.per.batch"),
            create_trigger=int(config.get("create.records.trigger", 250_000)),
            report_seconds=float(config.get("metrics.report.time.s", 30)),
            lag_trigger=int(config.get("topic.lag.trigger", 1000)),
            compact_every=int(config.get("compact.every.batches", 16)),
            backup_every=int(config.get("backup.every.batches", 0)),
        )


def topic(config: Mapping[str, Any], name: str) -> dict[str, Any]:
    """A topic's settings: the default section, overridden by its own; either may be absent."""
    topics = config.get("topics") or {}
    return {**(topics.get("default") or {}), **(topics.get(name) or {})}


def kind(name: str) -> str:
    """A short name of a topic class: its last part, without ``Topic``, in lower case."""
    last = name.rpartition(".")[2]
    return {"blackhole": "noop"}.get(short := last.removesuffix("Topic").lower(), short)


def load(text: str) -> dict[str, Any]:
    import yaml

    found = yaml.safe_load(text)
    if not isinstance(found, dict):
        raise ValueError("the configuration is not a mapping")
    return found
