"""Versioned state of the engine on a shared file system.

A table is a list of runs, each one folder of Parquet files that is never changed. A manifest per
version names the runs of every table with the lengths of their files; writing it is the commit. What
no manifest names doesn't exist. Backups are copies of one version; restoring copies one back, and
with ``auto_rollback`` damaged backups are deleted and older ones tried.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Files

RESTORE_MODES = ("never", "always", "when_needed")


class StateError(RuntimeError):
    """State that is missing, damaged or used wrongly."""


def restore_mode(text: str | None) -> str:
    """The mode named, ignoring case and blanks; null is ``never``."""
    mode = (text or "never").strip().lower()
    if mode not in RESTORE_MODES:
        raise ValueError(f"restore mode {text!r} is none of {RESTORE_MODES}")
    return mode


@dataclass
class Manifest:
    version: int = 0
    batch_id: int = -1
    tables: dict[str, list[dict]] = field(default_factory=dict)
    note: dict = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps(self.__dict__, sort_keys=True)


class Store(Protocol):
    """What the engine asks of a state: versions of named tables, each a list of immutable runs."""

    manifest: Manifest | None  # None while it is closed
    count: Callable[[str], None]

    @property
    def opened(self) -> Manifest: ...

    def open(self) -> None: ...

    def close(self) -> None: ...

    def runs(self, table: str) -> list[dict]: ...

    def read(self, table: str, schema: str, staged: bool = True) -> DataFrame: ...

    def read_runs(self, runs: list[dict], schema: str) -> DataFrame: ...

    def split(self, table: str, schema: str, staged: bool = True) -> tuple[DataFrame, DataFrame | None]: ...

    def stage(self, table: str, rows: DataFrame, replace: bool = False, *, sort: Sequence[str] = (), ranged: bool = False) -> dict: ...

    def commit(self, batch_id: int, **note) -> int: ...

    def rollback(self) -> None: ...

    def backup(self) -> int: ...


class State:
    """A :class:`Store` of Parquet files."""

    def __init__(
        self,
        spark: SparkSession,
        uri: str,
        backup_uri: str | None = None,
        backups_to_keep: int = 5,
        auto_rollback: bool = False,
        mode: str | None = None,
        keep_versions: int = 2,
    ):
        self.spark, self.uri = spark, uri.rstrip("/")
        self.backup_uri = backup_uri.rstrip("/") if backup_uri else None
        self.backups_to_keep, self.auto_rollback, self.mode = backups_to_keep, auto_rollback, restore_mode(mode)
        self.keep_versions = max(1, keep_versions)
        self.files = Files(spark)
        self.manifest: Manifest | None = None
        self._staged: dict[str, list[dict]] = {}
        self._replaced: set[str] = set()
        self.count: Callable[[str], None] = lambda name: None

    # -- versions

    def _numbers(self, folder: str) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names(folder) if n.endswith(".json") and n[:-5].isdigit())

    def versions(self) -> list[int]:
        return self._numbers(f"{self.uri}/manifests")

    def _load(self, base: str, number: int) -> Manifest:
        path = f"{base}/manifests/{number}.json"
        try:
            found = Manifest(**json.loads(self.files.read(path)))
        except Exception as e:
            raise StateError(f"{path}: {e}") from e
        for runs in found.tables.values():
            for run in runs:
                if self.files.sizes(f"{base}/runs/{run['name']}") != run["files"]:
                    raise StateError(f"{base}: run {run['name']} differs from its manifest")
        return found

    def open(self) -> None:
        """Open the newest version, restoring a backup first as the mode says; starts empty if there is none."""
        if self.mode == "always" and self.backups():
            self.restore()
        try:
            self._open_newest()
        except StateError:
            if self.mode != "when_needed" or not self.backups():
                raise
            self.delete(force=True)
            self.restore()
            self._open_newest()
        if self.manifest.version == 0 and self.mode == "when_needed" and self.backups():
            self.restore()
            self._open_newest()

    def _open_newest(self) -> None:
        found = self.versions()
        self.manifest = self._load(self.uri, found[-1]) if found else Manifest()

    def close(self) -> None:
        self.manifest = None
        self._staged, self._replaced = {}, set()

    @property
    def opened(self) -> Manifest:
        if self.manifest is None:
            raise StateError("the state is not open")
        return self.manifest

    # -- tables

    def tables(self) -> list[str]:
        return sorted(set(self.opened.tables) | set(self._staged))

    def runs(self, table: str) -> list[dict]:
        """Committed and staged runs, oldest first."""
        old = [] if table in self._replaced else self.opened.tables.get(table, [])
        return old + self._staged.get(table, [])

    def read(self, table: str, schema: str, staged: bool = True) -> DataFrame:
        """All runs of a table with the column ``run``, larger in newer runs; empty if there is none."""
        return self.read_runs(self.runs(table) if staged else self.opened.tables.get(table, []), schema)

    def read_runs(self, runs: list[dict], schema: str) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], f"{schema}, run int")
        return self.spark.read.schema(f"{schema}, run int").parquet(*(f"{self.uri}/runs/{r['name']}" for r in runs))

    def split(self, table: str, schema: str, staged: bool = True) -> tuple[DataFrame, DataFrame | None]:
        """The oldest run, and the later ones together (None if there are none).

        After a compaction the oldest run is nearly the whole table and the later ones are small.
        """
        runs = self.runs(table) if staged else self.opened.tables.get(table, [])
        return self.read_runs(runs[:1], schema), self.read_runs(runs[1:], schema) if runs[1:] else None

    def stage(self, table: str, rows: DataFrame, replace: bool = False, *, sort: Sequence[str] = (), ranged: bool = False) -> dict:
        """Write ``rows`` as a run of the version to be committed; ``replace`` drops the runs before it.

        Files are sorted by ``sort``, so that a lookup of few keys reads few pages of them; ``ranged``
        also gives every file a range of its own (for rows that are read from tables, as ranges are
        sampled first).
        """
        number = self.opened.version + 1
        name = f"{table.replace('/', '.').replace('|', '.')}-{number}-{uuid.uuid4().hex[:8]}"
        path = f"{self.uri}/runs/{name}"
        rows = rows.drop("run").withColumn("run", F.lit(number))
        if ranged and sort:
            rows = rows.repartitionByRange(*sort)
        if sort:
            rows = rows.sortWithinPartitions(*sort)
        rows.write.parquet(path)
        if replace:
            self._replaced.add(table)
            self._staged[table] = []
        run = {"name": name, "files": self.files.sizes(path)}
        self._staged.setdefault(table, []).append(run)
        return run

    def commit(self, batch_id: int, **note) -> int:
        """Make the staged runs a version; versions older than ``keep_versions`` are removed."""
        old = self.opened
        tables = {t: self.runs(t) for t in self.tables()}
        new = Manifest(old.version + 1, batch_id, {t: r for t, r in tables.items() if r}, note)
        self.files.write(f"{self.uri}/manifests/{new.version}.json", new.text())
        self.manifest, self._staged, self._replaced = new, {}, set()
        self._purge()
        self.count("states.committed")
        return new.version

    def rollback(self) -> None:
        """Forget what was staged."""
        for runs in self._staged.values():
            for run in runs:
                self.files.delete(f"{self.uri}/runs/{run['name']}")
        self._staged, self._replaced = {}, set()

    def _purge(self) -> None:
        found = self.versions()
        for number in found[: -self.keep_versions]:
            self.files.delete(f"{self.uri}/manifests/{number}.json")
        used = set()
        for number in found[-self.keep_versions :]:
            kept = json.loads(self.files.read(f"{self.uri}/manifests/{number}.json"))
            used |= {r["name"] for runs in kept["tables"].values() for r in runs}
        for name in self.files.names(f"{self.uri}/runs"):
            if name not in used:
                self.files.delete(f"{self.uri}/runs/{name}")

    # -- backups

    def backups(self) -> list[int]:
        """Numbers of the complete backups; the manifest is written last."""
        if not self.backup_uri:
            return []
        names = self.files.names(self.backup_uri)
        return sorted(int(n) for n in names if n.isdigit() and self.files.names(f"{self.backup_uri}/{n}/manifests"))

    def backup(self) -> int:
        """Copy the opened version; the oldest backups beyond ``backups_to_keep`` are deleted."""
        if not self.backup_uri:
            raise StateError("no place for backups is configured")
        number = max(self.backups(), default=0) + 1
        base = f"{self.backup_uri}/{number}"
        self.files.delete(base)
        for runs in self.opened.tables.values():
            for run in runs:
                self.files.copy(f"{self.uri}/runs/{run['name']}", f"{base}/runs/{run['name']}")
        self.files.write(f"{base}/manifests/{self.opened.version}.json", self.opened.text())
        self.count("backups.created")
        for old in self.backups()[: -self.backups_to_keep]:
            self.files.delete(f"{self.backup_uri}/{old}")
        return number

    def restore(self) -> int:
        """Replace the state by the newest whole backup; returns its number."""
        if self.manifest is not None:
            raise StateError("close the state before restoring")
        for number in reversed(self.backups()):
            base = f"{self.backup_uri}/{number}"
            try:
                found = self._load(base, self._numbers(f"{base}/manifests")[-1])
            except StateError:
                if not self.auto_rollback:
                    raise
                self.files.delete(base)
                continue
            self.files.delete(self.uri)
            for runs in found.tables.values():
                for run in runs:
                    self.files.copy(f"{base}/runs/{run['name']}", f"{self.uri}/runs/{run['name']}")
            self.files.write(f"{self.uri}/manifests/{found.version}.json", found.text())
            self.count("backups.restored")
            return number
        raise StateError("there is no backup to restore")

    def delete(self, force: bool = False) -> None:
        """Delete the state, which must be closed."""
        if self.manifest is not None and not force:
            raise StateError("close the state before deleting it")
        self.manifest = None
        self.files.delete(self.uri)
        self.count("states.deleted")

    def delete_backups(self) -> None:
        if self.backup_uri:
            self.files.delete(self.backup_uri)
            self.count("backups.deleted")
