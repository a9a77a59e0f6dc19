"""Counters, gauges and timers of one engine."""

from __future__ import annotations

import json
import sys
import time
from collections import defaultdict
from collections.abc import Iterable
from contextlib import contextmanager


class Metrics:
    def __init__(self):
        self.counters: dict[str, int] = defaultdict(int)
        self.gauges: dict[str, float] = {}
        self.seconds: dict[str, float] = defaultdict(float)
        self._backup = time.time()

    def mark(self, name: str, n: int = 1) -> None:
        self.counters[name] += n

    def gauge(self, name: str, value: float) -> None:
        self.gauges[name] = value

    @contextmanager
    def timed(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] += time.perf_counter() - began

    def consumed(self, entity: str, modes: dict[str, int]) -> None:
        """Changes read of an entity, by mode; skipped ones count as consumed."""
        n = sum(modes.values())
        self.mark("records.consumed", n)
        self.mark(f"records.consumed.{entity}", n)
        for mode, name in (("UPDATE", "updates"), ("SKIP", "skips"), ("DELETE", "deletes")):
            self.mark(f"filter.{name}.{entity}", modes.get(mode, 0))

    def created(self, name: str, by_priority: dict[str, int]) -> None:
        for priority, n in by_priority.items():
            for key in ("", f".{name}", f".{name}.{priority}"):
                self.mark(f"denormalized.records.created{key}", n)

    def dropped(self, name: str, n: int) -> None:
        self.mark("denormalized.records.dropped", n)
        self.mark(f"denormalized.records.dropped.{name}", n)

    def to_create(self, name: str, by_priority: dict[str, int]) -> None:
        for priority in ("HIGH", "MEDIUM", "LOW"):
            self.gauge(f"denormalized.records.to.create.{name}.{priority}", by_priority.get(priority, 0))
        self.gauge(f"denormalized.records.to.create.{name}", sum(by_priority.values()))
        single = [v for k, v in self.gauges.items() if k.startswith("denormalized.records.to.create.") and k.count(".") == 4]
        self.gauge("denormalized.records.to.create", sum(single))

    def lag(self, by_topic: dict[str, int]) -> None:
        for topic, n in by_topic.items():
            self.gauge(f"topic.lag.{topic}", n)
        self.gauge("topic.lag", sum(by_topic.values()))

    def index_sizes(self, sizes: Iterable) -> None:
        """Rows of :meth:`Engine.index_sizes` as gauges."""
        for r in sizes:
            for name in ("n_entries", "n_keys", "largest"):
                self.gauge(f"index.{name.replace('_', '.')}.{r['root']}.{r['edge']}", r[name])

    def backed_up(self) -> None:
        self._backup = time.time()

    def report(self) -> dict[str, float]:
        """All values by name."""
        self.gauge("time.since.last.backup", round((time.time() - self._backup) * 1000))
        return {**self.counters, **self.gauges, **{f"{k}.seconds": v for k, v in self.seconds.items()}}


class Reporter:
    """Called after every batch, prints the metrics as a JSON line at most every ``seconds`` (0: never)."""

    def __init__(self, metrics: Metrics, seconds: float, out=None):
        self.metrics, self.seconds, self.out, self.last = metrics, seconds, out, time.monotonic()

    def __call__(self, batch_id: int) -> None:
        if self.seconds > 0 and time.monotonic() - self.last >= self.seconds:
            self.last = time.monotonic()
            print(json.dumps(self.metrics.report(), sort_keys=True), file=self.out or sys.stderr)
