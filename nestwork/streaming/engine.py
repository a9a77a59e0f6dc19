"""The engine: batches of changes in, changed documents out, state in between.

``process_batch`` applies all entities' changes, finds the roots whose documents they touch through
the parent indices from before, queues them by priority and builds the drained ones once. The build
reads only records below those roots. A batch that was committed is skipped when it comes again, so
a stream that replays its last batch does no harm; outputs are keyed upserts, written before the commit.

State grows by runs and is compacted every ``compact_every`` batches; latest records and indices are
never rewritten for a small batch. Runs are sorted by the key they are asked by, and the keys of a small
batch go to the scans as conditions, so such a batch reads few pages of each run, not the state.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial, reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import indices
from ..operators.filters import DELETE, MODES, SKIP, Filter, with_modes
from ..plans.builder import build, prune, to_json
from ..plans.relations import Relation, edges, entities, validate
from ..storage import is_local, kept, scratch, side_by_side
from .metrics import Metrics
from .queueing import LOW, NONE, QUEUE, RANK, Strategy, by_priority, drain, enqueue, medium, ranked
from .state import Store

PARENT = "edge string, fk binary, pk binary"
JOIN = "fk binary, pk binary, live boolean"
POINT = 256  # so many keys at most are looked up by value, which the scans' pages are pruned by; more are joined

#: ``(denormalized name, rows of key and value, batch id)``
Sink = Callable[[str, DataFrame, int], None]


@dataclass(frozen=True)
class Entity:
    """An input: its key fields, the type of its values, its filter."""

    keys: Sequence[str]
    schema: T.StructType
    rules: Filter = field(default_factory=Filter)


def conform(changes: DataFrame, schema: T.StructType) -> F.Column:
    """The value with the declared fields, by name; fields that the changes lack are null, others are left out."""
    value, has = F.col("value"), changes.schema["value"].dataType
    fields = [
        (value[f.name] if isinstance(has, T.StructType) and f.name in has.names else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ]
    return F.when(value.isNotNull(), F.struct(*fields))


def points(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows whose ``column`` is among ``keys`` (of that name): up to ``POINT`` as a pushed-down condition, more by a join."""
    few = keys.select(column).limit(POINT + 1).collect()
    if len(few) > POINT:
        return rows.join(keys.select(column), column, "left_semi")
    parts = [F.col(column) == F.lit(r[0]) for r in few if r[0] is not None] or [F.lit(False)]
    while len(parts) > 1:  # as a balanced tree
        parts = [reduce(lambda a, b: a | b, parts[i : i + 2]) for i in range(0, len(parts), 2)]
    return rows.filter(parts[0])


class Engine:
    """Maintains the documents of all ``roots``.

    Defined results: changes without a key (null or empty bytes) are no records and are left out;
    batches may be empty or name some entities only; fields are matched by name with the declared
    schema. ``seq`` decides what is newer, within a batch and between batches: a change that is not newer
    than what the state holds (delivered again, or late) has no effect. A null ``seq`` is left out.
    """

    def __init__(
        self,
        spark: SparkSession,
        roots: Sequence[Relation],
        inputs: Mapping[str, Entity],
        state: Store,
        sink: Sink,
        strategy: Strategy = medium,
        low_budget: int | None = None,
        compact_every: int = 16,
        backup_every: int = 0,
        budget: int | None = None,
        create_trigger: int = 250_000,
    ):
        self.spark, self.roots, self.inputs, self.state, self.sink = spark, validate(roots), dict(inputs), state, sink
        self.strategy, self.low_budget, self.budget, self.create_trigger = strategy, low_budget, budget, create_trigger
        self.compact_every, self.backup_every = compact_every, backup_every
        missing = set(entities(self.roots)) - set(inputs)
        if missing:
            raise ValueError(f"no input for {sorted(missing)}")
        self.join_keys = {e: sorted({x.child.join_key for r in self.roots for x in edges(r) if x.child.entity == e}) for e in entities(self.roots)}
        self.metrics = Metrics()
        state.count = self.metrics.mark
        if state.manifest is None:
            state.open()

    # -- state

    def _record_schema(self, entity: str) -> str:
        return f"pk binary, seq bigint, value {self.inputs[entity].schema.simpleString()}"

    def versions(self, entity: str, staged: bool = True, keys: DataFrame | None = None) -> DataFrame:
        """The newest version of every key ever seen, or of ``keys``: ``pk, seq, value``, value null where deleted.

        The oldest run is filtered by the keys of the later ones, not grouped with them: while these
        are small it isn't shuffled.
        """
        rows, later = self.state.split(f"latest/{entity}", self._record_schema(entity), staged)
        if keys is not None:
            rows, later = points(rows, "pk", keys), None if later is None else points(later, "pk", keys)
        rows = rows.select("pk", "seq", "value")
        if later is not None:
            newest = later.groupBy("pk").agg(F.max_by(F.struct("seq", "value"), "run").alias("c")).select("pk", "c.seq", "c.value")
            rows = rows.join(later.select("pk"), "pk", "left_anti").unionByName(newest)
        return rows

    def records(self, entity: str, staged: bool = True, keys: DataFrame | None = None) -> DataFrame:
        """The current records of an entity, or of ``keys``: ``pk, value``."""
        return self.versions(entity, staged, keys).filter(F.col("value").isNotNull()).select("pk", "value")

    def join_rows(self, entity: str, join_key: str, staged: bool = True, keys: DataFrame | None = None) -> DataFrame:
        """The stored join index of an entity's field, or what it has for ``keys`` (``fk``): ``fk, pk``."""
        rows, later = self.state.split(f"join/JK|{entity}|{join_key}", JOIN, staged)
        if keys is not None:
            rows, later = points(rows, "fk", keys), None if later is None else points(later, "fk", keys)
        rows = rows.select("fk", "pk", "live")
        if later is not None:
            newest = later.groupBy("fk", "pk").agg(F.max_by("live", "run").alias("live"))
            rows = rows.join(later.select("fk", "pk"), ["fk", "pk"], "left_anti").unionByName(newest)
        return rows.filter("live").select("fk", "pk")

    def parent_rows(self, root: Relation, staged: bool = True) -> DataFrame:
        """The current parent index of a root: ``edge, fk, pk``. A root's rows of its newest run count."""
        rows, later = self.state.split(f"parent/{root.denormalized_name}", PARENT, staged)
        if later is not None:
            newest = later.groupBy("pk").agg(F.max("run").alias("run"))
            rows = rows.join(newest.select("pk"), "pk", "left_anti").unionByName(later.join(newest, ["pk", "run"], "left_semi"))
        return rows.filter(F.col("edge").isNotNull()).select("edge", "fk", "pk")

    def parent_hits(self, root: Relation, edge: str, keys: DataFrame) -> DataFrame:
        """The roots that looked up one of ``keys`` (``fk``) at ``edge``, before this batch: ``pk``."""
        table = f"parent/{root.denormalized_name}"
        rows = self.state.read(table, PARENT, staged=False)
        hits = points(rows.filter(F.col("edge") == edge), "fk", keys).select("pk", "run").distinct()
        if len(self.state.opened.tables.get(table, [])) < 2:
            return hits.select("pk")
        # every run but the first marks the roots that it built: older rows of these are outdated
        hits = kept(hits, "hits")
        marks = points(rows.filter(F.col("edge").isNull()), "pk", hits.select("pk").distinct())
        marks = marks.groupBy("pk").agg(F.max("run").alias("_newest"))
        return hits.join(marks, "pk", "left").filter(F.col("run") >= F.coalesce("_newest", "run")).select("pk").distinct()

    def queue(self, root: Relation, staged: bool = True) -> DataFrame:
        return self.state.read(f"queue/{root.denormalized_name}", QUEUE, staged).select("pk", "rank", "since")

    # -- batches

    def process_batch(self, batch: Mapping[str, DataFrame], batch_id: int, lagging: bool = False) -> bool:
        """Apply a batch (per entity ``pk, seq, key, value``); False if it was applied before.

        While the inputs are ``lagging``, only HIGH documents and what exceeds ``create_trigger`` are created.
        Intermediate tables are removed with the batch.
        """
        if batch_id <= self.state.opened.batch_id:
            return False
        unknown = set(batch) - set(self.inputs)
        if unknown:
            raise ValueError(f"changes of unknown entities {sorted(unknown)}")
        try:
            with self.metrics.timed("batch"), scratch(self.spark):
                self._apply(batch, batch_id, lagging)
        except BaseException:
            self.state.rollback()
            raise
        return True

    def _apply(self, batch: Mapping[str, DataFrame], batch_id: int, lagging: bool) -> None:
        empty = not self.state.opened.tables
        mine = [e for e in entities(self.roots) if e in batch]
        taken = side_by_side(partial(self._take, e, batch[e]) for e in mine)
        images = {e: found[0] for e, found in zip(mine, taken) if found is not None}
        small = all(found is None or found[1] for found in taken)
        tables = {e: self.records(e) for e in entities(self.roots)}
        if empty and not lagging:  # every root is new: no parent index to ask, nothing to prune
            for root in self.roots:
                self._create_all(root, tables, images, batch_id)
        else:
            for root in self.roots:
                self._create(root, tables, self._affected(root, tables, images, small), list(images), batch_id, lagging, small)
        if self.compact_every and (self.state.opened.version + 1) % self.compact_every == 0:
            self.compact()
        with self.metrics.timed("states.committed"):
            self.state.commit(batch_id)
        if self.backup_every and self.state.opened.version % self.backup_every == 0:
            self.backup()

    def _take(self, entity: str, changes: DataFrame) -> tuple[DataFrame, bool] | None:
        """Filter and reduce an entity's changes, stage them as a run; the images before and after, and whether they are few."""
        known, first = self.inputs[entity], not self.state.opened.tables.get(f"latest/{entity}")
        changes = changes.filter((F.length("pk") > 0) & F.col("seq").isNotNull()).select("pk", "seq", conform(changes, known.schema).alias("value"))
        old = None
        if (known.rules.uses_old or known.rules.fold) and not first:
            changes = kept(changes, "changes")
            old = kept(self.versions(entity, staged=False, keys=changes.select("pk").distinct()), "old")
        seen = Observation()
        counted = {m: F.count_if(F.col("mode") == m).alias(m) for m in MODES}
        moded = with_modes(changes, entity, known.rules, old=old).observe(seen, *counted.values())
        value = F.when(F.col("mode") != DELETE, F.col("value"))
        last = moded.filter(F.col("mode") != SKIP).groupBy("pk").agg(F.max_by(F.struct("seq", value.alias("value")), "seq").alias("c"))
        last = last.select("pk", "c.seq", "c.value")
        none, small = F.lit(None).cast(known.schema), False
        if first:
            run = self.state.stage(f"latest/{entity}", last, sort=["pk"])
            image = self.state.read_runs([run], self._record_schema(entity)).select("pk", none.alias("old"), F.col("value").alias("new"))
        else:
            last = kept(last, "last")
            small = is_local(last)
            had = self.versions(entity, staged=False, keys=last.select("pk")) if old is None else old
            newer = last.join(had.select("pk", F.col("seq").alias("_had"), F.col("value").alias("old")), "pk", "left")
            newer = newer.filter(F.col("_had").isNull() | (F.col("seq") > F.col("_had")))
            image = kept(newer.select("pk", "seq", "old", F.col("value").alias("new")), "images", small)
            self.state.stage(f"latest/{entity}", image.select("pk", "seq", F.col("new").alias("value")), sort=["pk"])
            image = image.select("pk", "old", "new")
        modes = {m: n for m, n in seen.get.items() if n}
        self.metrics.consumed(entity, modes)
        for key in self.join_keys[entity]:
            moved = indices.join_changes(image, image.select(F.col("new").alias("value")), key)
            self.state.stage(f"join/JK|{entity}|{key}", moved, sort=["fk"])
        return (image, small) if set(modes) - {SKIP} else None

    def _affected(self, root: Relation, tables, images: Mapping[str, DataFrame], small: bool = True) -> DataFrame:
        """:func:`indices.affected_roots` by lookups in the stored parent index: ``pk, entity``."""
        parts = []
        for entity, image in images.items():
            if entity == root.entity:
                parts.append(image.select("pk", F.lit(entity).alias("entity")))
            for e in edges(root):
                if e.child.entity == entity:
                    both = [indices.index_key(tables[entity], e.child.join_key, F.col(x)) for x in ("old", "new")]
                    keys = image.select(F.explode(F.array(*both)).alias("fk")).filter("fk is not null").distinct()
                    hits = self.parent_hits(root, e.id, kept(keys, "keys", small))
                    parts.append(hits.select("pk", F.lit(entity).alias("entity")))
        if not parts:
            return self.spark.createDataFrame([], "pk binary, entity string")
        return reduce(DataFrame.unionByName, parts).distinct()

    def _create_all(self, root: Relation, tables, images, batch_id: int) -> None:
        name = root.denormalized_name
        priority = self.strategy(name, root.entity)
        pks = tables[root.entity].select("pk")
        n = pks.count()
        if not isinstance(priority, str) or priority == NONE or self.low_budget is not None and priority == LOW or self.budget is not None:
            self._create(root, tables, pks.withColumn("entity", F.lit(root.entity)), [root.entity], batch_id)
            return
        self.sink(name, to_json(build(tables, root)), batch_id)
        self.state.stage(f"parent/{name}", indices.parent_index(tables, root), sort=["edge", "fk"])
        self.metrics.created(name, {priority: n})
        self.metrics.to_create(name, {})

    def _create(self, root: Relation, tables, affected: DataFrame, changed: list[str], batch_id: int, lagging: bool = False, small: bool = False) -> None:
        name = root.denormalized_name
        new = kept(ranked(affected, name, self.strategy, changed), "affected", small)
        small = is_local(new)
        found = by_priority(new)
        self.metrics.dropped(name, found.pop(NONE, 0))
        waiting = bool(self.state.runs(f"queue/{name}"))
        if waiting or lagging or self.low_budget is not None or self.budget is not None:
            queued = kept(enqueue(self.queue(root), new, batch_id), "queue", small)
            now = kept(drain(queued, self.low_budget, self.budget, self.create_trigger if lagging else None), "drained", small or is_local(queued))
            drained = by_priority(now)
            rest = queued.join(now.select("pk"), "pk", "left_anti")
            left = by_priority(rest)
        else:  # nothing waited, nothing has to
            now, drained, left = new.filter(F.col("rank") < RANK[NONE]), found, {}
        if drained:
            pks = now.select("pk")
            mine = {**tables, root.entity: self.records(root.entity, keys=pks)}
            below = prune(mine, root, pks, lambda df: kept(df.select("pk", "value"), "below", small), self._fetch)
            self.sink(name, to_json(build(tables, root, pks, below)), batch_id)
            none = F.lit(None)
            marks = pks.select(none.cast("string").alias("edge"), none.cast("binary").alias("fk"), "pk")
            rows = indices.parent_index(tables, root, pks, below).unionByName(marks)
            self.state.stage(f"parent/{name}", rows, sort=["edge", "fk", "pk"])
            self.metrics.created(name, drained)
        self.metrics.to_create(name, left)
        if left or waiting:
            self.state.stage(f"queue/{name}", rest, replace=True)

    def _fetch(self, child: Relation, keys: DataFrame) -> DataFrame | None:
        """A child's records by the stored join index, where the keys are few."""
        keys = kept(keys, "keys")
        if keys.limit(POINT + 1).count() > POINT:
            return None
        pks = kept(self.join_rows(child.entity, child.join_key, keys=keys).select("pk").distinct(), "children")
        return self.records(child.entity, keys=pks)

    def compact(self) -> None:
        """Rewrite tables of several runs as one, without outdated versions and index rows, every file a range of keys.

        Tombstones stay: they are what tells an older change that comes late from a new record.
        """
        for entity in entities(self.roots):
            if len(self.state.runs(f"latest/{entity}")) > 1:
                self.state.stage(f"latest/{entity}", self.versions(entity), replace=True, sort=["pk"], ranged=True)
            for key in self.join_keys[entity]:
                if len(self.state.runs(f"join/JK|{entity}|{key}")) > 1:
                    rows = self.join_rows(entity, key).withColumn("live", F.lit(True))
                    self.state.stage(f"join/JK|{entity}|{key}", rows, replace=True, sort=["fk"], ranged=True)
        for root in self.roots:
            if len(self.state.runs(f"parent/{root.denormalized_name}")) > 1:
                self.state.stage(f"parent/{root.denormalized_name}", self.parent_rows(root), replace=True, sort=["edge", "fk"], ranged=True)

    # -- upkeep

    def backup(self) -> int:
        with self.metrics.timed("backups.created"):
            number = self.state.backup()
        self.metrics.backed_up()
        return number

    def verify(self) -> DataFrame:
        """What the stored parent and join indices and those computed from the records disagree on.

        ``root`` (or the join index's name)``, edge, fk, pk, missing``: ``stored`` rows are lacking from the state, ``computed`` ones
        stand there without reason. Roots still queued, or dropped by priority NONE, differ rightly.
        """
        out = None
        on = ["edge", "fk", "pk"]
        for root in self.roots:
            stored = self.parent_rows(root)
            computed = indices.parent_index({e: self.records(e) for e in entities([root])}, root)
            lost = computed.join(stored, on, "left_anti").withColumn("missing", F.lit("stored"))
            extra = stored.join(computed, on, "left_anti").withColumn("missing", F.lit("computed"))
            both = lost.unionByName(extra).select(F.lit(root.denormalized_name).alias("root"), *on, "missing")
            out = both if out is None else out.unionByName(both)
        for entity, keys in self.join_keys.items():
            for key in keys:
                table = self.records(entity)
                computed = table.select(indices.index_key(table, key).alias("fk"), "pk").filter("fk is not null")
                stored = self.join_rows(entity, key)
                lost = computed.join(stored, ["fk", "pk"], "left_anti").withColumn("missing", F.lit("stored"))
                both = lost.unionByName(stored.join(computed, ["fk", "pk"], "left_anti").withColumn("missing", F.lit("computed")))
                out = out.unionByName(both.select(F.lit(f"JK|{entity}|{key}").alias("root"), F.lit(None).cast("string").alias("edge"), "fk", "pk", "missing"))
        return out

    def index_sizes(self) -> DataFrame:
        """Sizes of the entries of all parent indices: ``root, edge, n_entries, n_keys, largest``."""
        out = None
        for root in self.roots:
            sizes = indices.entry_sizes(self.parent_rows(root), "edge").select(F.lit(root.denormalized_name).alias("root"), "*")
            out = sizes if out is None else out.unionByName(sizes)
        return out

    def documents(self, root: Relation) -> DataFrame:
        """All documents from the current records: ``key, value``."""
        return to_json(build({e: self.records(e) for e in entities([root])}, root))

    def report(self, with_indices: bool = False) -> str:
        """The metrics as JSON; with the sizes of the indices if asked, which reads these."""
        if with_indices:
            self.metrics.index_sizes(self.index_sizes().collect())  # a row per edge
        return json.dumps(self.metrics.report(), sort_keys=True)
