"""The engine against the plain model: after every batch the documents sent out are those of the records."""

import random

import pytest
from model import documents, looked_up, parsed, pk_bytes
from pyspark.sql import functions as F
from pyspark.sql import types as T
from trees import FIELDS, KEYS, LISTS, SCHEMAS, TREES, child, record

from nestwork.functions.keys import encode_columns
from nestwork.operators.filters import DELETE, SKIP, Filter, skip_unchanged
from nestwork.operators.latest import as_changes
from nestwork.plans.relations import Relation
from nestwork.sources.sinks import MemorySink, black_hole
from nestwork.streaming.engine import Engine, Entity
from nestwork.streaming.state import State

DELETED_CLIPS = Filter(lambda entity, new, old: F.when(new["status"] == "deleted", DELETE))


def inputs(**rules):
    return {e: Entity(KEYS[e], T.StructType.fromDDL(s), rules.get(e, Filter())) for e, s in SCHEMAS.items()}


def changes(spark, entity, events):
    """events: (seq, record, is deleted)"""
    rows = [(*(r[f] for f in FIELDS[entity]), seq, gone) for seq, r, gone in events]
    df = spark.createDataFrame(rows, f"{SCHEMAS[entity]}, _seq long, _gone boolean")
    value = F.when(~F.col("_gone"), F.struct(*FIELDS[entity]))
    return df.select(encode_columns(df, KEYS[entity]).alias("pk"), F.col("_seq").alias("seq"), F.struct(*KEYS[entity]).alias("key"), value.alias("value"))


@pytest.mark.parametrize("seed", [1])
def test_random_batches(spark, tmp_path, seed):
    rng = random.Random(seed)
    sink = MemorySink()
    engine = Engine(spark, TREES, inputs(clip=DELETED_CLIPS), State(spark, f"file://{tmp_path}/state"), sink, compact_every=3)
    newest = {e: {} for e in SCHEMAS}
    seq = 0
    for batch_id in range(4):
        batch = {}
        for entity in SCHEMAS if batch_id == 0 else rng.sample(list(SCHEMAS), 3):
            events = []
            for _ in range(30 if batch_id == 0 else rng.choice([1, 4])):
                seq += 1
                late = seq - rng.choice([0, 0, 0, 40])  # some changes come late or twice
                events.append((late, record(entity, rng), rng.random() < 0.2))
            batch[entity] = changes(spark, entity, events)
            for s, r, gone in events:
                pk = pk_bytes(r, KEYS[entity])
                if s > newest[entity].get(pk, (-(10**9),))[0]:
                    kept = None if gone or entity == "clip" and r["status"] == "deleted" else r
                    newest[entity][pk] = (s, kept)
        assert engine.process_batch(batch, batch_id)
        records = {e: {pk: r for pk, (_, r) in rows.items() if r is not None} for e, rows in newest.items()}
        for root in TREES:
            stands = {k: parsed(v) for k, v in sink.latest(root.denormalized_name).items() if v is not None}
            assert stands == documents(records, root), (batch_id, root.denormalized_name)
            index = {(r.edge, bytes(r.fk), bytes(r.pk)) for r in engine.parent_rows(root).collect()}
            assert index == looked_up(records, root)
    assert engine.verify().isEmpty()
    assert not engine.process_batch(batch, 3)  # replayed
    m = engine.metrics.report()
    assert m["records.consumed"] == sum(v for k, v in m.items() if k.startswith("records.consumed."))
    created = "denormalized.records.created"
    assert m[created] == sum(m[f"{created}.{r.denormalized_name}"] for r in TREES) == sum(len(x) for x in sink.rows.values())
    assert m["denormalized.records.to.create"] == 0
    # a new engine on the same state goes on
    again = Engine(spark, TREES, inputs(clip=DELETED_CLIPS), State(spark, f"file://{tmp_path}/state"), sink)
    assert not again.process_batch(batch, 3)
    assert {k for k, _ in newest["list"].items() if newest["list"][k][1]} == {bytes(r.key) for r in again.documents(LISTS).collect()}


def one(entity, **fields):
    return {f: fields.get(f) for f in FIELDS[entity]}


def test_priorities(spark, tmp_path):
    """NONE leaves documents stale until something else touches them; LOW waits for its budget."""
    sink = MemorySink()
    order = {"owner": "NONE", "entry": "LOW"}
    strategy = lambda name, entity: order.get(entity) or F.when(F.col("pk") == b"\7", "NONE").otherwise("HIGH")
    engine = Engine(spark, [LISTS], inputs(), State(spark, f"file://{tmp_path}/s"), sink, strategy, low_budget=1)
    run = lambda i, **b: engine.process_batch({e: changes(spark, e, x) for e, x in b.items()}, i)
    title = lambda key: parsed(sink.latest("DenormalizedList")[key])
    run(0, owner=[(1, one("owner", owner_id=5, name="old"), False)], list=[(2, one("list", id=i, owner_id=5), False) for i in (1, 2, 7)])
    assert b"\7" not in sink.latest("DenormalizedList")  # dropped by its key
    assert [r.n_entries for r in engine.index_sizes().filter("edge = 'list/owner'").collect()] == [1]
    run(1, owner=[(3, one("owner", owner_id=5, name="new"), False)])
    assert title(b"\1")["Children"]["owner"][0]["Record"]["name"] == "old"
    assert engine.metrics.report()["denormalized.records.dropped"] == 3
    run(2, list=[(4, one("list", id=1, owner_id=5, title="t"), False)])
    assert title(b"\1")["Children"]["owner"][0]["Record"]["name"] == "new"
    assert title(b"\2")["Children"]["owner"][0]["Record"]["name"] == "old"
    n = len(sink.rows["DenormalizedList"])
    run(3, entry=[(5, one("entry", id=i, list_id=i), False) for i in (1, 2)])
    assert len(sink.rows["DenormalizedList"]) == n + 1
    assert engine.metrics.report()["denormalized.records.to.create.DenormalizedList.LOW"] == 1
    run(4)
    assert len(sink.rows["DenormalizedList"]) == n + 2
    assert engine.metrics.report()["denormalized.records.to.create"] == 0


def test_skip_unchanged_and_tombstones(spark, tmp_path):
    t = T.StructType.fromDDL(SCHEMAS["owner"])
    sink = MemorySink()
    engine = Engine(spark, [LISTS], inputs(owner=skip_unchanged(t)), State(spark, f"file://{tmp_path}/s"), sink)
    run = lambda i, **b: engine.process_batch({e: changes(spark, e, x) for e, x in b.items()}, i)
    owner = one("owner", owner_id=5, name="x")
    run(0, owner=[(1, owner, False)], list=[(2, one("list", id=1, owner_id=5), False)])
    n = len(sink.rows["DenormalizedList"])
    run(1, owner=[(3, owner, False), (4, owner, False)])
    assert len(sink.rows["DenormalizedList"]) == n
    assert engine.metrics.report()["filter.skips.owner"] == 2
    run(2, list=[(5, one("list", id=1), True), (6, one("list", id=77), True)])
    assert sink.latest("DenormalizedList") == {b"\1": None, b"\x4d": None}
    assert engine.parent_rows(LISTS).isEmpty()
    run(3, list=[(1, one("list", id=1, owner_id=5), False)])  # older than the delete
    assert sink.latest("DenormalizedList")[b"\1"] is None


def test_a_failed_batch_leaves_nothing(spark, tmp_path):
    def broken(name, docs, batch_id):
        raise OSError("full")

    state = State(spark, f"file://{tmp_path}/s")
    engine = Engine(spark, [LISTS], inputs(), state, broken)
    batch = {"list": changes(spark, "list", [(1, one("list", id=1, owner_id=5), False)])}
    with pytest.raises(OSError):
        engine.process_batch(batch, 0)
    assert state.opened.version == 0 and state.tables() == []
    engine.sink = sink = MemorySink()
    assert engine.process_batch(batch, 0) and list(sink.latest("DenormalizedList")) == [b"\1"]
    with pytest.raises(ValueError):
        engine.process_batch({"stranger": batch["list"]}, 1)


def test_slices_and_lag(spark, tmp_path):
    """A budget for all priorities; while the inputs lag, only what exceeds the trigger is created."""
    sink = MemorySink()
    order = {"list": "MEDIUM", "owner": "HIGH"}
    engine = Engine(spark, [LISTS], inputs(), State(spark, f"file://{tmp_path}/s"), sink, lambda n, e: order.get(e, "LOW"), budget=3, create_trigger=4)
    run = lambda i, lagging=False, **b: engine.process_batch({e: changes(spark, e, x) for e, x in b.items()}, i, lagging)
    made = lambda: len(sink.rows.get("DenormalizedList", []))
    run(0, lagging=True, owner=[(1, one("owner", owner_id=5), False)], list=[(2, one("list", id=i, owner_id=5 if i == 1 else None), False) for i in range(1, 7)])
    assert made() == 2  # six wait, four may
    run(1, lagging=True, owner=[(3, one("owner", owner_id=5, name="x"), False)])
    assert made() == 3 and sink.rows["DenormalizedList"][-1][0] == b"\1"  # the urgent one
    assert engine.metrics.report()["denormalized.records.to.create"] == 4
    run(2)
    assert made() == 6
    run(3)
    assert made() == 7 and engine.metrics.report()["denormalized.records.to.create"] == 0


def test_a_small_batch_reads_little_of_a_large_state(spark, tmp_path):
    """The cost of ten changes stays when the state grows tenfold, and nothing is left in the shared folder."""
    import os

    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    read = {}
    for n in (60_000, 600_000):
        tree = Relation("list", "D", None, None, (child("entry", "list_id", "id"),))
        types = {e: Entity(KEYS[e], T.StructType.fromDDL(SCHEMAS[e])) for e in ("list", "entry")}
        engine = Engine(spark, [tree], types, State(spark, f"file://{tmp_path}/s{n}"), black_hole)
        lists = spark.range(n, numPartitions=1).select("id", F.lit(1).alias("owner_id"), F.sha2(F.col("id").cast("string"), 256).alias("title"))
        entries = spark.range(n, numPartitions=1).select("id", F.col("id").alias("list_id"), F.lit(1).cast("long").alias("clip_id"), F.lit(1).alias("pos"))
        load = {"list": as_changes(lists, ["id"], F.lit(1)), "entry": as_changes(entries, ["id"], F.lit(1))}
        engine.process_batch(load, 0)
        few = {"entry": as_changes(entries.filter("id % 6000 = 7 and id < 60000").withColumn("pos", F.lit(2)), ["id"], F.lit(2))}
        few = {"entry": spark.createDataFrame(few["entry"].toArrow(), few["entry"].schema)}
        left = set(os.listdir(shared))
        before = bytes_read(spark)
        engine.process_batch(few, 1)
        read[n] = sum(v for k, v in bytes_read(spark).items() if k > max(before))
        assert set(os.listdir(shared)) == left
        assert engine.metrics.report()["denormalized.records.created"] == n + 10
    assert 0 < read[600_000] < 2 * read[60_000], read


def bytes_read(spark):
    """Bytes read from files by stage; old stages are forgotten in time."""
    store = spark._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)
    return {stages.apply(i).stageId(): stages.apply(i).inputBytes() for i in range(stages.size())}
