import json
import warnings

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from trees import FIELDS, KEYS, LISTS, SCHEMAS

from nestwork import cli, config, registry
from nestwork.operators.filters import Filter
from nestwork.operators.latest import latest
from nestwork.sources import logs, sinks
from nestwork.streaming.engine import Engine, Entity
from nestwork.streaming.state import State
from nestwork.streaming.metrics import Metrics
from nestwork.streaming.streams import behind, lag, reset, start

N = T.StructType().add("id", "long").add("name", "string").add("more", T.ArrayType(T.IntegerType()))


def test_json_records(spark, rows):
    texts = [None, "", " ", "null", "{}", "{ }", '{"id":1,"name":null}', ' {"id":2,"x":1,"more":[1,2]}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("v", logs.parse_record(F.col("t"), N))
    assert [r.v.id if r.v else None for r in df.orderBy("i").collect()] == [None] * 6 + [1, 2]


@pytest.mark.parametrize("text", ["5", '"a"', "[1]", "{oops", "true"])
def test_what_is_no_object_raises(spark, text):
    with pytest.raises(Exception, match="not a JSON object"):
        spark.createDataFrame([(text,)], "t string").select(logs.parse_record(F.col("t"), N)).collect()


def test_the_console_prints_everything(spark):
    import io

    out = io.StringIO()
    sinks.console_sink(out)("D", spark.range(57).select(F.encode(F.col("id").cast("string"), "UTF-8").alias("key"), F.when(F.col("id") > 0, "{}").alias("value")), 3)
    lines = out.getvalue().splitlines()
    assert lines[0] == "-- D, batch 3" and len(lines) == 58 and "30\tDELETE\tNone" in lines and "3536\tUPDATE\t{}" in lines


def test_memory_log_positions_and_lag(spark, rows):
    raw = logs.memory_log(spark, [(f'{{"id":{i % 4}}}', f'{{"id":{i % 4},"name":"{i}"}}') for i in range(10)], first=100)
    assert raw.select("part").distinct().count() <= 3
    assert rows(latest(logs.parse_log(raw, ["id"], N)), "value.id", "value.name") == [(0, "8"), (1, "9"), (2, "6"), (3, "7")]
    assert sum(r.n for r in logs.lag(raw, {}).collect()) == 10
    done = {r.part: r.next for r in logs.next_positions(raw).collect()}
    assert sum(r.n for r in logs.lag(raw, done).collect()) == 0
    assert sum(r.n for r in logs.lag(raw, {p: 105 for p in done}).collect()) == 5
    found = logs.by_key(latest(logs.parse_log(raw, ["id"], N)), spark.createDataFrame([(bytearray(b"\2"),), (bytearray(b"\x63"),)], "pk binary"))
    assert rows(found, "value.name") == [("6",)]


def test_pairs_file():
    assert logs.pairs_file(["k1\n", "v1\n", "k2\n", "\n", "k3\n"]) == [("k1", "v1"), ("k2", None), ("k3", None)]


def test_kafka_options():
    c = {"bootstrap.servers": "b:1", "topic.name": "t", "auto.offset.reset": "latest", "group.id": "g", "fetch.min.bytes": 5, "topic.lag.trigger": 7, "keys": ["id"]}
    assert logs.kafka_options(c) == {
        "kafka.bootstrap.servers": "b:1", "subscribe": "t", "startingOffsets": "earliest", "kafka.fetch.min.bytes": "5", "maxOffsetsPerTrigger": "7",
    }


def test_sinks(spark, rows, tmp_path, capsys):
    docs = spark.createDataFrame([(bytearray(b"\1"), '{"a":1}'), (bytearray(b"\2"), None)], "key binary, value string")
    memory, hole = sinks.MemorySink(), []
    write = sinks.by_name({"A": memory, "B": sinks.parquet_sink(f"{tmp_path}"), "C": sinks.console_sink(), "D": sinks.black_hole})
    for name in "ABCD":
        write(name, docs, 3)
    assert memory.latest("A") == {b"\1": '{"a":1}', b"\2": None} and hole == []
    write("B", docs, 3)  # once more
    write("B", docs.select("key", F.lit("new").alias("value")).limit(0), 4)
    stored = spark.read.parquet(f"{tmp_path}/B")
    assert stored.count() == 2
    assert rows(sinks.latest_documents(stored), "value") == [('{"a":1}',)]
    assert "C, batch 3" in capsys.readouterr().out
    with pytest.raises(KeyError):
        write("E", docs, 1)


def test_settings_and_topics():
    c = config.load("""
rocks.db.uri: file:///s
rocks.db.backup.uri: file:///b
rocks.db.restore.mode: Always
index.lru.cache.size: 1
low.records.per.batch: 9
topics:
  default: {topic.class: a.b.KafkaTopic, client.id: x}
  clip: {client.id: y, topic.name: clip}
""")
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        s = config.Settings.of(c)
    assert (s.state_uri, s.backup_uri, s.low_budget, s.lag_trigger) == ("file:///s", "file:///b", 9, 1000)
    assert ["index.lru.cache.size" in str(w.message) for w in seen] == [True]
    assert config.topic(c, "clip") == {"topic.class": "a.b.KafkaTopic", "client.id": "y", "topic.name": "clip"}
    assert config.topic(c, "other")["client.id"] == "x" and config.topic({}, "x") == {}
    assert [config.kind(k) for k in ("a.KafkaTopic", "BlackHoleTopic", "ConsoleTopic", "parquet")] == ["kafka", "noop", "console", "parquet"]
    with pytest.raises(ValueError):
        config.Settings.of({})
    with pytest.raises(ValueError):
        config.load("- 1")


def event(entity, pos, gone=False, **fields):
    value = {f: fields.get(f) for f in FIELDS[entity]}
    return {"key": json.dumps({k: fields[k] for k in KEYS[entity]}), "value": None if gone else json.dumps(value), "part": 0, "pos": pos}


def put(folder, name, events):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(e) + "\n" for e in events))


def test_stream_and_restart(spark, tmp_path):
    folders = {e: tmp_path / e for e in SCHEMAS}
    for f in folders.values():
        f.mkdir()
    put(folders["list"], "1.json", [event("list", 1, id=1, owner_id=5, title="t")])
    put(folders["owner"], "1.json", [event("owner", 1, owner_id=5, name="a")])

    def run(sink):
        types = {e: Entity(KEYS[e], T.StructType.fromDDL(s)) for e, s in SCHEMAS.items()}
        engine = Engine(spark, [LISTS], types, State(spark, f"file://{tmp_path}/state"), sink)
        raw = {e: logs.file_stream(spark, str(f), 1) for e, f in folders.items()}
        query = start(engine, raw, str(tmp_path / "checkpoint"), available_now=True)
        query.awaitTermination()
        assert lag(query) == 0
        return engine

    first = sinks.MemorySink()
    run(first)
    assert json.loads(first.latest("DenormalizedList")[b"\1"])["Children"]["owner"][0]["Record"]["name"] == "a"
    put(folders["owner"], "2.json", [event("owner", 2, owner_id=5, name="b")])
    second = sinks.MemorySink()
    engine = run(second)
    assert len(second.rows["DenormalizedList"]) == 1  # only what changed
    assert json.loads(second.latest("DenormalizedList")[b"\1"])["Children"]["owner"][0]["Record"]["name"] == "b"
    assert engine.verify().isEmpty()
    reset(engine, str(tmp_path / "checkpoint"))
    third = sinks.MemorySink()
    assert run(third).verify().isEmpty()
    assert not third.rows.get("DenormalizedList")  # read again, but nothing is new


def test_command_line(spark, tmp_path, capsys):
    tree = {"DenormalizedName": "Doc", "Entity": "list", "Children": [{"Entity": "owner", "JoinKey": "owner_id", "ParentKey": "owner_id"}]}
    (tmp_path / "tree.json").write_text(json.dumps([tree]))
    put(tmp_path / "list", "1.json", [event("list", 1, id=1, owner_id=5)])
    put(tmp_path / "owner", "1.json", [event("owner", 1, owner_id=5, name="a")])
    sections = "".join(f"  {e}: {{topic.class: files, path: {tmp_path}/{e}, keys: {KEYS[e]}, schema: '{SCHEMAS[e]}'}}\n" for e in ("list", "owner"))
    (tmp_path / "c.yaml").write_text(
        f"state.uri: file://{tmp_path}/state\nstate.backup.uri: file://{tmp_path}/backup\nbackup.every.batches: 1\ntopics:\n"
        f"  Doc: {{topic.class: parquet, path: {tmp_path}/out}}\n{sections}"
    )
    args = ["--config", str(tmp_path / "c.yaml"), "--relations", str(tmp_path / "tree.json")]
    assert cli.main([*args, "--build"], spark) == 0
    assert spark.read.parquet(f"{tmp_path}/out/Doc").count() == 1
    assert '"denormalized.records.created": 1' in capsys.readouterr().out
    assert cli.main([*args, "--verify-state"], spark) == 0
    assert cli.main([*args, "--delete-state"], spark) == 0
    assert not (tmp_path / "state").exists()
    assert cli.main([*args, "--restore"], spark) == 0
    assert cli.main([*args, "--verify-state"], spark) == 0
    assert cli.main([*args, "--delete-backup"], spark) == 0
    assert not (tmp_path / "backup").exists()
    with pytest.raises(SystemExit):
        cli.main(["--help"], spark)


def test_command_line_with_filter_and_strategy(spark, tmp_path):
    """What the configuration names is applied; what it names in vain raises."""
    registry.register_filter("no.b", lambda entity, schema, c: Filter(lambda e, new, old: F.when(new["name"] == c["unwanted"], "DELETE")))
    registry.register_strategy("owners.wait", lambda name, entity: "NONE" if entity == "owner" else "HIGH")
    tree = {"DenormalizedName": "Doc", "Entity": "list", "Children": [{"Entity": "owner", "JoinKey": "owner_id", "ParentKey": "owner_id"}]}
    (tmp_path / "tree.json").write_text(json.dumps([tree]))
    put(tmp_path / "list", "1.json", [event("list", i, id=i, owner_id=4 + i) for i in (1, 2)])
    put(tmp_path / "owner", "1.json", [event("owner", 1, owner_id=5, name="a"), event("owner", 2, owner_id=6, name="b")])

    def text(**names):
        own = {"list": "", "owner": f", filter.class: {names.get('filter', 'no.b')}, unwanted: b"}
        sections = "".join(f"  {e}: {{topic.class: files, path: {tmp_path}/{e}, keys: {KEYS[e]}, schema: '{SCHEMAS[e]}'{x}}}\n" for e, x in own.items())
        head = f"state.uri: file://{tmp_path}/state\nqueueing.strategy.class: {names.get('strategy', 'owners.wait')}\nmetrics.report.time.s: 0.001\ntopics:\n"
        (tmp_path / "c.yaml").write_text(f"{head}  Doc: {{topic.class: parquet, path: {tmp_path}/out}}\n{sections}")
        return ["--config", str(tmp_path / "c.yaml"), "--relations", str(tmp_path / "tree.json")]

    def names():
        stored = sinks.latest_documents(spark.read.parquet(f"{tmp_path}/out/Doc"))
        docs = [json.loads(r.value) for r in stored.collect()]
        return sorted((d["Record"]["id"], [o["Record"]["name"] for o in d["Children"]["owner"]]) for d in docs)

    for wrong in ({"filter": "who.knows"}, {"strategy": "who.knows"}, {"filter": "nestwork.registry:nothing"}):
        with pytest.raises(ValueError, match="who.knows|nothing"):
            cli.main([*text(**wrong), "--build"], spark)
    assert cli.main([*text(), "--build"], spark) == 0
    assert names() == [(1, ["a"]), (2, [])]  # the unwanted owner is deleted
    put(tmp_path / "owner", "2.json", [event("owner", 3, owner_id=5, name="c")])
    assert cli.main([*text(), "--build"], spark) == 0
    assert names() == [(1, ["a"]), (2, [])]  # changes of owners are dropped: the document is stale
    put(tmp_path / "list", "2.json", [event("list", 4, id=1, owner_id=5)])
    assert cli.main([*text(), "--build"], spark) == 0
    assert names() == [(1, ["c"]), (2, [])]
    assert registry.filter_of("e", N, {"filter.class": "a.b.DefaultFilter"}).rule is None
    assert registry.filter_of("e", N, {"filter.class": "skip.unchanged"}).equality
    assert registry.strategy_of({})("D", "e") == "MEDIUM"


def test_lag_of_sources():
    kafka = {"endOffset": '{"t": {"0": 5, "1": 7}}', "latestOffset": '{"t": {"0": 9, "1": 7, "2": 4}, "u": {"0": 1}}'}
    files = {"endOffset": '{"logOffset": 3}', "latestOffset": None}
    assert behind([kafka, files, {"endOffset": 5, "latestOffset": "nonsense"}]) == {"t": 8, "u": 1}
    m = Metrics()
    m.lag({"t": 8, "u": 1})
    assert m.report()["topic.lag"] == 9 and m.report()["topic.lag.t"] == 8


def test_record_text(spark, rows):
    df = spark.createDataFrame([(bytearray(b'{"id":1}'),), (None,)], "value binary")
    assert rows(df.select(logs.record_text(F.col("value"), {"value.serde.class": "a.JsonSerde"}, "value"))) == [('{"id":1}',), (None,)]
    with pytest.raises(ValueError, match="value.avro.schema"):
        logs.record_text(F.col("value"), {"value.serde.class": "a.AvroSerde"}, "value")
    assert "kafka.value.avro.schema" not in logs.kafka_options({"bootstrap.servers": "b", "topic.name": "t", "value.avro.schema": "{}"})
