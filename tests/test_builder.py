"""Documents and indices of random records against the plain model; the edge cases one by one."""

import json
import random

import pytest
from model import document, documents, key_bytes, looked_up, parsed, pk_bytes
from pyspark.sql import functions as F
from pyspark.sql import types as T
from trees import CLIPS, FIELDS, KEYS, LISTS, SCHEMAS, TREES, record

from nestwork.functions.keys import encode_columns
from nestwork.operators import indices
from nestwork.plans.builder import build, to_json
from nestwork.plans.relations import Relation


def as_tables(spark, records):
    out = {}
    for entity, schema in SCHEMAS.items():
        rows = [tuple(r[f] for f in FIELDS[entity]) for r in records[entity].values()]
        df = spark.createDataFrame(rows, schema)
        out[entity] = df.select(encode_columns(df, KEYS[entity]).alias("pk"), F.struct(*df.columns).alias("value"))
    return out


def random_records(seed, n=25):
    rng = random.Random(seed)
    made = {e: [record(e, rng) for _ in range(n)] for e in SCHEMAS}
    return {e: {pk_bytes(r, KEYS[e]): r for r in rs} for e, rs in made.items()}


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("root", TREES, ids=lambda r: r.denormalized_name)
def test_random_documents_and_indices(spark, seed, root):
    records = random_records(seed)
    tables = as_tables(spark, records)
    got = {bytes(r.key): parsed(r.value) for r in to_json(build(tables, root)).collect()}
    assert got == documents(records, root)
    some = [*list(records[root.entity])[:3], b"\x63\x63"]
    asked = spark.createDataFrame([(bytearray(k),) for k in some + some[:1]], "pk binary")
    got = [(bytes(r.key), parsed(r.value)) for r in to_json(build(tables, root, asked)).collect()]
    assert sorted(got, key=repr) == sorted(((k, document(records, root, k)) for k in some), key=repr)

    index = indices.parent_index(tables, root)
    rows = {(r.edge, bytes(r.fk), bytes(r.pk)) for r in index.collect()}
    assert rows == looked_up(records, root)
    part = {(r.edge, bytes(r.fk), bytes(r.pk)) for r in indices.parent_index(tables, root, asked).collect()}
    assert part == {x for x in rows if x[2] in some}


def test_join_index_both_ways(spark):
    records = random_records(3)
    index = indices.join_index(as_tables(spark, records), TREES)
    want = set()
    for root in TREES:
        for rel in root.walk():
            for c in rel.children:
                want |= {(f"JK|{c.entity}|{c.join_key}", key_bytes(r[c.join_key]), pk) for pk, r in records[c.entity].items() if r[c.join_key] is not None}
    assert {(r["index"], bytes(r.fk), bytes(r.pk)) for r in index.collect()} == want
    fwd, rev = indices.forward(index), indices.reverse(index)
    assert indices.verify(fwd, rev).isEmpty()
    hurt = index.filter(F.col("index") != "JK|owner|owner_id")
    n = sum(x[0] == "JK|owner|owner_id" for x in want)
    assert [r.missing for r in indices.verify(fwd, indices.reverse(hurt)).collect()] == ["reverse"] * n
    assert [r.missing for r in indices.verify(indices.forward(hurt), rev).collect()] == ["forward"] * n
    again = indices.add(index, index)
    assert again.count() == len(want)
    assert indices.remove(again, hurt).count() == n
    assert all(set(json.loads(r.value)) == {"index", "fk", "pks"} for r in indices.dump(index).collect())


def test_absent_empty_and_leaf(spark):
    records = {e: {} for e in SCHEMAS}
    for r in ({"id": 1, "owner_id": None, "title": None}, {"id": 2, "owner_id": 5, "title": "t"}):
        records["list"][pk_bytes(r, ["id"])] = r
    records["entry"][b"\1"] = {"id": 1, "list_id": 2, "clip_id": 9, "pos": None}
    docs = {bytes(r.key): json.loads(r.value) for r in to_json(build(as_tables(spark, records), LISTS)).collect()}
    assert docs[b"\1"] == {"Record": {"id": 1}, "Children": {"list_tag": [], "entry": []}}
    entry = {"Record": {"id": 1, "list_id": 2, "clip_id": 9}, "Children": {"clip": []}}
    assert docs[b"\2"] == {"Record": {"id": 2, "owner_id": 5, "title": "t"}, "Children": {"owner": [], "list_tag": [], "entry": [entry]}}


def test_empty_tables(spark):
    records = {e: {} for e in SCHEMAS}
    tables = as_tables(spark, records)
    for root in TREES:
        assert build(tables, root).isEmpty()
        assert indices.parent_index(tables, root).isEmpty()


def test_odd_field_names_and_types(spark):
    """Fields named like the builder's own columns; a boolean key meets an integer one."""
    root = Relation("a", "D", None, None, (Relation("b", None, "doc", "pk"),))
    a = spark.createDataFrame([(1, True), (2, False), (3, None)], "value int, pk boolean")
    b = spark.createDataFrame([(1, 7), (1, 8), (0, 9)], "doc long, value int")
    tables = {
        "a": a.select(encode_columns(a, ["value"]).alias("pk"), F.struct("value", "pk").alias("value")),
        "b": b.select(encode_columns(b, ["value"]).alias("pk"), F.struct("doc", "value").alias("value")),
    }
    got = {r.i: r.n for r in build(tables, root).select(F.col("doc.Record.value").alias("i"), F.size("doc.Children.b").alias("n")).collect()}
    assert got[1] == 2 and got[2] == 1 and got[3] in (None, -1)


def test_missing_key_field(spark):
    tables = as_tables(spark, random_records(1))
    with pytest.raises(ValueError):
        build(tables, Relation("list", "D", None, None, (Relation("owner", None, "nothing", "owner_id"),)))


def test_affected_roots_by_old_and_new_key(spark):
    records = random_records(4)
    tables = as_tables(spark, records)
    index = indices.parent_index(tables, CLIPS)
    pk, old = next((p, r) for p, r in records["entry"].items() if r["clip_id"] not in (None, 999))
    other = next(r["id"] for r in records["clip"].values() if r["id"] != old["clip_id"])
    new = old | {"clip_id": other}
    row = lambda r: tuple(r[f] for f in FIELDS["entry"])
    t = T.StructType.fromDDL(SCHEMAS["entry"])
    image = spark.createDataFrame([(bytearray(pk), row(old), row(new))], T.StructType().add("pk", "binary").add("old", t).add("new", t))
    found = {bytes(r.pk) for r in indices.affected_roots({"entry": image}, tables, CLIPS, index).collect()}
    assert found == {key_bytes(x) for x in (old["clip_id"], other)} & set(records["clip"])


def test_maps_in_records(spark):
    """Documents without an order of their own are sorted by key all the same."""
    root = Relation("a", "D", None, None, (Relation("b", None, "a_id", "id"),))
    a = spark.createDataFrame([(1,)], "id long")
    b = spark.createDataFrame([(2, 1, {"x": "y"}), (256, 1, None), (3, 1, {})], "id long, a_id long, props map<string, string>")
    tables = {n: df.select(encode_columns(df, ["id"]).alias("pk"), F.struct(*df.columns).alias("value")) for n, df in (("a", a), ("b", b))}
    doc = json.loads(to_json(build(tables, root)).first().value)
    assert [x["Record"]["id"] for x in doc["Children"]["b"]] == [256, 2, 3]
    assert doc["Children"]["b"][1]["Record"]["props"] == {"x": "y"}
