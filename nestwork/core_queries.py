"""Queries over the engine's own operators, and the same in SQL.

Documents are flattened to scalar columns, so that the SQL says what they must hold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .data_queries import state_sql
from .functions import keysets
from .functions.keys import encode_columns, encode_key
from .operators import indices
from .operators.changelog import deciding_change, is_delete
from .operators.filters import DELETE, SKIP, UPDATE, Filter, is_equal, mode_counts, with_modes
from .operators.latest import as_changes, before_images, latest
from .plans.builder import build, to_json
from .plans.relations import Relation, validate
from .sources.logs import as_raw_log, by_key, lag, parse_log
from .sources.sinks import black_hole, latest_documents, parquet_sink
from .sources.tables import reader
from .storage import fresh_path, materialize
from .streaming.engine import Engine, Entity
from .streaming.queueing import RANK, NAMES, drain, enqueue, ranked
from .streaming.state import State
from .streaming.streams import start

# -- tables as entities

KEYS = {
    "region": ["r_regionkey"],
    "nation": ["n_nationkey"],
    "customer": ["c_custkey"],
    "supplier": ["s_suppkey"],
    "part": ["p_partkey"],
    "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
}
LOGS = {
    "users": (["user_id"], ["user_name", "email", "usage_type"]),
    "user_tag": (["id"], ["user_id", "tag_name"]),
    "media": (["id"], ["status", "user_id", "title"]),
    "playlist": (["id"], ["active", "user_id", "type", "title"]),
    "playlist_media": (["id"], ["playlist_id", "pos", "media_id"]),
    "playlist_tag": (["playlist_id", "user_tag_id"], ["tag_type"]),
    "playlist_custom_params": (["id"], ["playlist_id", "name", "value"]),
    "player": (["id"], ["user_id", "name"]),
}


def _records(df: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    return df.select(encode_columns(df, keys).alias("pk"), F.struct(*(columns or df.columns)).alias("value"))


def _star(spark: SparkSession, sf_dir: str, **columns: list[str]) -> dict[str, DataFrame]:
    """The named star-schema tables with the named columns, as current records."""
    get = reader(spark, sf_dir)
    return {t: _records(get(t), KEYS[t], c) for t, c in columns.items()}


def _log_records(spark: SparkSession, sf_dir: str, names: list[str]) -> dict[str, DataFrame]:
    get, out = reader(spark, sf_dir), {}
    for t in names:
        keys, values = LOGS[t]
        live = deciding_change(get(t), {k: F.col(k) for k in keys}, {v: F.col(v) for v in values}).filter(~F.col("is_deleted"))
        out[t] = _records(live, keys, keys + values)
    return out


def _child(entity: str, join_key: str, parent_key: str, *children: Relation) -> Relation:
    return Relation(entity, None, join_key, parent_key, children)


def _root(name: str, entity: str, *children: Relation) -> Relation:
    return validate([Relation(entity, name, None, None, children)])[0]


def _kids(entity: str, doc: Column | None = None) -> Column:
    return (F.col("doc") if doc is None else doc)["Children"][entity]


ORDERS_ITEMS = _root("DenormalizedOrder", "orders", _child("lineitem", "l_orderkey", "o_orderkey"))
CUSTOMER_PLACE = _root("DenormalizedCustomer", "customer", _child("nation", "n_nationkey", "c_nationkey", _child("region", "r_regionkey", "n_regionkey")))
CUSTOMER_ORDERS = _root("DenormalizedCustomerOrders", "customer", _child("orders", "o_custkey", "c_custkey"))
ORDERS_CUSTOMER = _root("DenormalizedOrderCustomer", "orders", _child("customer", "c_custkey", "o_custkey"))
PART_ORDERS = _root("DenormalizedPart", "part", _child("lineitem", "l_partkey", "p_partkey", _child("orders", "o_orderkey", "l_orderkey")))
ORDERS_PARTS = _root("DenormalizedOrderParts", "orders", _child("lineitem", "l_orderkey", "o_orderkey", _child("part", "p_partkey", "l_partkey")))
ORDERS_NATIONS = _root(
    "DenormalizedOrderNations", "orders",
    _child("customer", "c_custkey", "o_custkey", _child("nation", "n_nationkey", "c_nationkey")),
    _child("lineitem", "l_orderkey", "o_orderkey", _child("supplier", "s_suppkey", "l_suppkey", _child("nation", "n_nationkey", "s_nationkey"))),
)
PLAYLISTS = _root(
    "DenormalizedPlaylist", "playlist",
    _child("users", "user_id", "user_id"),
    _child("playlist_tag", "playlist_id", "id", _child("user_tag", "id", "user_tag_id")),
    _child("playlist_custom_params", "playlist_id", "id"),
    _child("playlist_media", "playlist_id", "id", _child("media", "id", "media_id")),
)
PLAYERS = _root("DenormalizedPlayer", "player", _child("users", "user_id", "user_id"))
MEDIA = _root("DenormalizedMedia", "media", _child("users", "user_id", "user_id"), _child("playlist_media", "media_id", "id", _child("playlist", "id", "playlist_id")))


def _text(array: Column, item) -> Column:
    return F.array_join(F.transform(array, item), ",")


# -- documents


def nested_orders_lineitem(spark: SparkSession, d: str) -> DataFrame:
    tables = _star(spark, d, orders=["o_orderkey"], lineitem=KEYS["lineitem"])
    items = _kids("lineitem")
    line = lambda x: F.concat_ws(":", *(x["Record"][c].cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey")))
    return build(tables, ORDERS_ITEMS).select("doc.Record.o_orderkey", F.size(items).cast("long").alias("n"), _text(items, line).alias("items"))


def nested_customer_nation_region(spark: SparkSession, d: str) -> DataFrame:
    tables = _star(spark, d, customer=["c_custkey", "c_nationkey"], nation=["n_nationkey", "n_name", "n_regionkey"], region=["r_regionkey", "r_name"])
    nation = F.get(_kids("nation"), 0)
    return build(tables, CUSTOMER_PLACE).select(
        "doc.Record.c_custkey", nation["Record"]["n_name"].alias("n_name"), F.get(_kids("region", nation), 0)["Record"]["r_name"].alias("r_name")
    )


def nested_part_orders(spark: SparkSession, d: str) -> DataFrame:
    tables = _star(spark, d, part=["p_partkey"], lineitem=KEYS["lineitem"], orders=["o_orderkey"])
    lines = _kids("lineitem")
    return build(tables, PART_ORDERS).select(
        "doc.Record.p_partkey",
        F.size(lines).cast("long").alias("n_lines"),
        _text(lines, lambda x: F.get(_kids("orders", x), 0)["Record"]["o_orderkey"].cast("string")).alias("orders"),
    )


def null_parent_key_states(spark: SparkSession, d: str) -> DataFrame:
    get = reader(spark, d)
    customer = get("customer").select("c_custkey", F.nullif("c_nationkey", F.lit(0)).alias("c_nationkey"))
    tables = {"customer": _records(customer, ["c_custkey"]), "nation": _records(get("nation").filter("n_nationkey <> 3"), ["n_nationkey"])}
    tree = _root("D", "customer", _child("nation", "n_nationkey", "c_nationkey"))
    found = _kids("nation")
    state = F.when(found.isNull(), "absent").when(F.size(found) == 0, "empty").otherwise("nonempty")
    return build(tables, tree).groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def empty_children(spark: SparkSession, d: str) -> DataFrame:
    tables = _star(spark, d, orders=["o_orderkey"], lineitem=KEYS["lineitem"])
    return build(tables, ORDERS_ITEMS).filter(F.size(_kids("lineitem")) == 0).select("doc.Record.o_orderkey")


def dangling_children(spark: SparkSession, d: str) -> DataFrame:
    """Large parts are deleted by a filter: their line items stay, with an empty list."""
    get = reader(spark, d)
    tables = _star(spark, d, orders=["o_orderkey"], lineitem=KEYS["lineitem"])
    rule = Filter(lambda entity, new, old: F.when(new["p_size"] > 25, DELETE))
    part = as_changes(get("part").select("p_partkey", "p_size"), ["p_partkey"], F.lit(1))
    tables["part"] = latest(part, "part", rule)
    lines = _kids("lineitem")
    with_part = F.filter(lines, lambda x: F.size(_kids("part", x)) > 0)
    return build(tables, ORDERS_PARTS).select(
        "doc.Record.o_orderkey", F.size(lines).cast("long").alias("n_lines"), F.size(with_part).cast("long").alias("n_with_part")
    )


def root_tombstones(spark: SparkSession, d: str) -> DataFrame:
    """Documents asked for all customers while those in debt were deleted: null for these."""
    get = reader(spark, d)
    tables = _star(spark, d, nation=["n_nationkey", "n_regionkey"], region=["r_regionkey"])
    every = _records(get("customer").select("c_custkey", "c_nationkey", "c_acctbal"), ["c_custkey"])
    tables["customer"] = every.filter("value.c_acctbal >= 0")
    return to_json(build(tables, CUSTOMER_PLACE, every)).select(F.hex("key").alias("pk"), F.col("value").isNull().alias("is_tombstone"))


def multi_root(spark: SparkSession, d: str) -> DataFrame:
    tables = _star(spark, d, orders=["o_orderkey", "o_custkey"], lineitem=KEYS["lineitem"], customer=["c_custkey"])
    parts = [
        build(tables, root).select(F.lit(root.denormalized_name).alias("name"), F.hex("pk").alias("pk"), F.size(_kids(child)).cast("long").alias("n"))
        for root, child in ((ORDERS_ITEMS, "lineitem"), (CUSTOMER_ORDERS, "orders"))
    ]
    return reduce(DataFrame.unionByName, parts)


def repeated_entity(spark: SparkSession, d: str) -> DataFrame:
    tables = _star(
        spark, d, orders=["o_orderkey", "o_custkey"], customer=["c_custkey", "c_nationkey"], lineitem=KEYS["lineitem"],
        supplier=["s_suppkey", "s_nationkey"], nation=["n_nationkey", "n_name"],
    )
    name = lambda parent: F.get(_kids("nation", parent), 0)["Record"]["n_name"]
    return build(tables, ORDERS_NATIONS).select(
        "doc.Record.o_orderkey",
        name(F.get(_kids("customer"), 0)).alias("customer_nation"),
        _text(_kids("lineitem"), lambda x: name(F.get(_kids("supplier", x), 0))).alias("supplier_nations"),
    )


def child_order_bytes(spark: SparkSession, d: str) -> DataFrame:
    tables = _star(spark, d, customer=["c_custkey"], orders=["o_orderkey", "o_custkey"])
    return build(tables, CUSTOMER_ORDERS).select(
        "doc.Record.c_custkey", _text(_kids("orders"), lambda x: x["Record"]["o_orderkey"].cast("string")).alias("orders")
    )


def denormalized_playlists(spark: SparkSession, d: str) -> DataFrame:
    """The playlist documents from the change-logs: deleted media and invalid parameters filtered."""
    tables = _log_records(spark, d, ["playlist", "users", "playlist_tag", "user_tag", "playlist_custom_params", "playlist_media", "media"])
    tables["media"] = tables["media"].filter("coalesce(lower(trim(value.status)), '') <> 'deleted'")
    tables["playlist_custom_params"] = tables["playlist_custom_params"].filter("coalesce(value.value, '') <> 'INVALID'")
    users, tags, media = _kids("users"), _kids("playlist_tag"), _kids("playlist_media")
    n = lambda a: F.when(a.isNotNull(), F.size(a)).otherwise(-1).cast("long")
    first = lambda e, f: lambda x: F.coalesce(F.get(_kids(e, x), 0)["Record"][f].cast("string"), F.lit(""))
    return build(tables, PLAYLISTS).select(
        "doc.Record.id",
        "doc.Record.title",
        n(users).alias("n_users"),
        F.get(users, 0)["Record"]["user_name"].alias("user_name"),
        n(_kids("playlist_custom_params")).alias("n_params"),
        n(tags).alias("n_tags"),
        _text(tags, first("user_tag", "tag_name")).alias("tags"),
        n(media).alias("n_media"),
        _text(media, first("media", "id")).alias("media"),
    )


def denormalized_media(spark: SparkSession, d: str) -> DataFrame:
    tables = _log_records(spark, d, ["media", "users", "playlist_media", "playlist"])
    uses = _kids("playlist_media")
    return build(tables, MEDIA).select(
        "doc.Record.id",
        F.get(_kids("users"), 0)["Record"]["email"].alias("email"),
        F.size(uses).cast("long").alias("n_uses"),
        F.size(F.filter(uses, lambda x: F.size(_kids("playlist", x)) > 0)).cast("long").alias("n_lists"),
    )


def denormalized_players(spark: SparkSession, d: str) -> DataFrame:
    tables = _log_records(spark, d, ["player", "users"])
    return build(tables, PLAYERS).select("doc.Record.id", "doc.Record.name", F.get(_kids("users"), 0)["Record"]["user_name"].alias("user_name"))


def denormalized_json(spark: SparkSession, d: str) -> DataFrame:
    """The player documents as the sinks take them; read back by their own type."""
    tables = _log_records(spark, d, ["player", "users"])
    docs = build(tables, PLAYERS)
    back = F.from_json("value", docs.schema["doc"].dataType)
    read = to_json(docs).select(F.hex("key").alias("key"), back.alias("doc"))
    return read.select("key", "doc.Record.id", F.size("doc.Children.users").cast("long").alias("n_users"))


# -- latest by key, filters


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = reader(spark, d)("events").select("event_id", "ts", "user_id", "event_type")
    return as_changes(e, ["user_id"], F.unix_micros(F.col("ts").cast("timestamp")))


def latest_by_key(spark: SparkSession, d: str) -> DataFrame:
    return latest(_events(spark, d)).select("value.user_id", "value.event_id", "value.event_type")


def latest_with_tombstones(spark: SparkSession, d: str) -> DataFrame:
    rule = Filter(lambda entity, new, old: F.when(new["event_type"] == "error", DELETE))
    return latest(_events(spark, d), "events", rule).select("value.user_id", "value.event_id", "value.event_type")


VIEWS_AND_ERRORS = Filter(lambda entity, new, old: F.when(new["event_type"] == "view", SKIP).when(new["event_type"] == "error", DELETE))


def filter_skip(spark: SparkSession, d: str) -> DataFrame:
    return latest(_events(spark, d), "events", VIEWS_AND_ERRORS).select("value.user_id", "value.event_id", "value.event_type")


def filter_mode_counts(spark: SparkSession, d: str) -> DataFrame:
    return mode_counts(with_modes(_events(spark, d), "events", VIEWS_AND_ERRORS))


def change_detection(spark: SparkSession, d: str) -> DataFrame:
    """Events whose type differs from the user's event before; ids and times are ignored."""
    changes = _events(spark, d)
    dtype = changes.schema["value"].dataType
    rule = Filter(lambda entity, new, old: F.when(is_equal(new, old, dtype, ["event_id", "ts"]), SKIP), uses_old=True, equality=True)
    return with_modes(changes, "events", rule).filter(F.col("mode") == UPDATE).select("value.event_id")


def filter_last_kept(spark: SparkSession, d: str) -> DataFrame:
    """Changes of a media title that come after the last kept one in the alphabet; the others are skipped, deletes start anew."""
    log = reader(spark, d)("media")
    once = log.groupBy("id", "change_seq").agg(F.min(is_delete(F.col("op"))).alias("gone"), F.min(F.coalesce("title", F.lit(""))).alias("title"))
    changes = as_changes(once, ["id"], F.col("change_seq"), F.col("gone"), drop=["gone"])
    rule = Filter(lambda entity, new, old: F.when(new["title"] <= old["title"], SKIP), uses_old=True)
    return with_modes(changes, "media", rule).select("key.id", "seq", "mode")


# -- indices and propagation


def join_index_forward(spark: SparkSession, d: str) -> DataFrame:
    index = indices.join_index(_star(spark, d, customer=["c_custkey"], orders=["o_orderkey", "o_custkey"]), [CUSTOMER_ORDERS])
    return indices.forward(index).select("index", F.hex("fk").alias("fk"), F.array_join(F.transform("keys", F.hex), ",").alias("pks"))


def join_index_reverse(spark: SparkSession, d: str) -> DataFrame:
    index = indices.join_index(_star(spark, d, customer=["c_custkey"], orders=["o_orderkey", "o_custkey"]), [CUSTOMER_ORDERS])
    return indices.reverse(index).select("index", F.hex("pk").alias("pk"), F.array_join(F.transform("keys", F.hex), ",").alias("fks"))


def _order_parents(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], DataFrame]:
    tables = _star(spark, d, orders=["o_orderkey", "o_custkey"], customer=["c_custkey", "c_nationkey"], nation=["n_nationkey"])
    tree = _root("DenormalizedOrderPlace", "orders", _child("customer", "c_custkey", "o_custkey", _child("nation", "n_nationkey", "c_nationkey")))
    return tables, indices.named_parent_index(indices.parent_index(tables, tree), tree)


def parent_index(spark: SparkSession, d: str) -> DataFrame:
    return _order_parents(spark, d)[1].select("index", F.hex("fk").alias("fk"), F.hex("pk").alias("pk"))


def parent_index_scrub(spark: SparkSession, d: str) -> DataFrame:
    tables, index = _order_parents(spark, d)
    gone = tables["orders"].filter("value.o_orderkey % 3 = 0")
    return indices.scrub(index, gone).groupBy("index").agg(F.count(F.lit(1)).alias("n"))


def verify_index(spark: SparkSession, d: str) -> DataFrame:
    """Entries missing on either side: none in a whole index, those removed in a damaged one."""
    index = indices.join_index(_star(spark, d, customer=["c_custkey"], orders=["o_orderkey", "o_custkey"]), [CUSTOMER_ORDERS])
    fwd, rev = indices.forward(index), indices.reverse(index)
    hurt = rev.filter(F.conv(F.hex("pk"), 16, 10).cast("long") % 7 != 0)
    one = lambda name, r: indices.verify(fwd, r).agg(F.count(F.lit(1)).alias("n_missing")).select(F.lit(name).alias("index_state"), "n_missing")
    return one("whole", rev).unionByName(one("damaged", hurt))


def affected_roots(spark: SparkSession, d: str) -> DataFrame:
    """Customers of nation 1 move to nation 2: the orders to rebuild, found by old and new keys."""
    tables = _star(spark, d, orders=["o_orderkey", "o_custkey"], customer=["c_custkey", "c_nationkey"])
    moved = tables["customer"].filter("value.c_nationkey = 1")
    new = moved.select("pk", F.struct("value.c_custkey", F.lit(2).cast("int").alias("c_nationkey")).alias("value"))
    images = {"customer": before_images(new, tables["customer"])}
    index = indices.parent_index(tables, ORDERS_CUSTOMER)
    found = indices.affected_roots(images, tables, ORDERS_CUSTOMER, index)
    return found.select(F.conv(F.hex("pk"), 16, 10).cast("long").alias("o_orderkey"))


def incremental_equals_full(spark: SparkSession, d: str) -> DataFrame:
    """A load and a batch of updates and deletes through the engine, against a build of what they leave: the documents that differ."""
    get = reader(spark, d)
    customer = get("customer").select("c_custkey", "c_name", "c_nationkey")
    nation, region = get("nation"), get("region")
    types = {t: Entity(KEYS[t], df.schema) for t, df in (("customer", customer), ("nation", nation), ("region", region))}
    path = fresh_path(spark, "engine")
    engine = Engine(spark, [CUSTOMER_PLACE], types, State(spark, path), black_hole)
    load = {t: as_changes(df, KEYS[t], F.lit(1)) for t, df in (("customer", customer), ("nation", nation), ("region", region))}
    moved = customer.filter("c_custkey % 5 = 0").withColumn("c_nationkey", F.pmod(F.col("c_nationkey") + 1, F.lit(25)).cast("int"))
    later = {
        "customer": as_changes(moved, KEYS["customer"], F.lit(2), F.col("c_custkey") % 10 == 0),
        "nation": as_changes(nation.filter("n_nationkey = 3"), KEYS["nation"], F.lit(2), F.lit(True)),
    }
    engine.process_batch(load, 0)
    first, second = fresh_path(spark, "docs"), fresh_path(spark, "docs")
    engine.documents(CUSTOMER_PLACE).write.parquet(first)
    engine.sink = lambda name, rows, batch_id: rows.write.parquet(second)
    engine.process_batch(later, 1)
    emitted = spark.read.parquet(second)
    stands = spark.read.parquet(first).join(emitted.select("key"), "key", "left_anti")
    stands = stands.unionByName(emitted.filter(F.col("value").isNotNull()))
    full = engine.documents(CUSTOMER_PLACE)
    wrong = stands.exceptAll(full).unionByName(full.exceptAll(stands))
    return wrong.agg(F.count(F.lit(1)).alias("n_different")).withColumn("n_emitted", F.lit(emitted.count()).cast("long"))


# -- keys and key sets


def key_encoding_int(spark: SparkSession, d: str) -> DataFrame:
    c = reader(spark, d)("customer").select("c_custkey", "c_nationkey")
    return c.select("c_custkey", F.hex(encode_columns(c, ["c_custkey"])).alias("h"), F.hex(encode_columns(c, ["c_nationkey"])).alias("hn"))


def key_encoding_string(spark: SparkSession, d: str) -> DataFrame:
    s = reader(spark, d)("supplier").select("s_suppkey", "s_name")
    return s.select("s_suppkey", F.hex(encode_columns(s, ["s_name"])).alias("h"))


def key_encoding_boolean(spark: SparkSession, d: str) -> DataFrame:
    n = reader(spark, d)("nation").select("n_nationkey", (F.col("n_regionkey") == 1).alias("b"))
    return n.select("n_nationkey", F.hex(encode_key(F.col("b"), n.schema["b"].dataType)).alias("h"))


def key_encoding_composite(spark: SparkSession, d: str) -> DataFrame:
    x = reader(spark, d)("lineitem").select("l_orderkey", "l_linenumber").distinct()
    return x.select("l_orderkey", "l_linenumber", F.hex(encode_columns(x, ["l_orderkey", "l_linenumber"])).alias("h"))


def keyset_operations(spark: SparkSession, d: str) -> DataFrame:
    """Per order the sets of parts on odd and on even lines, and what the set operations make of them."""
    x = reader(spark, d)("lineitem").select("l_orderkey", "l_linenumber", encode_columns(reader(spark, d)("lineitem"), ["l_partkey"]).alias("k"))
    pick = lambda r: F.when(F.col("l_linenumber") % 2 == r, F.col("k"))
    s = x.groupBy("l_orderkey").agg(keysets.collect(pick(1)).alias("a"), keysets.collect(pick(0)).alias("b"))
    n = lambda c: keysets.size(c).cast("long")
    a, b = F.col("a"), F.col("b")
    return s.select(
        "l_orderkey", n(a).alias("n_a"), n(b).alias("n_b"), n(keysets.union(a, b)).alias("n_union"), n(keysets.minus(a, b)).alias("n_minus"),
        n(keysets.intersect(a, b)).alias("n_both"), F.array_join(F.transform(keysets.union(a, b), F.hex), ",").alias("keys"),
    )


def _whole_key_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two whole columns that differ both ways: owners of playlists, and users."""
    get = reader(spark, d)
    return get("playlist").select(F.col("user_id").alias("k")), get("users").select(F.col("user_id").alias("k"))


def keyset_whole_union(spark: SparkSession, d: str) -> DataFrame:
    return keysets.rows_union(*_whole_key_rows(spark, d))


def keyset_whole_minus(spark: SparkSession, d: str) -> DataFrame:
    return keysets.rows_minus(*_whole_key_rows(spark, d))


def keyset_whole_minus_back(spark: SparkSession, d: str) -> DataFrame:
    return keysets.rows_minus(*reversed(_whole_key_rows(spark, d)))


# -- queues, metrics, streams


def _affected(spark: SparkSession, d: str) -> DataFrame:
    """Orders as roots, touched by one or two entities."""
    o = reader(spark, d)("orders").select("o_orderkey", "o_orderstatus")
    entity = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("media"), F.lit("tag"))).when(F.col("o_orderstatus") == "O", F.array(F.lit("tag")))
    return o.select(encode_columns(o, ["o_orderkey"]).alias("pk"), F.explode(F.coalesce(entity, F.array(F.lit("params")))).alias("entity"))


STRATEGY = {"media": "HIGH", "tag": "NONE", "params": "LOW"}


def queue_priorities(spark: SparkSession, d: str) -> DataFrame:
    new = ranked(_affected(spark, d), "D", lambda name, entity: STRATEGY[entity], list(STRATEGY))
    names = F.create_map(*(F.lit(x) for p in NAMES.items() for x in p))
    return new.groupBy(names[F.col("rank")].alias("priority")).agg(F.count(F.lit(1)).alias("n"))


def queue_slices(spark: SparkSession, d: str) -> DataFrame:
    """Orders queued as HIGH, MEDIUM and LOW by their status, in turns of 1,000 documents: who is created in which turn."""
    o = reader(spark, d)("orders").select("o_orderkey", "o_orderstatus")
    entity = F.when(F.col("o_orderstatus") == "F", "a").when(F.col("o_orderstatus") == "O", "b").otherwise("c")
    new = ranked(o.select(encode_columns(o, ["o_orderkey"]).alias("pk"), entity.alias("entity")), "D", lambda name, e: {"a": "HIGH", "b": "MEDIUM", "c": "LOW"}[e], list("abc"))
    queue, out = materialize(enqueue(spark.createDataFrame([], "pk binary, rank int, since bigint"), new, 1), "queue"), []
    for turn in range(3):
        now = materialize(drain(queue, None, 1000), "turn")
        out.append(now.select(F.hex("pk").alias("pk"), F.lit(turn).cast("long").alias("turn")))
        queue = materialize(queue.join(now.select("pk"), "pk", "left_anti"), "queue")
    return reduce(DataFrame.unionByName, out)


def queue_drain(spark: SparkSession, d: str) -> DataFrame:
    """What a budget of 100 low-priority documents drains: a queue's feature, not a limit of ours."""
    new = ranked(_affected(spark, d), "D", lambda name, entity: STRATEGY[entity], list(STRATEGY))
    empty = spark.createDataFrame([], "pk binary, rank int, since bigint")
    now = drain(enqueue(empty, new, 7), 100)
    return now.select(F.hex("pk").alias("pk"), (F.col("rank") == RANK["LOW"]).alias("is_low"), "since")


def stream_player_documents(spark: SparkSession, d: str) -> DataFrame:
    """The logs of players and users as files, through Structured Streaming and the engine in several batches."""
    get = reader(spark, d)
    raw, types = {}, {}
    for t in ("player", "users"):
        keys, values = LOGS[t]
        df = get(t)
        types[t] = Entity(keys, df.select(*keys, *values).schema)
        text = as_raw_log(df, keys, values, F.col("change_seq"), is_delete(F.col("op")))
        path = fresh_path(spark, f"raw-{t}")
        text.repartitionByRange(3, "pos").write.json(path)
        raw[t] = spark.readStream.schema("key string, value string, part int, pos bigint").option("maxFilesPerTrigger", 2).json(path)
    engine = Engine(spark, [PLAYERS], types, State(spark, fresh_path(spark, "stream-state")), black_hole)
    start(engine, raw, fresh_path(spark, "stream-checkpoint"), available_now=True).awaitTermination()
    docs = engine.documents(PLAYERS)
    doc = "Record struct<id: bigint, name: string>, Children struct<users: array<struct<Record: struct<user_name: string>>>>"
    read = docs.select(F.from_json("value", doc).alias("doc"))
    return read.select("doc.Record.id", "doc.Record.name", F.get("doc.Children.users", 0)["Record"]["user_name"].alias("user_name"))


def _media_raw(spark: SparkSession, d: str) -> DataFrame:
    """The log of media as raw rows of keys and values, in hash partitions."""
    keys, values = LOGS["media"]
    return as_raw_log(reader(spark, d)("media"), keys, values, F.col("change_seq"), is_delete(F.col("op")))


def memory_log_latest(spark: SparkSession, d: str) -> DataFrame:
    """The log of media as raw JSON, parsed again: who is left."""
    keys, values = LOGS["media"]
    changes = parse_log(_media_raw(spark, d), keys, reader(spark, d)("media").select(*keys, *values).schema)
    return latest(changes).select("value.id", "value.status", "value.user_id", "value.title")


def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The current media that player owners own, asked for by their keys."""
    keys, values = LOGS["media"]
    changes = parse_log(_media_raw(spark, d), keys, reader(spark, d)("media").select(*keys, *values).schema)
    asked = reader(spark, d)("playlist_media").select("media_id").filter("media_id is not null")
    found = by_key(latest(changes), asked.select(encode_columns(asked, ["media_id"]).alias("pk")))
    return found.select("value.id", "value.title")


def log_lag(spark: SparkSession, d: str) -> DataFrame:
    """Per partition of the media log the rows unread by a reader that stands behind change 1000 in the even ones."""
    raw = reader(spark, d)("media").select(F.col("part_no").alias("part"), F.col("change_seq").alias("pos"))
    parts = [r["part"] for r in raw.select("part").distinct().collect()]  # partitions of a log
    return lag(raw, {p: 1000 for p in parts if p % 2 == 0}).select(F.col("part").cast("long").alias("part"), "n")


def _customer_index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The customers by nation, and what a batch changes: every fifth moves on, every tenth is deleted, nation 0 becomes null."""
    table = _star(spark, d, customer=["c_custkey", "c_nationkey"])["customer"]
    key, nation = F.col("value.c_custkey"), F.col("value.c_nationkey")
    moved = F.when(key % 5 == 0, F.pmod(nation + 1, F.lit(25)).cast("int")).otherwise(F.nullif(nation, F.lit(0)))
    new = F.when(key % 10 != 0, F.struct(key.alias("c_custkey"), moved.alias("c_nationkey")))
    index = table.select(indices.index_key(table, "c_nationkey").alias("fk"), "pk")
    return index, indices.join_changes(table.select("pk", F.col("value").alias("old"), new.alias("new")), table, "c_nationkey")


def join_index_update(spark: SparkSession, d: str) -> DataFrame:
    return indices.updated(*_customer_index(spark, d)).select(F.hex("fk").alias("fk"), F.hex("pk").alias("pk"))


def join_index_changes(spark: SparkSession, d: str) -> DataFrame:
    return _customer_index(spark, d)[1].select(F.hex("fk").alias("fk"), F.hex("pk").alias("pk"), "live")


def index_add_remove(spark: SparkSession, d: str) -> DataFrame:
    """Orders by customer: those of large customers removed from the index, all added back twice; rows after each step."""
    tables = _star(spark, d, customer=["c_custkey"], orders=["o_orderkey", "o_custkey"])
    index = indices.join_index(tables, [CUSTOMER_ORDERS])
    some = index.filter(F.conv(F.hex("fk"), 16, 10).cast("long") % 4 == 1)
    less = indices.remove(index, some)
    n = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("step"), "n")
    steps = {"removed": indices.removed(index, some.unionByName(some)), "left": less, "added": indices.add(indices.add(less, some), index)}
    return reduce(DataFrame.unionByName, (n(k, v) for k, v in steps.items()))


def index_dump(spark: SparkSession, d: str) -> DataFrame:
    return indices.dump(indices.join_index(_star(spark, d, customer=["c_custkey"], orders=["o_orderkey", "o_custkey"]), [CUSTOMER_ORDERS]))


def keyset_contains(spark: SparkSession, d: str) -> DataFrame:
    """Per order: whether its parts on odd lines are all on even ones too, and whether part 1 is among either."""
    x = reader(spark, d)("lineitem")
    x = x.select("l_orderkey", "l_linenumber", encode_columns(x, ["l_partkey"]).alias("k"))
    pick = lambda r: F.when(F.col("l_linenumber") % 2 == r, F.col("k"))
    s = x.groupBy("l_orderkey").agg(keysets.collect(pick(1)).alias("a"), keysets.collect(pick(0)).alias("b"))
    a, b, one = F.col("a"), F.col("b"), F.lit(bytearray(b"\1"))
    return s.select("l_orderkey", keysets.contains_all(b, a).alias("all_in"), keysets.contains(keysets.union(a, b), one).alias("has_one"), keysets.is_empty(b).alias("none_even"))


def replay_rounds(spark: SparkSession, d: str) -> DataFrame:
    """The logs of playlists and users delivered in three rounds of arrival, changes of users alone being dropped (NONE):
    every document is as of the round in which its playlist last changed."""
    get = reader(spark, d)
    types = {t: Entity(LOGS[t][0], get(t).select(*LOGS[t][0], *LOGS[t][1]).schema) for t in ("playlist", "users")}
    tree = _root("DenormalizedPlaylistOwner", "playlist", _child("users", "user_id", "user_id"))
    out = fresh_path(spark, "replay")
    engine = Engine(spark, [tree], types, State(spark, fresh_path(spark, "replay-state")), parquet_sink(out), lambda name, e: "NONE" if e == "users" else "MEDIUM")
    for n in range(3):
        batch = {}
        for t in types:
            log = get(t).filter(F.expr(REPLAY_ROUND) == n)
            keys, values = LOGS[t]
            batch[t] = as_changes(log.select(*keys, *values, "change_seq", "op"), keys, F.col("change_seq"), is_delete(F.col("op")), drop=["change_seq", "op"])
        engine.process_batch(batch, n)
    doc = "Record struct<id: bigint, title: string>, Children struct<users: array<struct<Record: struct<user_name: string>>>>"
    docs = latest_documents(spark.read.parquet(f"{out}/DenormalizedPlaylistOwner")).select(F.from_json("value", doc).alias("doc"))
    return docs.select("doc.Record.id", "doc.Record.title", F.get("doc.Children.users", 0)["Record"]["user_name"].alias("user_name"))


REPLAY_ROUND = "pmod(day(arrived_at), 3)"  # not in the order of the changes: late ones and copies come in later rounds


QUERIES = {
    f.__name__: f
    for f in (
        nested_orders_lineitem, nested_customer_nation_region, nested_part_orders, null_parent_key_states, empty_children,
        dangling_children, root_tombstones, multi_root, repeated_entity, child_order_bytes, denormalized_playlists,
        denormalized_media, denormalized_players, denormalized_json, latest_by_key, latest_with_tombstones, filter_skip,
        filter_mode_counts, change_detection, filter_last_kept, join_index_forward, join_index_reverse, parent_index, parent_index_scrub,
        verify_index, affected_roots, incremental_equals_full, key_encoding_int, key_encoding_string, key_encoding_boolean,
        key_encoding_composite, keyset_operations, keyset_whole_union, keyset_whole_minus, keyset_whole_minus_back, queue_priorities, queue_drain, queue_slices,
        stream_player_documents, memory_log_latest, point_lookup, log_lag, join_index_update, join_index_changes,
        index_add_remove, index_dump, keyset_contains, replay_rounds,
    )
}


def _hex(column: str) -> str:
    h = f"printf('%X', {column})"
    return f"case when length({h}) % 2 = 1 then '0' || {h} else {h} end"


def _live(table: str) -> str:
    keys, values = LOGS[table]
    return "(" + state_sql(table, ", ".join(keys), ", ".join(values)) + ")"


_EVENTS = "select *, row_number() over (partition by user_id order by ts desc) as k from events"

SQL = {
    "nested_orders_lineitem": """with a as (select l_orderkey, count(*) as n,
        string_agg(l_linenumber || ':' || l_partkey || ':' || l_suppkey, ',' order by l_linenumber, l_partkey, l_suppkey) as items from lineitem group by 1)
      select o_orderkey, coalesce(n, 0) as n, coalesce(items, '') as items from orders left join a on o_orderkey = l_orderkey""",
    "nested_customer_nation_region": """select c_custkey, n_name, r_name from customer
      left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey""",
    "nested_part_orders": """with a as (select l_partkey, count(*) as n,
        string_agg(o_orderkey::varchar, ',' order by l_linenumber, l_orderkey, l_suppkey) as s from lineitem left join orders on l_orderkey = o_orderkey group by 1)
      select p_partkey, coalesce(n, 0) as n_lines, coalesce(s, '') as orders from part left join a on p_partkey = l_partkey""",
    "null_parent_key_states": """select case when nullif(c_nationkey, 0) is null then 'absent' when n_nationkey is null then 'empty' else 'nonempty' end as state, count(*) as n
      from customer left join (select * from nation where n_nationkey <> 3) on nullif(c_nationkey, 0) = n_nationkey group by 1""",
    "empty_children": "select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem)",
    "dangling_children": """select o_orderkey, count(l_orderkey) as n_lines, count(p_partkey) as n_with_part from orders
      left join lineitem on l_orderkey = o_orderkey left join (select * from part where p_size <= 25) on p_partkey = l_partkey group by 1""",
    "root_tombstones": f"select {_hex('c_custkey')} as pk, not coalesce(c_acctbal >= 0, false) as is_tombstone from customer",
    "multi_root": f"""select 'DenormalizedOrder' as name, {_hex('o_orderkey')} as pk, count(l_orderkey) as n from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey
      union all select 'DenormalizedCustomerOrders', {_hex('c_custkey')}, count(o_orderkey) from customer left join orders on o_custkey = c_custkey group by c_custkey""",
    "repeated_entity": """with l as (select l_orderkey, string_agg(n_name, ',' order by l_linenumber, l_partkey, l_suppkey) as s from lineitem
        join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by 1)
      select o_orderkey, n_name as customer_nation, coalesce(s, '') as supplier_nations from orders
      left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey left join l on l_orderkey = o_orderkey""",
    "child_order_bytes": f"""select c_custkey, coalesce(s, '') as orders from customer left join
      (select o_custkey, string_agg(o_orderkey::varchar, ',' order by h) as s from (select o_custkey, o_orderkey, {_hex('o_orderkey')} as h from orders) group by 1) on o_custkey = c_custkey""",
    "denormalized_playlists": f"""with pl as {_live('playlist')}, us as {_live('users')}, pt as {_live('playlist_tag')}, ut as {_live('user_tag')},
        pc as (select * from {_live('playlist_custom_params')} where coalesce(value, '') <> 'INVALID'), pm as {_live('playlist_media')},
        me as (select * from {_live('media')} where coalesce(lower(trim(status)), '') <> 'deleted'),
        t as (select pt.playlist_id as p, count(*) as n, string_agg(coalesce(tag_name, ''), ',' order by pt.user_tag_id < 0, pt.user_tag_id) as s from pt left join ut on ut.id = pt.user_tag_id group by 1),
        m as (select pm.playlist_id as p, count(*) as n, string_agg(coalesce(me.id::varchar, ''), ',' order by {_hex('pm.id')}) as s from pm left join me on me.id = pm.media_id group by 1),
        c as (select playlist_id as p, count(*) as n from pc group by 1)
      select pl.id, pl.title, case when pl.user_id is null then -1 when us.user_id is null then 0 else 1 end::bigint as n_users, us.user_name,
        coalesce(c.n, 0) as n_params, coalesce(t.n, 0) as n_tags, coalesce(t.s, '') as tags, coalesce(m.n, 0) as n_media, coalesce(m.s, '') as media
      from pl left join us on us.user_id = pl.user_id left join t on t.p = pl.id left join m on m.p = pl.id left join c on c.p = pl.id""",
    "denormalized_media": f"""with me as {_live('media')}, us as {_live('users')}, pm as {_live('playlist_media')}, pl as {_live('playlist')},
        u as (select media_id as m, count(*) as n, count(pl.id) as k from pm left join pl on pl.id = pm.playlist_id group by 1)
      select me.id, us.email, coalesce(u.n, 0) as n_uses, coalesce(u.k, 0) as n_lists from me left join us on us.user_id = me.user_id left join u on u.m = me.id""",
    "denormalized_players": f"select p.id, p.name, u.user_name from {_live('player')} p left join {_live('users')} u on u.user_id = p.user_id",
    "denormalized_json": f"""select {_hex('p.id')} as key, p.id, case when p.user_id is null then null when u.user_id is null then 0 else 1 end::bigint as n_users
      from {_live('player')} p left join {_live('users')} u on u.user_id = p.user_id""",
    "latest_by_key": f"select user_id, event_id, event_type from ({_EVENTS}) where k = 1",
    "latest_with_tombstones": f"select user_id, event_id, event_type from ({_EVENTS}) where k = 1 and event_type <> 'error'",
    "filter_skip": f"select user_id, event_id, event_type from ({_EVENTS} where event_type <> 'view') where k = 1 and event_type <> 'error'",
    "filter_mode_counts": "select case event_type when 'view' then 'SKIP' when 'error' then 'DELETE' else 'UPDATE' end as mode, count(*) as n from events group by 1",
    "change_detection": """select event_id from (select *, lag(event_type) over (partition by user_id order by ts) as p,
        row_number() over (partition by user_id order by ts) as r from events) where r = 1 or p is distinct from event_type""",
    "filter_last_kept": """with recursive c as (select id, change_seq, bool_and(op is null or lower(trim(op)) like 'd%') as gone, min(coalesce(title, '')) as title,
        row_number() over (partition by id order by change_seq) as n from media group by id, change_seq),
      f as (select id, change_seq, n, case when gone then 'DELETE' else 'UPDATE' end as mode, case when not gone then title end as kept from c where n = 1
        union all select c.id, c.change_seq, c.n, case when c.gone then 'DELETE' when c.title <= f.kept then 'SKIP' else 'UPDATE' end,
          case when c.gone then null when c.title <= f.kept then f.kept else c.title end from f join c on c.id is not distinct from f.id and c.n = f.n + 1)
      select id, change_seq as seq, mode from f""",
    "join_index_forward": f"""select 'JK|orders|o_custkey' as index, {_hex('o_custkey')} as fk, string_agg(h, ',' order by h) as pks
      from (select o_custkey, {_hex('o_orderkey')} as h from orders) group by o_custkey""",
    "join_index_reverse": f"select 'JK|orders|o_custkey' as index, {_hex('o_orderkey')} as pk, {_hex('o_custkey')} as fks from orders",
    "parent_index": f"""select 'PaK|orders|orders|o_custkey' as index, {_hex('o_custkey')} as fk, {_hex('o_orderkey')} as pk from orders
      union all select distinct 'PaK|orders|customer|c_nationkey', {_hex('c_nationkey')}, {_hex('o_orderkey')} from orders join customer on o_custkey = c_custkey""",
    "parent_index_scrub": """select index, count(*) as n from (select 'PaK|orders|orders|o_custkey' as index, o_orderkey from orders where o_orderkey % 3 <> 0
      union all select 'PaK|orders|customer|c_nationkey', o_orderkey from orders join customer on o_custkey = c_custkey where o_orderkey % 3 <> 0) group by 1""",
    "verify_index": "select 'whole' as index_state, 0::bigint as n_missing union all select 'damaged', count(*) from orders where o_orderkey % 7 = 0",
    "affected_roots": "select distinct o_orderkey from orders where o_custkey in (select c_custkey from customer where c_nationkey = 1)",
    "incremental_equals_full": """select 0::bigint as n_different, count(*) as n_emitted from customer where c_custkey % 5 = 0 or c_nationkey = 3""",
    "key_encoding_int": f"select c_custkey, {_hex('c_custkey')} as h, {_hex('c_nationkey')} as hn from customer",
    "key_encoding_string": "select s_suppkey, hex(s_name) as h from supplier",
    "key_encoding_boolean": "select n_nationkey, case when n_regionkey = 1 then '01' else '00' end as h from nation",
    "key_encoding_composite": f"""select distinct l_orderkey, l_linenumber, printf('%02X', length({_hex('l_linenumber')}) // 2) || {_hex('l_linenumber')}
      || printf('%02X', length({_hex('l_orderkey')}) // 2) || {_hex('l_orderkey')} as h from lineitem""",
    "keyset_operations": f"""with x as (select distinct l_orderkey, l_linenumber % 2 as r, {_hex('l_partkey')} as h from lineitem),
        g as (select l_orderkey, h, bool_or(r = 1) as a, bool_or(r = 0) as b from x group by 1, 2)
      select l_orderkey, count(*) filter (a) as n_a, count(*) filter (b) as n_b, count(*) as n_union, count(*) filter (a and not b) as n_minus,
        count(*) filter (a and b) as n_both, string_agg(h, ',' order by h) as keys from g group by 1""",
    "keyset_whole_union": "select user_id as k from playlist union select user_id from users",
    "keyset_whole_minus": "select user_id as k from playlist except select user_id from users",
    "keyset_whole_minus_back": "select user_id as k from users except select user_id from playlist",
    "queue_priorities": "select case o_orderstatus when 'F' then 'HIGH' when 'O' then 'NONE' else 'LOW' end as priority, count(*) as n from orders group by 1",
    "queue_drain": f"""select {_hex('o_orderkey')} as pk, false as is_low, 7::bigint as since from orders where o_orderstatus = 'F'
      union all select * from (select {_hex('o_orderkey')} as pk, true, 7::bigint from orders where coalesce(o_orderstatus, '') not in ('F', 'O') order by 1 limit 100)""",
    "queue_slices": f"""select pk, (n - 1) // 1000 as turn from (select {_hex('o_orderkey')} as pk, row_number() over (order by
        case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end, {_hex('o_orderkey')}) as n from orders) where n <= 3000""",
    "stream_player_documents": f"select p.id, p.name, u.user_name from {_live('player')} p left join {_live('users')} u on u.user_id = p.user_id",
    "memory_log_latest": f"select id, status, user_id, title from {_live('media')}",
    "point_lookup": f"select id, title from {_live('media')} where id in (select media_id from playlist_media)",
    "log_lag": "select part_no::bigint as part, count(*) filter (part_no % 2 <> 0 or change_seq >= 1000) as n from media group by 1",
    "join_index_update": f"""select {_hex('n')} as fk, {_hex('c_custkey')} as pk from (select c_custkey,
        case when c_custkey % 5 = 0 then (c_nationkey + 1) % 25 else nullif(c_nationkey, 0) end as n from customer where c_custkey % 10 <> 0) where n is not null""",
    "join_index_changes": f"""with c as (select c_custkey as k, c_nationkey as o, case when c_custkey % 10 = 0 then null
        when c_custkey % 5 = 0 then (c_nationkey + 1) % 25 else nullif(c_nationkey, 0) end as n from customer)
      select {_hex('o')} as fk, {_hex('k')} as pk, false as live from c where o is not null and o is distinct from n
      union all select {_hex('n')}, {_hex('k')}, true from c where n is not null and o is distinct from n""",
    "index_add_remove": """select 'removed' as step, count(*) as n from orders where o_custkey % 4 = 1
      union all select 'left', count(*) from orders where o_custkey % 4 <> 1 union all select 'added', count(*) from orders""",
    "index_dump": f"""select '{{"index":"JK|orders|o_custkey","fk":"' || {_hex('o_custkey')} || '","pks":["' || string_agg(h, '","' order by h) || '"]}}' as value
      from (select o_custkey, {_hex('o_orderkey')} as h from orders) group by o_custkey""",
    "keyset_contains": """with g as (select l_orderkey, l_partkey, bool_or(l_linenumber % 2 = 1) as a, bool_or(l_linenumber % 2 = 0) as b from lineitem group by 1, 2)
      select l_orderkey, bool_and(b or not a) as all_in, bool_or(l_partkey = 1) as has_one, not bool_or(b) as none_even from g group by 1""",
    "replay_rounds": """with p as (select *, day(arrived_at at time zone 'UTC') % 3 as r from playlist), u as (select *, day(arrived_at at time zone 'UTC') % 3 as r from users),
        pl as (select id, title, user_id, r, (op is null or lower(trim(op)) like 'd%') as gone, row_number() over (partition by id order by change_seq desc, r) as k from p),
        us as (select t.r, user_id, user_name, (op is null or lower(trim(op)) like 'd%') as gone,
          row_number() over (partition by t.r, user_id order by change_seq desc) as k from (select unnest([0, 1, 2]) as r) t join u on u.r <= t.r)
      select pl.id, title, user_name from pl left join us on us.user_id = pl.user_id and us.r = pl.r and us.k = 1 and not us.gone
      where pl.k = 1 and not pl.gone""",
}
