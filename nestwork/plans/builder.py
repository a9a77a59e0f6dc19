"""From a relation tree and the latest records to nested documents.

Children are aggregated by join key below their parent and joined one to one, so that sibling lists
don't multiply. A document is ``Record`` (all fields) and ``Children`` (one array per child entity, in
the order of the children's key bytes):

* a null parent key: no array (null; absent in JSON);
* a parent key without a matching child: an empty array;
* a child that was deleted or filtered is in no array, its parent stays.

In JSON null fields are left out, and leaves have ``"Children":{}``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import INTEGRAL, encode_key
from .relations import Relation

Tables = Mapping[str, DataFrame]  # entity -> (pk, value)


def field_type(table: DataFrame, name: str) -> T.DataType:
    value = table.schema["value"].dataType
    if name not in value.names:
        raise ValueError(f"no field {name!r} in {value.names}")
    return value[name].dataType


def key_of(table: DataFrame, name: str, other: T.DataType | None = None, value: Column | None = None) -> Column:
    """Field ``name`` of the value as a join key: a long if both sides are integers, else canonical bytes."""
    dtype = field_type(table, name)
    col = (F.col("value") if value is None else value)[name]
    if isinstance(dtype, INTEGRAL) and (other is None or isinstance(other, INTEGRAL)):
        return col.cast("long")
    return encode_key(col, dtype)


def index_key(table: DataFrame, name: str, value: Column | None = None) -> Column:
    """Field ``name`` of the value as canonical bytes; empty keys are null."""
    data = encode_key((F.col("value") if value is None else value)[name], field_type(table, name))
    return F.when(F.length(data) > 0, data)


Pruned = dict[tuple[str, ...], DataFrame]


def prune(
    tables: Tables,
    root: Relation,
    roots: DataFrame,
    cut: Callable[[DataFrame], DataFrame] = lambda df: df,
    fetch: Callable[[Relation, DataFrame], DataFrame | None] | None = None,
) -> Pruned:
    """Per place in the tree the records that documents of ``roots`` (``pk``) can hold, from the top down.

    ``cut`` may write each place's records to a table: the next level's keys then have a known size, and
    where they are few the child's table is filtered by a broadcast, without a shuffle. ``fetch`` may find a
    child's records by distinct key bytes (``fk``) in an index; it gives None where it would rather not.
    """
    out: Pruned = {}

    def below(node: Relation, path: tuple[str, ...], mine: DataFrame) -> None:
        out[path] = mine = cut(mine)
        for child in node.children:
            table = tables[child.entity]
            kept = None
            if fetch:
                fk = mine.select(index_key(mine, child.parent_key).alias("fk"))
                kept = fetch(child, fk.filter("fk is not null").distinct())
            if kept is None:
                parent_type, child_type = field_type(mine, child.parent_key), field_type(table, child.join_key)
                keys = mine.select(key_of(mine, child.parent_key, child_type).alias("_k")).filter("_k is not null").distinct()
                kept = table.withColumn("_k", key_of(table, child.join_key, parent_type)).join(keys, "_k", "left_semi").drop("_k")
            below(child, (*path, child.entity), kept)

    below(root, (root.entity,), tables[root.entity].join(roots.select("pk").distinct(), "pk", "left_semi"))
    return out


def build(tables: Tables, root: Relation, roots: DataFrame | None = None, pruned: Pruned | None = None) -> DataFrame:
    """Documents ``pk, doc`` of all root records or, with ``roots`` (``pk``), of those; null doc where
    a root has no record (its tombstone). ``pruned`` is :func:`prune`'s result, if it was made before."""
    if roots is not None and pruned is None:
        pruned = prune(tables, root, roots)

    def node(rel: Relation, path: tuple[str, ...]) -> DataFrame:
        table = pruned[path] if pruned is not None else tables[rel.entity]
        table = table.select("pk", "value")
        arrays: list[Column] = []
        for child in rel.children:
            docs = node(child, (*path, child.entity))
            parent_type, child_type = field_type(table, child.parent_key), field_type(docs, child.join_key)
            key, name = f"_k_{child.entity}", f"_c_{child.entity}"
            lists = (
                docs.select(key_of(docs, child.join_key, parent_type).alias(key), F.struct("pk", "doc").alias("d"))
                .filter(F.col(key).isNotNull())
                .repartition(key)  # lists don't shrink by partial aggregation, which would sort every row before the shuffle
                .groupBy(key)
                .agg(F.transform(_sorted(F.collect_list("d"), docs.schema["doc"].dataType), lambda d: d["doc"]).alias(name))
            )
            table = table.withColumn(key, key_of(table, child.parent_key, child_type)).join(lists, key, "left")
            empty = F.array().cast(lists.schema[name].dataType)
            arrays.append(F.when(F.col(key).isNotNull(), F.coalesce(F.col(name), empty)).alias(child.entity))
        children = F.struct(*arrays) if arrays else F.struct(F.lit(None).cast("int").alias("_"))
        return table.select("pk", "value", F.struct(F.col("value").alias("Record"), children.alias("Children")).alias("doc"))

    docs = node(root, (root.entity,)).select("pk", "doc")
    if roots is not None:
        docs = roots.select("pk").distinct().join(docs, "pk", "left")
    return docs


def _sorted(children: Column, doc: T.DataType) -> Column:
    """Structs of ``pk`` and ``doc`` by ``pk``. Where documents have an order Spark's own one does, which is compiled; a comparing
    function is interpreted, but is needed where a document holds maps."""
    if _orderable(doc):
        return F.array_sort(children)
    return F.array_sort(children, lambda a, b: F.when(a["pk"] < b["pk"], -1).when(a["pk"] > b["pk"], 1).otherwise(0))


def _orderable(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return all(_orderable(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _orderable(dtype.elementType)
    return not isinstance(dtype, (T.MapType, T.VariantType))


def to_json(docs: DataFrame) -> DataFrame:
    """``key`` (bytes) and ``value`` (JSON text, null for a tombstone), as the sinks take them."""
    return docs.select(F.col("pk").alias("key"), F.when(F.col("doc").isNotNull(), F.to_json("doc")).alias("value"))
