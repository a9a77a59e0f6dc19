"""Join and parent indices: which children a parent key finds, and which roots depend on a key.

All indices are rows ``(index, fk, pk)`` of canonical bytes; forward and reverse are groupings of
them. Null and empty keys are in no index. Adding twice adds once.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keysets
from ..plans.builder import Pruned, Tables, field_type, index_key, key_of
from ..plans.relations import Edge, Relation, edges

INDEX = "index string, fk binary, pk binary"


def join_index(tables: Tables, roots: Iterable[Relation]) -> DataFrame:
    """The join indices of all trees: join key of every child record to its primary key."""
    names = {e.join_index: e for r in roots for e in edges(r)}
    parts = []
    for name, e in sorted(names.items()):
        table = tables[e.child.entity]
        rows = table.select(F.lit(name).alias("index"), index_key(table, e.child.join_key).alias("fk"), "pk")
        parts.append(rows.filter(F.col("fk").isNotNull() & (F.length("pk") > 0)))
    return reduce(DataFrame.unionByName, parts).distinct()


def parent_index(tables: Tables, root: Relation, roots: DataFrame | None = None, pruned: Pruned | None = None) -> DataFrame:
    """For every root document the parent keys it looked up, matched or not: ``edge, fk, pk`` (of the root).

    ``roots`` (``pk``) restricts it to some root records; ``pruned`` then holds the records below them, if
    :func:`plans.builder.prune` has found them. Only key columns travel down the tree.
    """
    found: list[DataFrame] = []
    deep: list[DataFrame] = []

    def below(node: Relation, path: tuple[str, ...], mine: DataFrame) -> None:
        # mine: root_pk, value
        for child in node.children:
            edge = Edge(root.denormalized_name or root.entity, path, node, child)
            looked = mine.select(F.lit(edge.id).alias("edge"), index_key(mine, child.parent_key).alias("fk"), F.col("root_pk").alias("pk"))
            (deep if len(path) > 1 else found).append(looked.filter(F.col("fk").isNotNull()))
            if child.children:
                table = tables[child.entity] if pruned is None else pruned[(*path, child.entity)]
                down = list(dict.fromkeys([c.parent_key for c in child.children]))
                parent_type, child_type = field_type(mine, child.parent_key), field_type(table, child.join_key)
                key = key_of(mine, child.parent_key, child_type)
                steps = mine.select("root_pk", key.alias("_k")).filter("_k is not null")
                if len(path) > 1:  # a root has one record, so its own steps are distinct
                    steps = steps.distinct()
                rows = table.select(
                    key_of(table, child.join_key, parent_type).alias("_k"), F.struct(*(F.col("value")[c].alias(c) for c in down)).alias("value")
                )
                below(child, (*path, child.entity), steps.join(rows, "_k").select("root_pk", "value"))

    top = tables[root.entity] if pruned is None else pruned[(root.entity,)]
    if roots is not None and pruned is None:
        top = top.join(roots.select("pk").distinct(), "pk", "left_semi")
    below(root, (root.entity,), top.select(F.col("pk").alias("root_pk"), "value"))
    own = reduce(DataFrame.unionByName, found)
    return own.unionByName(reduce(DataFrame.unionByName, deep).distinct()) if deep else own


def named_parent_index(rows: DataFrame, root: Relation) -> DataFrame:
    """Parent index rows under index names instead of edges: ``index, fk, pk``."""
    names = F.create_map(*(F.lit(x) for e in edges(root) for x in (e.id, e.parent_index)))
    return rows.select(names[F.col("edge")].alias("index"), "fk", "pk").distinct()


def add(index: DataFrame, rows: DataFrame) -> DataFrame:
    return keysets.rows_union(index, rows.filter((F.length("fk") > 0) & (F.length("pk") > 0)))


def remove(index: DataFrame, rows: DataFrame) -> DataFrame:
    return keysets.rows_minus(index, rows)


def removed(index: DataFrame, rows: DataFrame) -> DataFrame:
    """Of ``rows`` those that :func:`remove` takes out, each once."""
    return keysets.rows_intersect(index, rows)


def join_changes(image: DataFrame, table: DataFrame, join_key: str) -> DataFrame:
    """What a batch changes in a join index: ``fk, pk, live``, from ``pk, old, new``.

    A key that a record leaves is dropped, one that it takes is added; a deleted record leaves its key, a
    null or empty key is in no index, and a record that keeps its key changes nothing.
    """
    old, new = (index_key(table, join_key, F.col(x)) for x in ("old", "new"))
    both = image.select("pk", old.alias("_old"), new.alias("_new")).filter(~F.col("_old").eqNullSafe(F.col("_new")) & (F.length("pk") > 0))
    ends = F.array(F.struct(F.col("_old").alias("fk"), F.lit(False).alias("live")), F.struct(F.col("_new").alias("fk"), F.lit(True).alias("live")))
    return both.select("pk", F.explode(ends).alias("e")).select("e.fk", "pk", "e.live").filter("fk is not null")


def updated(index: DataFrame, changes: DataFrame) -> DataFrame:
    """A join index (``fk, pk``) after :func:`join_changes`."""
    gone, new = (changes.filter(F.col("live") == x).select("fk", "pk") for x in (False, True))
    return index.select("fk", "pk").join(gone, ["fk", "pk"], "left_anti").unionByName(new).distinct()


def scrub(index: DataFrame, roots: DataFrame) -> DataFrame:
    """The index without the rows of the given roots (``pk``)."""
    return index.join(roots.select("pk").distinct(), "pk", "left_anti")


def forward(index: DataFrame, by: str = "index") -> DataFrame:
    """``index, fk, keys``: the sorted primary keys of every foreign key."""
    return index.groupBy(by, "fk").agg(keysets.collect(F.col("pk")).alias("keys"))


def reverse(index: DataFrame, by: str = "index") -> DataFrame:
    """``index, pk, keys``: the sorted foreign keys of every primary key."""
    return index.groupBy(by, "pk").agg(keysets.collect(F.col("fk")).alias("keys"))


def verify(fwd: DataFrame, rev: DataFrame, by: str = "index") -> DataFrame:
    """Entries of either side that the other lacks: ``index, fk, pk, missing`` (``forward`` or ``reverse``)."""
    f = fwd.select(by, "fk", F.explode("keys").alias("pk"))
    r = rev.select(by, F.explode("keys").alias("fk"), "pk")
    on = [by, "fk", "pk"]
    lost = f.select(on).join(r.select(on), on, "left_anti").withColumn("missing", F.lit("reverse"))
    return lost.unionByName(r.select(on).join(f.select(on), on, "left_anti").withColumn("missing", F.lit("forward")))


def dump(index: DataFrame, by: str = "index") -> DataFrame:
    """Readable lines, one JSON object per entry, keys in hexadecimal."""
    hexed = forward(index, by).select(by, F.hex("fk").alias("fk"), F.transform("keys", F.hex).alias("pks"))
    return hexed.select(F.to_json(F.struct(by, "fk", "pks")).alias("value"))


def entry_sizes(index: DataFrame, by: str = "index") -> DataFrame:
    """Per index how many foreign keys it has, how many keys they hold together, and the largest entry."""
    sizes = index.groupBy(by, "fk").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(by).agg(F.count(F.lit(1)).alias("n_entries"), F.sum("n").alias("n_keys"), F.max("n").alias("largest"))


def affected_roots(images: dict[str, DataFrame], tables: Tables, root: Relation, index: DataFrame) -> DataFrame:
    """Roots whose documents the changes can touch: ``pk, entity`` (the entity that changed).

    ``images``: per entity ``pk, old, new`` (see :func:`latest.before_images`). Every place of an
    entity counts, and both the old and the new join key, through the parent index from before.
    """
    parts = []
    for entity, image in images.items():
        if entity == root.entity:
            parts.append(image.select("pk", F.lit(entity).alias("entity")))
        for e in edges(root):
            if e.child.entity == entity:
                key = [index_key(tables[entity], e.child.join_key, F.col(x)) for x in ("old", "new")]
                keys = image.select(F.explode(F.array(*key)).alias("fk")).filter("fk is not null").distinct()
                hit = index.filter(F.col("edge") == e.id).join(keys, "fk", "left_semi")
                parts.append(hit.select("pk", F.lit(entity).alias("entity")))
    if not parts:
        return index.sparkSession.createDataFrame([], "pk binary, entity string")
    return reduce(DataFrame.unionByName, parts).distinct()
