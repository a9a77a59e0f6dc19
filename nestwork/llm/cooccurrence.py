"""Items that appear together more often than by chance, by basket collapsing.

Baskets are reduced to their distinct frequent items, identical ones collapse into one with a
weight, pairs are enumerated once per distinct basket and their weights summed.

A pair that occurs in at least ``min_count`` baskets needs no enumeration of the largest ones: order
all baskets by size. If the pair shares baskets of weight ``min_count`` or more, the smallest of them
is, for either item, not among its last baskets of total weight below ``min_count``. So large baskets
(over ``LIGHT`` items) enumerate only members for which they are not among those last; whatever the
largest ones add to a pair is looked up afterwards, for the pairs that were found. Counts are exact,
and nothing is capped.

Defined results: rows with a null basket or item are left out, repeated rows count once, baskets of
one item count in the number of baskets only; no rows give no pairs. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import lookup
from ..storage import materialize
from .pairs import fingerprints, pairs_in_blocks

LIGHT = 256
BIG = "decimal(38,0)"


def cooccurring_pairs(rows: DataFrame, basket: str, item: str, min_count: int, min_lift: int) -> DataFrame:
    """Pairs with ``n_ab >= min_count`` and lift at least ``min_lift`` (0 for any).

    Result: ``media_a < media_b`` style columns ``item_a, item_b, n_ab, n_a, n_b, n_baskets, lift,
    conviction`` (of a to b; null where a never stands without b).
    """
    have = rows.select(F.col(basket).alias("bk"), F.col(item).alias("it")).dropna().distinct()
    have = materialize(have, "baskets")
    n_rows = have.count()
    n_baskets = have.select("bk").distinct().count()
    counts = materialize(have.groupBy("it").agg(F.count(F.lit(1)).alias("n_it")), "items")
    # n_ab <= n_b, so a lift of L asks that L * n_a <= number of baskets
    keep = counts.filter((F.col("n_it") >= min_count) & (F.col("n_it").cast(BIG) * min_lift <= n_baskets))
    heavy = keep.filter(F.col("n_it") * 2000 >= n_rows)
    frequent = lookup(have, keep, "it", heavy).filter(F.col("n_it").isNotNull()).select("bk", "it")
    frequent = materialize(frequent, "frequent")

    prints = fingerprints(frequent, "bk", "it").filter("n > 1")
    classes = materialize(
        prints.groupBy("n", "x1", "x2").agg(F.count(F.lit(1)).alias("w"), F.min("bk").alias("bk")).select("bk", "w", "n"),
        "basket-classes",
    )
    hot = classes.filter(F.col("n") * 2000 >= n_rows).select("bk")
    collapsed = lookup(frequent, classes, "bk", hot).filter(F.col("w").isNotNull())
    found = _light_pairs(collapsed.filter(F.col("n") <= LIGHT))
    if classes.filter(F.col("n") > LIGHT).isEmpty():
        found = found.groupBy("a", "b").agg(F.sum("w").alias("n_ab"))
    else:
        found = _with_large(found, materialize(collapsed.filter(F.col("n") > LIGHT), "large-baskets"), min_count)
    found = materialize(found.filter(F.col("n_ab") >= min_count), "pairs-found")

    # a frequent item is in many pairs: those meet its count by broadcast
    of = lambda df, c: lookup(df, keep.select(F.col("it").alias(c), F.col("n_it").alias(f"n_{c}")), c, heavy.select(F.col("it").alias(c)))
    scored = of(of(found, "a"), "b")
    total = F.lit(n_baskets).cast("decimal(19,0)")
    scored = scored.filter(F.col("n_ab").cast("decimal(19,0)") * total >= F.col("n_a").cast("decimal(19,0)") * F.col("n_b") * min_lift)
    big = lambda c: F.col(c).cast("double")
    return scored.select(
        F.col("a").alias("item_a"),
        F.col("b").alias("item_b"),
        "n_ab",
        "n_a",
        "n_b",
        F.lit(n_baskets).cast("long").alias("n_baskets"),
        (big("n_ab") * float(n_baskets) / (big("n_a") * big("n_b"))).alias("lift"),
        F.when(
            F.col("n_a") > F.col("n_ab"),
            (float(n_baskets) - big("n_b")) * big("n_a") / (float(n_baskets) * (big("n_a") - big("n_ab"))),
        ).alias("conviction"),
    )


def _light_pairs(rows: DataFrame) -> DataFrame:
    """``a, b, w`` of every distinct basket of at most ``LIGHT`` items."""
    lists = rows.groupBy("bk").agg(F.array_sort(F.collect_list("it")).alias("its"), F.first("w").alias("w"))
    one = lists.select("w", "its", F.posexplode("its").alias("i", "a"))
    return one.select("a", F.explode(F.slice("its", F.col("i") + 2, F.size("its"))).alias("b"), "w")


def _with_large(light: DataFrame, large: DataFrame, min_count: int) -> DataFrame:
    """Summed weights ``a, b, n_ab`` of pairs of the small baskets and of ``large`` (``bk, it, w, n``)."""
    by_size = Window.partitionBy("it").orderBy(F.col("n").desc(), F.col("bk").desc())
    last = large.withColumn("r", F.row_number().over(by_size)).filter(F.col("r") < min_count)
    upto = by_size.rowsBetween(Window.unboundedPreceding, 0)
    last = materialize(
        last.withColumn("sum_w", F.sum("w").over(upto)).filter(F.col("sum_w") < min_count).select("bk", "it", "w"),
        "last-baskets",
    )
    first = materialize(large.join(last.select("bk", "it"), ["bk", "it"], "left_anti"), "first-baskets")
    sizes = first.groupBy("bk").agg(F.count(F.lit(1)).alias("m"))
    within = pairs_in_blocks(first.join(sizes, "bk"), "bk", "it", F.col("m"), "a", "b").select("a", "b", "w")
    found = materialize(light.unionByName(within).groupBy("a", "b").agg(F.sum("w").alias("c")), "pair-counts")

    lists = last.groupBy("it").agg(F.collect_list(F.struct("bk", "w")).alias("l"), F.sum("w").alias("s"))
    side = lambda x: lists.select(F.col("it").alias(x), F.col("l").alias(f"l{x}"), F.col("s").alias(f"s{x}"))
    # an item's list is one row: pairs of an item in many of them meet it by broadcast
    often = lambda x: found.groupBy(x).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * 500 >= n_found)
    n_found = found.count()
    open_ = lookup(lookup(found, side("a"), "a", often("a")), side("b"), "b", often("b"))
    none = F.array().cast("array<struct<bk:bigint,w:bigint>>")
    open_ = open_.withColumn(
        "both",
        F.aggregate(
            F.array_intersect(F.coalesce("la", none), F.coalesce("lb", none)), F.lit(0).cast("long"), lambda s, x: s + x["w"]
        ),
    ).filter(
        F.col("c") + F.coalesce("sa", F.lit(0)) + F.coalesce("sb", F.lit(0)) - F.col("both") >= min_count
    )
    members = first.select("bk", "it")

    def mixed(mine: str, other: str) -> DataFrame:
        asked = open_.filter(F.col(f"l{mine}").isNotNull()).select("a", "b", F.explode(f"l{mine}").alias("x"))
        asked = asked.select("a", "b", F.col("x.bk").alias("bk"), F.col("x.w").alias("n_ab"), F.col(other).alias("it"))
        return asked.join(members, ["bk", "it"]).select("a", "b", "n_ab")

    base = open_.select("a", "b", (F.col("c") + F.col("both")).alias("n_ab"))
    every = base.unionByName(mixed("a", "b")).unionByName(mixed("b", "a"))
    return every.groupBy("a", "b").agg(F.sum("n_ab").alias("n_ab"))
