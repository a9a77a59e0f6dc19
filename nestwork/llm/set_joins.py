"""All pairs of similar sets, by sorted sketch forests and exact verification.

Every tree orders the items of all sets by its own hash; a set's signature in the tree is its items
in that order. Sets whose signatures begin alike are neighbours: they would stand side by side if all
signatures were sorted, and are brought together by a hash of the common beginning, which needs no
global sort. How deep the beginning reaches is
decided by its items alone: it goes on past items that more than ``RARE`` sets hold, up to
``DEEPEST``, so that a neighbourhood that ends in a rare item has at most ``RARE`` members. A set
joins ``TREES`` trees, or as many more as bring the probability that its least likely partner at the
threshold (one that lacks its unique and rare items first) is missed in all of them below ``MISS``.
That number follows from the set's items, not from the trees' orders, so it holds for every pair.
Sets for which ``MOST_TREES`` don't suffice (nearly all items they can share are frequent) are
besides compared on exact prefix tokens, least frequent items first: two such sets that reach the
threshold share one for certain. Neighbours pass two
bounds that lose nothing (sizes; 128-bit maps of the items) and are verified on the items. A large
neighbourhood is cut by size bands and into blocks, so no task holds it as a whole.

Identical sets are one set with several members. Sets of more than ``HUGE`` items are never made
into lists: their minima per tree are aggregated and overlaps counted by joins.

Defined results: null records or items are left out, repeated items count once, sets below
``min_size`` take no part, no rows give no pairs. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache, reduce
from math import ceil, inf, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import heavy_keys, lookup
from ..storage import materialize
from .pairs import BLOCK, fingerprints, pairs_in_blocks

RARE, DEEPEST, TREES, MOST_TREES, MISS, HUGE = 100, 4, 16, 96, 1e-5, 20_000
ENTRY = "key long, id long, n int, b1 long, b2 long"


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mixing of unsigned integers that depends on ``seed``."""
    with np.errstate(over="ignore"):
        x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x1234567) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=100_000)
def trees_needed(n: int, unique: int, rare: int, num: int, den: int, least: int) -> float:
    """Trees after which a set of ``n`` items has missed no partner of ``least`` items or more but with ``MISS``.

    A tree joins two sets if, in its order of their union, only common items precede and include the
    first rare one, or the first ``DEEPEST`` are common. A partner that lacks ``x`` items lacks all unique
    ones; it is the likelier missed the more rare ones it lacks and the more other items it has.
    No partner: 0. One that no tree can join: infinite.
    """
    x = np.arange(unique, n * (den - num) // den + 1)
    both = n - x
    union = both * den // num
    x, both, union = (v[both + union - n >= least] for v in (x, both, union))
    if not len(x):
        return 0
    rares = np.maximum(0, rare - (x - unique))
    frequent = both - rares
    joins, before = np.zeros(len(x)), np.ones(len(x))
    for k in range(DEEPEST):
        left = np.maximum(1, union - k)
        joins += before * rares / left
        before = before * np.maximum(0, frequent - k) / left
    worst = float((joins + before).min())
    return 1 if worst >= 1 else log(MISS) / log1p(-worst) if worst > 0 else inf


def forest(num: int, den: int, least: int):
    """Arrow batches of ``id, n, items<item, rank 0 unique 1 rare, else frequent by count>`` to tree entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from entries(batch)

    def entries(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = batch.column("items")
        flat = lists.flatten()
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        item = flat.field("it").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        rank = flat.field("rank").to_numpy(zero_copy_only=False)
        lens = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.concatenate(([0], np.cumsum(lens)[:-1]))
        base = mix(item, 0)
        which = (base >> np.uint64(6)) & np.uint64(1)
        one = np.uint64(1) << (base & np.uint64(63))
        bits = [np.bitwise_or.reduceat(np.where(which == np.uint64(w), one, np.uint64(0)), starts) for w in (0, 1)]
        owner = np.repeat(np.arange(len(ids)), lens)
        unique, rare = (np.add.reduceat((rank == r).astype(np.int64), starts) for r in (0, 1))
        trees = np.array([trees_needed(int(n), int(u), int(r), num, den, least) for n, u, r in zip(lens, unique, rare)])

        def out(key: np.ndarray, who: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(key.view(np.int64)),
                    pa.array(ids[who]),
                    pa.array(lens[who].astype(np.int32)),
                    pa.array(bits[0][who].view(np.int64)),
                    pa.array(bits[1][who].view(np.int64)),
                ],
                ["key", "id", "n", "b1", "b2"],
            )

        for tree in range(MOST_TREES):
            on = (trees > tree) | ((trees > 0) & (tree < TREES))
            if not on.any():
                break
            take = np.flatnonzero(on[owner])
            hashed = mix(base[take], tree + 1)
            order = take[np.lexsort((hashed, owner[take]))]
            who = np.flatnonzero(on)
            size = lens[who]
            first = np.concatenate(([0], np.cumsum(size)[:-1]))
            at = np.arange(len(order)) - np.repeat(first, size)
            ranked = rank[order]
            ends = np.minimum.reduceat(np.where(ranked < 2, at, 1 << 30), first)
            depth = np.minimum(np.minimum(ends + 1, DEEPEST), size)
            inside = at < np.repeat(depth, size)
            with np.errstate(over="ignore"):
                key = np.add.reduceat(np.where(inside, mix(base[order], tree + 1), np.uint64(0)), first)
            alone = np.minimum.reduceat(np.where(inside, ranked, 9), first) == 0
            send = ~alone
            yield out(mix(key[send], 1000 + tree), who[send])
        rest = trees > MOST_TREES
        if rest.any():
            take = np.flatnonzero(rest[owner])
            order = take[np.lexsort((base[take], rank[take], owner[take]))]
            size = lens[rest]
            first = np.concatenate(([0], np.cumsum(size)[:-1]))
            at = np.arange(len(order)) - np.repeat(first, size)
            need = -(-size * num // den)
            token = (at < np.repeat(size - need + 1, size)) & (rank[order] > 0)
            yield out(mix(item[order][token], 9999), owner[order][token])

    return run


def similar_sets(rows: DataFrame, record: str, item: str, threshold: Fraction, min_size: int) -> tuple[DataFrame, DataFrame]:
    """Links between different sets and the membership of sets held by several records.

    Links: ``id_a < id_b``, the smallest record of either set, ``both`` (items in common), ``n_a``,
    ``n_b``. Membership: ``rec, id, members`` for every record of a set with more than one.
    """
    num, den = threshold.numerator, threshold.denominator
    have = rows.select(F.col(record).alias("rec"), F.col(item).alias("it")).dropna().distinct()
    have = materialize(have, "sets")
    prints = fingerprints(have, "rec", "it").filter(F.col("n") >= min_size)
    prints = materialize(prints.select("rec", "n", F.struct("n", "x1", "x2").alias("print")), "prints")
    classes = prints.groupBy("print").agg(F.min("rec").alias("id"), F.count(F.lit(1)).alias("members"))
    classes = materialize(classes.select("print", "id", "members", F.col("print.n").cast("int").alias("n")), "set-classes")
    copied = classes.filter("members > 1").select("print", "id", "members")
    copies = lookup(prints.select("rec", "print"), copied, "print", heavy_keys(prints, "print", parts=500))
    membership = copies.filter(F.col("id").isNotNull()).select("rec", "id", "members")

    hot = classes.filter(F.col("n").cast("long") * 2000 >= have.count()).select("id")
    mine = lookup(have.withColumnRenamed("rec", "id"), classes.select("id", "n"), "id", hot).filter(F.col("n").isNotNull())
    mine = materialize(mine, "distinct-sets")
    # lists reach to the largest partner of a set of HUGE items; pairs of two larger sets are found without them
    small, big = mine.filter(F.col("n") * num <= HUGE * den), mine.filter(F.col("n") > HUGE)
    total = mine.count()
    counts = materialize(small.groupBy("it").agg(F.count(F.lit(1)).alias("c")), "set-items")
    rank = F.when(F.col("c") == 1, 0).when(F.col("c") <= RARE, 1).otherwise(F.col("c") + 1)
    ranks = counts.select("it", rank.alias("rank"))
    ranked = lookup(small, ranks, "it", counts.filter(F.col("c") * 2000 >= total))
    lists = materialize(
        ranked.groupBy("id").agg(F.first("n").alias("n"), F.collect_list(F.struct("it", "rank")).alias("items")), "set-lists"
    )
    found = _verified(_neighbours(lists, num, den, min_size), lists, num, den).filter(F.least("n_a", "n_b") <= HUGE)
    if not big.isEmpty():
        found = found.unionByName(_huge(big, num, den))
    return found, membership


def _neighbours(lists: DataFrame, num: int, den: int, least: int) -> DataFrame:
    """Distinct pairs ``id_a < id_b`` of sets that some tree makes neighbours and the bounds let pass."""
    e = materialize(lists.mapInArrow(forest(num, den, least), ENTRY), "forest")
    # bands of sizes by powers of the threshold: partners are in the same band or in the next
    band = F.floor(F.ln(F.col("n")) / log(den / num) + 1e-9).cast("int") if num < den else F.col("n")
    e = e.withColumn("band", band)
    crowds = e.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > 2 * BLOCK)
    crowds = materialize(crowds, "crowds")
    only = lambda x, y: sum((F.bit_count(F.col(f"b{i}_{x}").bitwiseAND(F.bitwise_not(f"b{i}_{y}"))) for i in (1, 2)), F.lit(0))
    most = F.least(F.col("n_a") - only("a", "b"), F.col("n_b") - only("b", "a"))
    near = (F.col("n_a") * den >= F.col("n_b") * num) & (F.col("n_b") * den >= F.col("n_a") * num)
    enough = near & (most * (num + den) >= (F.col("n_a") + F.col("n_b")) * num)
    side = lambda df, x, *keys: df.select(*keys, *(F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "b1", "b2")))
    few = e.join(crowds, "key", "left_anti") if (crowded := not crowds.isEmpty()) else e
    pairs = side(few, "a", "key").join(side(few, "b", "key"), "key").filter((F.col("id_a") < F.col("id_b")) & enough).select("id_a", "id_b")
    if crowded:
        many = e.join(crowds, "key")
        k = F.ceil(F.col("c") / BLOCK).cast("int")
        a = side(many.withColumn("block", F.pmod(F.xxhash64("id"), k).cast("int")), "a", "key", "band", "block")
        b = many.withColumn("band", F.explode(F.array("band", F.col("band") - 1))).withColumn("block", F.explode(F.sequence(F.lit(0), k - 1)))
        met = a.join(side(b, "b", "key", "band", "block"), ["key", "band", "block"]).filter((F.col("id_a") != F.col("id_b")) & enough)
        pairs = pairs.unionByName(met.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")))
    return pairs.distinct()


def _verified(pairs: DataFrame, lists: DataFrame, num: int, den: int) -> DataFrame:
    side = lambda x: lists.select(F.col("id").alias(f"id_{x}"), F.col("n").alias(f"n_{x}"), F.col("items.it").alias(f"its_{x}"))
    both = pairs.join(side("a"), "id_a").join(side("b"), "id_b")
    both = both.withColumn("both", F.size(F.array_intersect("its_a", "its_b")))
    return both.filter(F.col("both") * (num + den) >= (F.col("n_a") + F.col("n_b")) * num).select(
        "id_a", "id_b", "both", "n_a", "n_b"
    )


def _huge(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Links between sets too large for lists: minima per tree by aggregation, overlap by joins.

    A tree of depth one misses a pair at the threshold t with 1 - t; as many are made as miss it with
    less than ``MISS`` in all. There are at most as many such sets as rows / ``HUGE``.
    """
    n_trees = 1 if num >= den else ceil(log(MISS) / log1p(-num / den))
    trees = F.array(*(F.xxhash64(F.lit(t), F.col("it")) for t in range(n_trees)))
    low = rows.select("id", "n", F.posexplode(trees).alias("tree", "h")).groupBy("id", "n", "tree").agg(F.min("h").alias("h"))
    low = materialize(low, "huge-minima")
    a = low.select("tree", "h", F.col("id").alias("id_a"), F.col("n").alias("n_a"))
    b = low.select("tree", "h", F.col("id").alias("id_b"), F.col("n").alias("n_b"))
    near = (F.col("n_a") * den >= F.col("n_b") * num) & (F.col("n_b") * den >= F.col("n_a") * num)
    pairs = a.join(b, ["tree", "h"]).filter((F.col("id_a") < F.col("id_b")) & near)
    pairs = materialize(pairs.select("id_a", "id_b", "n_a", "n_b").distinct(), "huge-pairs")
    mine = pairs.join(rows.select(F.col("id").alias("id_a"), "it"), "id_a")
    met = mine.join(rows.select(F.col("id").alias("id_b"), "it"), ["id_b", "it"])
    both = met.groupBy("id_a", "id_b", "n_a", "n_b").agg(F.count(F.lit(1)).cast("int").alias("both"))
    return both.filter(F.col("both").cast("long") * (num + den) >= (F.col("n_a").cast("long") + F.col("n_b")) * num).select(
        "id_a", "id_b", "both", "n_a", "n_b"
    )


def expand(links: DataFrame, membership: DataFrame) -> DataFrame:
    """All pairs ``rec_a < rec_b`` of records: members of linked sets, and members of the same set.

    The members of a set are cut into blocks of about ``BLOCK``, and a link meets each pair of blocks on its own.
    """
    k = F.greatest(F.ceil(F.col("members") / BLOCK), F.lit(1)).cast("int")
    parted = membership.select("id", "rec", F.pmod(F.xxhash64("rec"), k).cast("int").alias("part"))
    parts = membership.groupBy("id").agg(F.first(k).alias("k"))

    def members(rows: DataFrame, x: str) -> DataFrame:
        n = parts.select(F.col("id").alias(f"id_{x}"), "k")
        of = parted.select(F.col("id").alias(f"id_{x}"), "part", F.col("rec").alias(f"rec_{x}"))
        asked = rows.join(n, f"id_{x}", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1)))
        return asked.drop("k").join(of, [f"id_{x}", "part"], "left").drop("part")

    both = members(members(links.select("id_a", "id_b"), "a"), "b")
    a, b = F.coalesce("rec_a", "id_a"), F.coalesce("rec_b", "id_b")
    across = both.select(F.least(a, b).alias("rec_a"), F.greatest(a, b).alias("rec_b"))
    same = pairs_in_blocks(membership, "id", "rec", F.col("members"), "rec_a", "rec_b").select("rec_a", "rec_b")
    return across.unionByName(same)


def link_counts(rows: DataFrame, links: DataFrame, membership: DataFrame, record: str) -> DataFrame:
    """One row per record: ``rec``, its set's ``id`` and ``n_links``, the other sets it is linked to."""
    ends = reduce(DataFrame.unionByName, (links.select(F.col(f"id_{x}").alias("id")) for x in "ab"))
    n = ends.groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
    recs = rows.select(F.col(record).alias("rec")).dropna().distinct().join(membership.select("rec", "id"), "rec", "left")
    recs = recs.withColumn("id", F.coalesce("id", "rec"))
    return recs.join(n, "id", "left").select("rec", "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
