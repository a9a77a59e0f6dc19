"""Similar sets against brute force: also with hot items, copies, exact tokens and sets without lists."""

import random
from fractions import Fraction
from itertools import combinations

import pyarrow as pa
import pytest

from nestwork.llm import set_joins

T = Fraction(3, 5)


def families(seed, n, universe, size=(4, 14)):
    """Random sets and relatives of them: copies, near copies, parts."""
    r = random.Random(seed)
    sets = {}
    for i in range(n):
        base = r.sample(range(universe), r.randint(*size))
        sets[10 * i] = set(base)
        for k in range(1, r.choice([1, 1, 3, 4])):
            kin = set(base)
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                kin.discard(r.choice(base))
                kin.add(r.randrange(universe))
            sets[10 * i + k] = kin
    return sets


def brute(sets, min_size, t=T):
    out = []
    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if min(len(x), len(y)) >= min_size and len(x & y) >= t * len(x | y):
            out.append((a, b))
    return out


def frame(spark, sets):
    rows = [(k, i) for k, s in sets.items() for i in s]
    return spark.createDataFrame(rows + rows[:50] + [(None, 1), (1, None)], "r long, i long")


def joined(spark, sets, min_size=5, t=T):
    df = frame(spark, sets)
    links, members = set_joins.similar_sets(df, "r", "i", t, min_size)
    links, members = links.persist(), members.persist()
    got = sorted((r.rec_a, r.rec_b) for r in set_joins.expand(links, members).collect())
    return got, links, members, df


@pytest.mark.parametrize("universe", [4000, 60])
def test_against_brute_force(spark, universe):
    sets = families(1, 150, universe)
    got, links, members, df = joined(spark, sets)
    want = brute(sets, 5)
    assert got == want and len(want) > 20
    assert all(r.id_a < r.id_b for r in links.collect())
    counts = {r.rec: r for r in set_joins.link_counts(df, links, members, "r").collect()}
    assert set(counts) >= set(sets)
    for k, s in sets.items():
        own = {frozenset(sets[x]) for p in want if k in p for x in p} - {frozenset(s)}
        assert counts[k].n_links == len(own)
        assert counts[k].id == (min(x for x, y in sets.items() if y == s) if len(s) >= 5 else k)


def test_everything_is_frequent(spark, monkeypatch):
    """No item is rare: sets go on to many trees and to the exact tokens."""
    monkeypatch.setattr(set_joins, "RARE", 1)
    sets = families(2, 80, 30, (5, 9))
    assert joined(spark, sets)[0] == brute(sets, 5)


def test_exact_tokens_alone_suffice(spark, monkeypatch):
    monkeypatch.setattr(set_joins, "RARE", 1)
    monkeypatch.setattr(set_joins, "MOST_TREES", 0)
    sets = families(3, 80, 30, (5, 12))
    assert joined(spark, sets)[0] == brute(sets, 5)


def test_sets_without_lists(spark, monkeypatch):
    monkeypatch.setattr(set_joins, "HUGE", 10)
    sets = families(4, 60, 3000, (5, 40))
    assert joined(spark, sets)[0] == brute(sets, 5)


def test_other_thresholds(spark):
    sets = families(5, 60, 500)
    for t in (Fraction(1, 2), Fraction(4, 5), Fraction(1)):
        assert joined(spark, sets, 4, t)[0] == brute(sets, 4, t)


def test_a_third_are_copies(spark):
    sets = families(6, 100, 1000) | {10_000 + i: {1, 2, 3, 4, 5} for i in range(60)}
    got, links, members, _ = joined(spark, sets)
    assert got == brute(sets, 5)
    assert links.count() < 300  # copies aren't expanded there


def test_crowded_neighbourhoods(spark, monkeypatch):
    """Large neighbourhoods and large classes are cut into blocks; the pairs stay the same."""
    monkeypatch.setattr(set_joins, "BLOCK", 4)
    monkeypatch.setattr(set_joins, "RARE", 1)
    sets = families(11, 80, 25, (5, 12)) | {10_000 + i: {1, 2, 3, 4, 5} for i in range(30)} | {20_000 + i: {1, 2, 3, 4, 5, 6} for i in range(13)}
    for t in (Fraction(3, 5), Fraction(1)):
        assert joined(spark, sets, 5, t)[0] == brute(sets, 5, t)


@pytest.mark.parametrize("num,den,both,own", [(3, 10, 6, 7), (1, 2, 6, 3), (3, 5, 9, 3), (4, 5, 16, 2)])
@pytest.mark.parametrize("rank", [0, 1])
def test_recall_of_frequent_shared_and_rare_own_items(num, den, both, own, rank):
    """Pairs exactly at the threshold that share frequent items only and have unique (0) or rare (1) ones of their own."""
    r = random.Random(12)
    new, lists = iter(range(10**6, 10**7)), []
    for _ in range(1500):
        common = r.sample(range(500), both)
        lists += [[{"it": x, "rank": 200 + x} for x in common] + [{"it": next(new), "rank": rank} for _ in range(own)] for _ in "ab"]
    ids, kind = pa.array(range(len(lists)), pa.int64()), pa.list_(pa.struct([("it", pa.int64()), ("rank", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([ids, pa.array([both + own] * len(lists), pa.int32()), pa.array(lists, kind)], ["id", "n", "items"])
    met = {}
    for out in set_joins.forest(num, den, 5)(iter([batch])):
        for key, who in zip(out.column("key").to_pylist(), out.column("id").to_pylist()):
            met.setdefault((who // 2, key), set()).add(who)
    assert len({pair for (pair, _), who in met.items() if len(who) == 2}) >= 1499


def test_nothing(spark):
    assert joined(spark, {})[0] == []
    assert joined(spark, {1: {1, 2}, 2: {1, 2}})[0] == []


def test_recall_over_many_sets(spark):
    """At the threshold itself, where a partner is likeliest to be missed."""
    r = random.Random(7)
    sets = {}
    for i in range(3000):
        base = r.sample(range(200_000), 8)
        sets[2 * i] = set(base)
        sets[2 * i + 1] = set(base[:6]) | {300_000 + i, 400_000 + i}
    got = joined(spark, sets)[0]
    assert len(got) >= 2999


def test_recall_where_only_frequent_items_are_shared(spark):
    """At 0.6, all common items held by many sets and all others unique: prefixes that can match are deep ones only."""
    r = random.Random(8)
    sets = {}
    for i in range(1500):
        base = set(r.sample(range(60), 6))
        sets[2 * i] = base | {300_000 + 2 * i, 300_001 + 2 * i}
        sets[2 * i + 1] = base | {400_000 + 2 * i, 400_001 + 2 * i}
    got = set(joined(spark, sets)[0])
    assert [i for i in range(1500) if (2 * i, 2 * i + 1) not in got] == []


def test_trees_needed_against_trials():
    """The worst partner's chance in a tree, by drawing orders."""
    r = random.Random(9)
    # of 8 items 1 is unique, 2 are rare: a partner at 0.6 lacks 1 to 3 of them, rare ones first, and has others
    worst = 1.0
    for x, rare, others in ((1, 2, 3), (2, 1, 2), (3, 0, 0)):
        union = ["r"] * rare + ["f"] * (8 - x - rare) + ["-"] * (x + others)
        hits = 0
        for _ in range(40_000):
            first = r.sample(union, 4)
            end = first.index("r") + 1 if "r" in first else 4
            hits += "-" not in first[:end]
        worst = min(worst, hits / 40_000)
    need = set_joins.trees_needed(8, 1, 2, 3, 5, 5)
    assert abs((1 - set_joins.MISS ** (1 / need)) - worst) < 0.01
    assert set_joins.trees_needed(8, 4, 0, 3, 5, 5) == 0  # too many that nobody shares
