"""Co-occurring items against brute force, with baskets on both sides of the size limit."""

import random
from collections import Counter
from itertools import combinations

import pytest

from nestwork.llm import cooccurrence, pairs


def brute(rows, min_count, min_lift):
    baskets = {}
    for b, i in rows:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
    n = Counter(i for s in baskets.values() for i in s)
    both = Counter(p for s in baskets.values() for p in combinations(sorted(s), 2))
    total = len(baskets)
    return sorted((a, b, k, n[a], n[b], total) for (a, b), k in both.items() if k >= min_count and k * total >= min_lift * n[a] * n[b])


def found(spark, rows, *limits):
    df = spark.createDataFrame(rows, "b long, i long")
    got = cooccurrence.cooccurring_pairs(df, "b", "i", *limits)
    return got, sorted((r.item_a, r.item_b, r.n_ab, r.n_a, r.n_b, r.n_baskets) for r in got.collect())


def random_rows(seed, sizes=(1, 12), baskets=80, items=40):
    r = random.Random(seed)
    rows = [(b, min(items, int(r.paretovariate(0.8)))) for b in range(baskets) for _ in range(r.randrange(*sizes))]
    rows += [(b + 1000, i) for b in range(30) for i in (1, 2, 3)]  # identical baskets
    rows += [(None, 1), (1, None), (7777, 5)] + rows[:20]
    return rows


@pytest.mark.parametrize("limits", [(3, 0), (2, 1), (6, 2)])
def test_small_baskets(spark, limits):
    rows = random_rows(1)
    assert found(spark, rows, *limits)[1] == brute(rows, *limits)


@pytest.mark.parametrize("light", [2, 5])
@pytest.mark.parametrize("min_count", [2, 4])
def test_large_baskets(spark, monkeypatch, light, min_count):
    """Most baskets are over the limit, some of them identical; one holds nearly everything."""
    monkeypatch.setattr(cooccurrence, "LIGHT", light)
    monkeypatch.setattr(pairs, "BLOCK", 3)
    rows = random_rows(2, (1, 20), 40, 25) + [(5000, i) for i in range(60)] + [(5001, i) for i in range(50)] + [(5002, i) for i in range(50)]
    assert found(spark, rows, min_count, 0)[1] == brute(rows, min_count, 0)


def test_scores(spark):
    rows = [(b, 1) for b in range(4)] + [(b, 2) for b in range(2, 8)] + [(9, 3), (9, 4), (8, 3), (8, 4)]
    got = {(r.item_a, r.item_b): r for r in found(spark, rows, 2, 0)[0].collect()}
    assert got[1, 2].lift == pytest.approx(2 * 10 / 24) and got[1, 2].conviction == pytest.approx((1 - 0.6) / (1 - 0.5))
    assert got[3, 4].lift == pytest.approx(5) and got[3, 4].conviction is None


def test_no_rows_and_clashing_names(spark):
    assert found(spark, [], 2, 0)[1] == []
    assert found(spark, [(1, 1), (2, 1)], 1, 0)[1] == []
    df = spark.createDataFrame([(1, 1, 9, 9), (1, 2, 9, 9), (2, 1, 9, 9), (2, 2, 9, 9)], "bk long, it long, n long, w long")
    assert cooccurrence.cooccurring_pairs(df, "bk", "it", 2, 0).count() == 1


def test_one_basket_with_a_third_of_the_rows(spark):
    """Its pairs are never enumerated: with few larger baskets it adds only to pairs found elsewhere."""
    rows = [(0, i) for i in range(20_000)] + [(b, b * 7 % 19_000 + j) for b in range(1, 4001) for j in range(10)]
    n = Counter(i for _, i in set(rows))
    small = Counter(p for b in range(1, 4001) for p in combinations(sorted({b * 7 % 19_000 + j for j in range(10)}), 2))
    want = sorted((a, b, k + 1, n[a], n[b], 4001) for (a, b), k in small.items() if k + 1 >= 3)
    assert found(spark, rows, 3, 0)[1] == want
