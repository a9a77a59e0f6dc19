import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from nestwork.llm import mixing
from nestwork.llm.mixing import _pivot, _round_task, chance, mixed_pages, source_plan, with_token_counts, word_count
from nestwork.llm.queries import TOKEN_PATTERN, TOKENIZER

P, M = "doc_id long, source string, size long", "source string, weight double, max_repeat int"


def pages(seed, n=3000):
    r = random.Random(seed)
    names = ["A", "A", "A", " a ", "b", "B", "c", None, "nobody's"]
    return [(i, r.choice(names), r.choice([0, 5, 10, 200, None])) for i in range(n)]


TARGETS = [("A", 0.5, 3), ("B", 0.3, 4), ("C", 0.15, 1), ("Empty", 0.05, 9)]


def test_plan(spark):
    ps = pages(1)
    plan = {r.source: r for r in source_plan(spark.createDataFrame(ps, P), spark.createDataFrame(TARGETS, M)).collect()}
    total = sum(s or 0 for _, _, s in ps)
    for name, weight, most in TARGETS:
        size = sum(s or 0 for _, x, s in ps if x and x.strip().lower() == name.lower())
        assert plan[name].size == size and plan[name].total == total
        assert plan[name].short == (most * size < weight * total)
        assert plan[name].copies == pytest.approx(min(most, weight * total / size) if size else 0)


@pytest.mark.parametrize("parts", [1, 7])
def test_draw(spark, parts):
    ps = pages(2)
    df = spark.createDataFrame(ps, P).repartition(parts)
    drawn, report = mixed_pages(df, spark.createDataFrame(TARGETS, M))
    rows, plan = drawn.collect(), {r.source: r for r in source_plan(df, spark.createDataFrame(TARGETS, M)).collect()}
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
        low = int(plan[r.source].copies)
        assert low <= r.copies <= min(low + 1, plan[r.source].max_repeat)
    assert len({r.doc_id for r in rows}) == len(rows)
    for name, own in by.items():
        n = sum(1 for _, x, _ in ps if x and x.strip().lower() == name.lower())
        assert abs(sum(r.copies for r in own) - plan[name].copies * n) < 1  # pivotal: the number of copies is held
    reported = {r.source: r for r in report.collect()}
    whole = sum(r.size * r.copies for r in rows)
    for name, weight, _ in TARGETS:
        mine = sum(r.size * r.copies for r in by.get(name, []))
        assert reported[name].drawn == mine and reported[name].share == pytest.approx(mine / whole)
        if not reported[name].short:
            assert mine == pytest.approx(reported[name].wanted, rel=0.05)
    again = mixed_pages(df, spark.createDataFrame(TARGETS, M))[0]
    assert sorted(again.collect()) == sorted(rows)


def test_inclusion_is_unbiased():
    ps = [0.1, 0.25, 0.5, 0.8, 0.35, 0.9, 0.6]
    hits = [0] * len(ps)
    for n in range(20_000):
        done, left = _pivot([(i, p, hash((n, i))) for i, p in enumerate(ps)], 0)
        chosen = [i for i, v in done if v] + ([left[0]] if left and chance(n, left[0], 7) < left[1] else [])
        assert len(chosen) in (3, 4) and len(done) + (left is not None) == len(ps)
        for i in chosen:
            hits[i] += 1
    assert all(abs(h / 20_000 - p) < 0.015 for h, p in zip(hits, ps))


@pytest.mark.parametrize("batch,parts", [(10_000, 1), (2, 3)])
def test_inclusion_over_batches_tasks_and_the_tree(spark, batch, parts, monkeypatch):
    """Many sources alike, of one to five pages: how often a page is drawn is its expectation, however batches and tasks cut the input."""
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    sizes = [(7,), (3, 5), (2, 2, 9), (1, 2, 3, 4), (5, 5, 5, 5, 30)]
    rows = [(1000 * s + i, f"s{s}", size) for s in range(500) for i, size in enumerate(sizes[s % 5])]
    total = sum(r[2] for r in rows)
    share = [sum(sizes[s % 5]) * (0.3, 0.55, 0.4, 0.7, 0.25)[s % 5] / total for s in range(500)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        df = spark.createDataFrame(rows, P).repartition(parts, "size") if parts > 1 else spark.createDataFrame(rows, P).coalesce(1)
        drawn = mixed_pages(df, spark.createDataFrame([(f"s{s}", w, 3) for s, w in enumerate(share)], M))[0].collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    hits = {}
    for r in drawn:
        kind, place = int(r.source[1:]) % 5, r.doc_id % 1000
        hits[kind, place] = hits.get((kind, place), 0) + r.copies
    for kind, want in enumerate((0.3, 0.55, 0.4, 0.7, 0.25)):
        for place in range(len(sizes[kind])):
            assert abs(hits.get((kind, place), 0) / 100 - want) < 4 * (want * (1 - want) / 100) ** 0.5, (kind, place)


@pytest.mark.parametrize("cut", [1, 2, 4])
def test_inclusion_over_batches(cut):
    """Four pages of one source, in batches of so many rows."""
    want, hits = [0.3, 0.6, 0.5, 0.2], [0] * 4
    for n in range(1500):
        rows = pd.DataFrame({"doc_id": range(4), "source": "a", "size": [4, 3, 2, 1], "p": want, "h": [int(1e18 * chance(n, i)) for i in range(4)]})
        for out in _round_task(iter([rows[i : i + cut] for i in range(0, 4, cut)])):
            for doc_id, p, h in zip(out["doc_id"], out["p"], out["h"]):
                hits[doc_id] += p == 1 or 0 < p < 1 and chance(int(h), 99) < p
    assert all(abs(h / 1500 - p) < 0.045 for h, p in zip(hits, want)), hits


def test_targets_that_compare_equal(spark):
    some = spark.createDataFrame([(i, "a", 10) for i in range(10)], P)
    drawn, report = mixed_pages(some, spark.createDataFrame([("a", 0.5, 1), (" A", 0.2, 1), ("b", 0.3, 1)], M))
    got = {r.source: (r.n_drawn, r.short) for r in report.collect()}
    assert got == {"a": (5, False), " A": (2, False), "b": (0, True)} and drawn.count() == 7


def test_edges(spark):
    none = spark.createDataFrame([], P)
    targets = spark.createDataFrame([("A", None, 2), ("B", 1.0, None)], M)
    drawn, report = mixed_pages(none, targets)
    assert drawn.isEmpty() and report.count() == 2
    some = spark.createDataFrame([(1, "a", 5), (1, "a", 5), (2, "b", 1)], P)
    drawn, report = mixed_pages(some, targets)
    assert drawn.isEmpty() and {r.source: r.short for r in report.collect()} == {"A": False, "B": True}
    drawn, _ = mixed_pages(some, spark.createDataFrame([("a", 1.0, 2)], M))
    assert sorted((r.doc_id, r.copies) for r in drawn.collect()) in ([(1, 1), (1, 1)], [(1, 1), (1, 2)])
    assert mixed_pages(some, spark.createDataFrame([], M))[1].isEmpty()


def test_word_count(spark):
    texts = ["a  b\nc", "", None, " \n ", "one\ttwo\r\nthree"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(word_count("t")).collect()] == [3, 0, 0, 0, 3]


def test_token_counts(spark):
    import base64
    import os

    import tiktoken

    if not os.path.exists(TOKENIZER):
        pytest.skip("no vocabulary here")
    texts = ["Hello world, it's 1899!", "", None, "Käse\n\n  brot " * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("source", F.lit("x"))
    got = [r.size for r in with_token_counts(df, "text", TOKENIZER, TOKEN_PATTERN).orderBy("doc_id").collect()]
    with open(TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("t", pat_str=TOKEN_PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert got == [len(coder.encode_ordinary(t)) if t else 0 for t in texts]
    assert all(coder.decode(coder.encode_ordinary(t)) == t for t in texts if t)
