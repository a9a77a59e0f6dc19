"""Current state, orphan references, the merge table, and key counts, against plain Python."""

from collections import Counter
from datetime import timedelta

import pytest
from logs import LOG, START, dead, decide, random_log, rng
from pyspark.sql import functions as F

from nestwork.operators.changelog import current_state, deciding_change
from nestwork.operators import skew
from nestwork.operators.lsm import LsmTable, from_log
from nestwork.operators.orphans import Reference, orphan_counts, orphan_references, orphan_totals
from nestwork.operators.skew import eager_join_aggregate, heavy_keys, key_counts, lookup

SCHEMA = f"id long, owner long, {LOG}"


def log_rows(seed, n=300, keys=60, nulls=False):
    r = rng(seed)
    key = lambda x: (x.randrange(keys) if x.random() < 0.7 else x.choice([7, 7, None]) if nulls else 7,)
    return random_log(r, key, lambda x: (x.choice([None, 7, 8, 9, 1000, -1]),), n)


@pytest.mark.parametrize("seed", [1, 2])
def test_current_state(spark, rows, seed):
    log = log_rows(seed)
    df = spark.createDataFrame(log, SCHEMA)
    want = sorted((k[0], r[1]) for k, r in decide(log, 1).items() if not dead(r[2]))
    assert rows(current_state(df, ["id"], ["owner"])) == sorted(want, key=repr)
    got = rows(deciding_change(df, {"id": F.col("id")}, {}, arrived="arrived_at"), "id", "last_seq", "is_deleted", F.unix_micros("first_arrival"))
    want = [(k[0], r[-5], dead(r[2]), round((r[-1] - START).total_seconds() * 1e6) + 1704067200000000) for k, r in decide(log, 1).items()]
    assert got == sorted(want, key=repr)


def test_state_edge_cases(spark, rows):
    t = START
    log = [
        (1, 5, "c", None, 0, 0, t, t), (1, 6, "u", 1, 0, 0, None, t),  # a null sequence is the oldest
        (None, 1, "c", 1, 0, 0, t, None), (None, 2, "c", 2, 0, 0, t, t),  # a null key is a key
        (2, 1, "", 1, 0, 0, t, t), (3, 1, "  DROP", 1, 0, 0, t, t), (4, None, "c", 1, 0, 0, t, None),
    ]
    df = spark.createDataFrame(log, SCHEMA).withColumn("last_seq", F.lit("clash")).withColumn("is_deleted", F.lit(1)).withColumn("_c", F.lit(2))
    assert rows(current_state(df, ["id"], ["owner"])) == sorted([(1, 6), (None, 2), (2, 1), (4, None)], key=repr)
    assert rows(current_state(df.limit(0), ["id"], ["owner"])) == []


def brute_orphans(lists, users, gone):
    state, target = decide(lists, 1), decide(users, 1)
    seen = {}
    for r in users:
        if not dead(r[2]):
            seen[r[0]] = min(seen.get(r[0], r[-1]), r[-1])
    out = []
    for (key,), r in state.items():
        if dead(r[2]) or r[1] is None:
            continue
        t = target.get((r[1],))
        fault = "missing" if t is None else "deleted" if dead(t[2]) or gone(t[1]) else "late" if seen[r[1]] > r[-1] else None
        if fault:
            out.append(("lists", key, r[1], fault, r[-2].strftime("%Y-%m") if r[-2] else "unknown"))
    return out


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_orphans(spark, rows, zone):
    lists = log_rows(3, 400)
    users = random_log(rng(4), lambda x: (x.choice([7, 8, 9, 10]),), lambda x: (x.choice([1, 2, None]),), 12)
    users = [u[:-1] + (u[-1] + timedelta(days=30),) for u in users]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        tables = {"lists": spark.createDataFrame(lists, SCHEMA), "users": spark.createDataFrame(users, SCHEMA)}
        ref = [Reference("lists", ("id",), "id", "owner", "users", "id", "owner = 2")]
        found = orphan_references(tables, ref)
        want = brute_orphans(lists, users, lambda s: s == 2)
        assert rows(found, "tab", "rec_id", "ref_id", "fault", "period") == sorted(want, key=repr)
        assert {w[3] for w in want} >= {"missing", "deleted"}
        counted = Counter((w[0], w[4], w[3]) for w in want)
        assert rows(orphan_counts(found), "tab", "period", "fault", "n") == sorted(((*k, n) for k, n in counted.items()), key=repr)
        none = {"lists": tables["lists"], "users": tables["users"].limit(0)}
        assert {r.fault for r in orphan_references(none, ref).collect()} == {"missing"}
        assert rows(orphan_references({"lists": tables["lists"].limit(0), "users": tables["users"]}, ref)) == []
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_orphan_totals(spark, rows):
    """Counts aggregated before the lookup are those of the single references, also where a target comes in between."""
    lists = log_rows(3, 400)
    users = random_log(rng(4), lambda x: (x.choice([7, 8, 9, 10]),), lambda x: (x.choice([1, 2, None]),), 12)
    late = [u[:-1] + (u[-1] + timedelta(days=30),) for u in users]
    ref = [Reference("lists", ("id",), "id", "owner", "users", "id", "owner = 2")]
    for target in (users, late, []):
        tables = {"lists": spark.createDataFrame(lists, SCHEMA), "users": spark.createDataFrame(target, SCHEMA)}
        names = ("tab", "period", "fault", "n", "n_keys")
        got = rows(orphan_totals(tables, ref), *names)
        assert got == rows(orphan_counts(orphan_references(tables, ref)), *names) and got
        want = Counter((w[0], w[4], w[3]) for w in brute_orphans(lists, target, lambda s: s == 2))
        assert [g[:4] for g in got] == sorted(((*k, n) for k, n in want.items()), key=repr)
    assert rows(orphan_totals({"lists": tables["lists"].limit(0), "users": tables["users"]}, ref)) == []


@pytest.mark.parametrize("runs", [1, 3, 7])
def test_merge_table(spark, rows, runs):
    log = log_rows(5, 500)
    df = spark.createDataFrame(log, SCHEMA)
    table = from_log(df, ["id"], ["owner"], runs=runs)
    want = sorted(((k[0], r[-5], r[1]) for k, r in decide(log, 1).items() if not dead(r[2])), key=repr)
    assert rows(table.read(), "id", "change_seq", "owner") == want
    plan = table.merged()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort " not in plan and ("SortMergeJoin" in plan) == (len(table.runs) > 1), plan
    names = [t for t, _ in table.runs]
    table.close()
    assert not any(spark.catalog.tableExists(t) for t in names)


def test_merge_table_appends_and_compacts(spark, rows):
    log = log_rows(6, 300)
    table = LsmTable(spark, ["id"], ["owner"], buckets=4, max_runs=3)
    for i in range(6):
        table.append(spark.createDataFrame(log[i::6], SCHEMA))
        assert len(table.runs) <= 3
    table.append(spark.createDataFrame([], SCHEMA))
    table.append(spark.createDataFrame(log, SCHEMA))  # all once more
    want = sorted(((k[0], r[-5], r[1]) for k, r in decide(log, 1).items() if not dead(r[2])), key=repr)
    assert rows(table.read(), "id", "change_seq", "owner") == want


def test_late_changes_after_compaction(spark, rows):
    """A deleted key stays deleted when older changes or copies of it arrive after a compaction."""
    t = START
    log = [(1, 7, "c", 5, 0, 0, t, t), (2, 7, "c", 6, 0, 1, t, t), (1, 7, "delete", 10, 0, 2, t, t), (3, 7, None, 4, 0, 3, t, t)]
    late = [(1, 8, "u", 8, 0, 4, t, t), (1, 7, "c", 5, 0, 5, t, t), (3, 9, "c", 2, 0, 6, t, t), (3, 9, "c", 9, 0, 7, t, t)]
    table = LsmTable(spark, ["id"], ["owner"], buckets=2, max_runs=2)
    for part in (log[:2], log[2:3], log[3:]):
        table.append(spark.createDataFrame(part, SCHEMA))
    assert len(table.runs) == 1  # compacted
    assert rows(table.read(), "id", "change_seq", "owner") == [(2, 6, 7)]
    table.append(spark.createDataFrame(late, SCHEMA))
    assert rows(table.read(), "id", "change_seq", "owner") == [(2, 6, 7), (3, 9, 9)]
    table.compact()
    assert rows(table.read(), "id", "change_seq", "owner") == [(2, 6, 7), (3, 9, 9)]


def test_batches_by_arrival_are_compacted(spark, rows):
    log = log_rows(9, 400, nulls=True)
    table = from_log(spark.createDataFrame(log, SCHEMA), ["id"], ["owner"], runs=8, max_runs=3)
    assert table.written > 8 and len(table.runs) <= 3
    want = sorted(((k[0], r[-5], r[1]) for k, r in decide(log, 1).items() if not dead(r[2])), key=repr)
    assert rows(table.read(), "id", "change_seq", "owner") == want


def test_merge_table_edges(spark, rows):
    empty = spark.createDataFrame([], SCHEMA)
    assert rows(from_log(empty, ["id"]).read()) == []
    with pytest.raises(ValueError):
        LsmTable(spark, ["id"], ["change_seq"])
    with pytest.raises(ValueError):
        LsmTable(spark, ["id"]).read()


def test_key_counts_and_eager_join(spark, rows):
    r = rng(8)
    a = [(r.choice([None, 1, 1, 1, 2, 3]), r.choice("xy"), r.choice([None, 1, 2])) for _ in range(200)]
    b = [(r.choice([None, 1, 2, 4]), r.choice("pq"), r.randrange(5)) for _ in range(150)]
    left, right = spark.createDataFrame(a, "k int, g string, v int"), spark.createDataFrame(b, "k int, h string, w int")
    got = eager_join_aggregate(left, right, ["k"], ["g"], ["h"], {"sv": F.col("v").cast("long")}, {"sw": F.col("w").cast("long")})
    want = {}
    for k, g, v in a:
        for k2, h, w in b:
            if k is not None and k == k2:
                x = want.setdefault((g, h), [0, None, 0])
                x[0] += 1
                x[1] = x[1] if v is None else (x[1] or 0) + v
                x[2] += w
    assert {(r.g, r.h): [int(r.n_pairs), r.sv, r.sw] for r in got.collect()} == want
    assert rows(eager_join_aggregate(left.limit(0), right, ["k"], ["g"])) == []
    with pytest.raises(ValueError):
        eager_join_aggregate(left, left, ["k"], ["g"], ["g"])
    counts = Counter((g, k) for k, g, _ in a if k is not None)
    totals = Counter(g for k, g, _ in a if k is not None)
    assert rows(key_counts(left, "g", "k"), "g", "k", "n", "total") == sorted((g, k, n, totals[g]) for (g, k), n in counts.items())


@pytest.mark.parametrize("few,spread", [(10_000, 10), (0, 10), (0, 1_000_000)])
def test_eager_join_of_wide_groups(spark, rows, monkeypatch, few, spread):
    """One key with many groups on both sides, broadcast, divided or joined as it is."""
    monkeypatch.setattr(skew, "FEW", few)
    monkeypatch.setattr(skew, "SPREAD", spread)
    a = [(1 if i % 3 else i, i % 17) for i in range(200)]
    b = [(1 if i % 2 else i, i % 13) for i in range(150)]
    left, right = spark.createDataFrame(a, "k int, g int"), spark.createDataFrame(b, "k int, h int")
    want = Counter((g, h) for k, g in a for k2, h in b if k == k2)
    got = eager_join_aggregate(left, right, ["k"], ["g"], ["h"])
    assert {(r.g, r.h): int(r.n_pairs) for r in got.collect()} == want


def test_skewed_lookup(spark, rows):
    facts = spark.createDataFrame([(1, i) for i in range(90)] + [(i, i) for i in range(2, 12)] + [(None, 0)], "k int, v int")
    dim = spark.createDataFrame([(1, "a"), (3, "c"), (None, "n")], "k int, name string")
    heavy = heavy_keys(facts, "k", parts=10)
    assert rows(heavy) == [(1, 90)]
    got = rows(lookup(facts, dim, "k", heavy), "k", "v", "name")
    assert got == rows(facts.join(dim, "k", "left"), "k", "v", "name")
    assert rows(lookup(facts, dim, "k", heavy.limit(0)), "k", "v", "name") == got
    assert rows(lookup(facts, dim, "k", heavy, how="inner"), "k", "v", "name") == [g for g in got if g[2]]
