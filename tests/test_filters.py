import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestwork.operators.filters import DELETE, SKIP, UPDATE, Filter, is_equal, mode_counts, skip_unchanged, with_modes
from nestwork.operators.latest import as_changes, before_images, last_changes, latest

V = T.StructType().add("id", "integer").add("a", "string").add("b", "integer")


def made(spark, rows):
    return spark.createDataFrame([(bytearray(str(k).encode()), s, v) for k, s, v in rows], T.StructType().add("pk", "binary").add("seq", "long").add("value", V)).withColumn("key", F.struct("pk"))


@pytest.mark.parametrize(
    "a,b,ignored,want",
    [
        (None, None, [], True), ((1, "x", 2), None, [], False), (None, (1, "x", 2), [], False), ((1, "x", 2), (1, "x", 2), [], True),
        ((1, "x", None), (1, "x", None), [], True), ((1, "x", None), (1, "x", 3), [], False), ((1, "x", 2), (1, "y", 3), ["a", "b"], True),
    ],
)
def test_is_equal(spark, a, b, ignored, want):
    df = spark.createDataFrame([(a, b)], T.StructType().add("a", V).add("b", V))
    assert df.select(is_equal(F.col("a"), F.col("b"), V, ignored)).first()[0] is want


def test_modes_and_latest(spark, rows):
    log = [(1, 1, (1, "x", 1)), (1, 2, None), (2, 1, (2, "skip", 1)), (3, 1, (3, "x", 1)), (3, 2, (3, "skip", 9)), (4, 1, (4, "x", 1)), (4, 2, (4, "gone", 1)), (5, 1, (5, None, 1))]
    df = made(spark, log)
    rule = Filter(lambda entity, new, old: F.when(new["a"] == "skip", SKIP).when(new["a"] == "gone", DELETE))
    assert rows(mode_counts(with_modes(df, "e", rule))) == [(DELETE, 2), (SKIP, 2), (UPDATE, 4)]
    assert rows(latest(df, "e", rule), "value.id", "value.a") == [(3, "x"), (5, None)]
    assert rows(last_changes(df, "e", rule), "seq", F.col("value").isNull()) == [(1, False), (1, False), (2, True), (2, True)]
    assert rows(latest(df.limit(0))) == []


def test_skip_unchanged_across_batches(spark, rows):
    old = made(spark, [(1, 0, (1, "x", 1))]).select("pk", "value")
    df = made(spark, [(1, 1, (1, "x", 1)), (1, 2, (1, "y", 1)), (1, 3, (1, "y", 1)), (1, 4, None), (1, 5, (1, "y", 1)), (2, 1, (2, "x", 1))])
    got = rows(with_modes(df, "e", skip_unchanged(V), old=old), "seq", "mode")
    assert got == sorted([(1, SKIP), (1, UPDATE), (2, UPDATE), (3, SKIP), (4, DELETE), (5, UPDATE)])
    assert rows(with_modes(df, "e", skip_unchanged(V, ["a"]), old=old).filter("seq = 2"), "mode") == [(SKIP,)]


def test_as_changes_and_images(spark, rows):
    df = spark.createDataFrame([(1, "x", 5, False), (2, "y", 6, True), (3, "z", 7, None)], "id long, a string, n long, gone boolean")
    c = as_changes(df, ["id"], F.col("n"), F.col("gone"), drop=["n", "gone"])
    assert rows(c, F.hex("pk"), "seq", "key.id", "value.a") == [("01", 5, 1, "x"), ("02", 6, 2, None), ("03", 7, 3, "z")]
    state = c.filter("seq = 5").select("pk", "value")
    assert rows(before_images(c, state), F.hex("pk"), "old.a", "new.a") == [("01", "x", "x"), ("02", None, None), ("03", None, "z")]


def test_fold_sees_the_last_kept_version(spark, rows):
    """A counter that may only rise: smaller values are skipped, 99 deletes."""

    def rising(entity, new, old):
        return DELETE if new["b"] == 99 else SKIP if old and new["b"] <= old["b"] else UPDATE

    old = made(spark, [(1, 0, (1, "x", 3)), (9, 0, (9, "x", 3))]).select("pk", "value")
    df = made(spark, [(1, 1, (1, "x", 2)), (1, 2, (1, "x", 5)), (1, 3, (1, "x", 4)), (1, 4, (1, "x", 99)), (1, 5, (1, "x", 1)), (2, 1, (2, "x", 0)), (2, 2, None)])
    got = rows(with_modes(df, "e", Filter(fold=rising), old=old), F.decode("pk", "UTF-8"), "seq", "mode")
    assert got == [("1", 1, SKIP), ("1", 2, UPDATE), ("1", 3, SKIP), ("1", 4, DELETE), ("1", 5, UPDATE), ("2", 1, UPDATE), ("2", 2, DELETE)]
    assert rows(latest(df, "e", Filter(fold=rising)), "value.id", "value.b") == [(1, 1)]


def test_rules_get_the_last_kept_version(spark, rows):
    """As an expression: held against the last kept version, not the one before; also with copies of a change."""
    rule = Filter(lambda entity, new, old: F.when(new["b"] == 99, DELETE).when(new["b"] <= old["b"], SKIP), uses_old=True)
    df = made(spark, [(1, i, (1, "x", b)) for i, b in enumerate([1, 5, 3, 4, 99, 2, 9, 3, 4, 5, 6, 10])] + [(2, 1, (2, "x", 7)), (2, 1, (2, "x", 7)), (3, 0, None)])
    got = rows(with_modes(df, "e", rule).filter(F.decode("pk", "UTF-8") == "1"), "seq", "mode")
    want = [UPDATE, UPDATE, SKIP, SKIP, DELETE, UPDATE, UPDATE, SKIP, SKIP, SKIP, SKIP, UPDATE]
    assert sorted(got) == list(enumerate(want))
    assert sorted(r.mode for r in with_modes(df, "e", rule).filter(F.decode("pk", "UTF-8") == "2").collect()) == [SKIP, UPDATE]
    old = made(spark, [(1, 0, (1, "x", 4)), (2, 0, (2, "x", 8))]).select("pk", "value")
    got = rows(with_modes(df, "e", rule, old=old).filter("seq < 3"), F.decode("pk", "UTF-8"), "seq", "mode")
    assert got == sorted([("1", 0, SKIP), ("1", 1, UPDATE), ("1", 2, SKIP), ("2", 1, SKIP), ("2", 1, SKIP), ("3", 0, DELETE)])
    assert rows(with_modes(df.limit(0), "e", rule)) == []
