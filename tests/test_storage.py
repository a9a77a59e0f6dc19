import os

import pytest
from pyspark.sql import functions as F

from nestwork import storage


def folders(spark):
    return set(os.listdir(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")))


def test_small_tables_stay_with_the_plan(spark, monkeypatch):
    monkeypatch.setattr(storage, "LOCAL_ROWS", 10)
    before = folders(spark)
    nested = F.struct(F.col("id"), F.array(F.lit("x"), F.lit(None)).alias("a"), F.timestamp_seconds("id").alias("t")).alias("s")
    for n in (0, 10):
        df = spark.range(n).select("id", nested, F.encode(F.col("id").cast("string"), "UTF-8").alias("b"))
        got = storage.kept(df, "small")
        assert storage.is_local(got) and got.schema == df.schema and sorted(got.collect()) == sorted(df.collect())
    assert folders(spark) == before
    got = storage.kept(spark.range(11), "large")
    assert not storage.is_local(got) and got.count() == 11 and len(folders(spark) - before) == 1
    assert not storage.is_local(storage.kept(spark.range(1), "known", small=False))


def test_scratch_is_removed(spark):
    outer = storage.materialize(spark.range(3), "outer")
    before = folders(spark)
    with pytest.raises(KeyError), storage.scratch(spark):
        assert storage.materialize(spark.range(5), "inner").count() == 5
        assert folders(spark) > before
        raise KeyError
    assert folders(spark) == before and outer.count() == 3


def test_side_by_side(spark):
    assert storage.side_by_side(lambda n=n: spark.range(n).count() for n in range(6)) == list(range(6))
    with pytest.raises(ZeroDivisionError):
        storage.side_by_side([lambda: 1, lambda: 1 / 0])
