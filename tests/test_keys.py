import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestwork.functions import keysets
from nestwork.functions.keys import encode_columns, encode_key


def hexed(spark, schema, row, names=None):
    df = spark.createDataFrame([row], schema)
    return df.select(F.hex(encode_columns(df, names or df.columns))).first()[0]


@pytest.mark.parametrize(
    "schema,row,want",
    [
        ("a int", (1234,), "04D2"),
        ("a long", (1234,), "04D2"),
        ("a long", (0,), "00"),
        ("a long", (256,), "0100"),
        ("a short", (2,), "02"),
        ("a long", (-1,), "FF" * 8),
        ("a int", (-1,), "FF" * 8),
        ("a boolean", (True,), "01"),
        ("a boolean", (False,), "00"),
        ("a string", ("ä",), "C3A4"),
        ("a string", ("",), ""),
        ("a long", (None,), None),
        ("a boolean", (None,), None),
        ("name string, count int", ("GREY LIGHTHOUSE", 45), "012D0F47524559204C49474854484F555345"),
        ("a string, b int, c boolean", ("A", 1234, False), "01410204D20100"),
        ("b int, a int", (None, 1), "010100"),
    ],
)
def test_vectors(spark, schema, row, want):
    assert hexed(spark, schema, row) == want


def test_prefixes_keep_fields_apart(spark):
    assert hexed(spark, "a string, b string", ("12", "3")) != hexed(spark, "a string, b string", ("1", "23"))


def test_struct_key_is_its_fields(spark):
    df = spark.createDataFrame([((1, 2),), (None,)], "k struct<y: int, x: int>")
    got = [r[0] for r in df.select(F.hex(encode_key(F.col("k"), df.schema["k"].dataType))).collect()]
    assert got == ["01020101", None]


def test_no_fields_is_empty(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert df.select(F.length(encode_columns(df, []))).first()[0] == 0


@pytest.mark.parametrize("t", [T.DoubleType(), T.DecimalType(5, 0), T.DateType(), T.ArrayType(T.LongType())])
def test_other_types_are_refused(t):
    with pytest.raises(TypeError):
        encode_key(None, t)


def test_long_fields_of_composites_raise(spark):
    assert len(hexed(spark, "a string, b int", ("x" * 255, 1))) == 2 * (255 + 1 + 2)
    with pytest.raises(Exception, match="255"):
        hexed(spark, "a string, b int", ("x" * 256, 1))


def test_order_is_bytewise(spark):
    df = spark.createDataFrame([(256,), (2,), (0,), (65536,)], "a long")
    assert [r.a for r in df.orderBy(encode_columns(df, ["a"])).collect()] == [0, 256, 65536, 2]  # 00, 0100, 010000, 02


def test_key_sets(spark):
    df = spark.createDataFrame([([b"b", b"", None, b"a", b"b"], [b"b", b"c"])], "a array<binary>, b array<binary>")
    a, b = keysets.make(F.col("a")), keysets.make(F.col("b"))
    got = df.select(
        a.alias("a"), keysets.union(a, b).alias("u"), keysets.minus(a, b).alias("m"), keysets.intersect(a, b).alias("i"),
        keysets.contains(a, F.lit(bytearray(b"a"))).alias("has"), keysets.contains(a, F.lit(bytearray(b"z"))).alias("not"),
        keysets.contains_all(keysets.union(a, b), b).alias("all"), keysets.size(a).alias("n"),
        keysets.changed(a, keysets.add(a, F.lit(bytearray(b"a")))).alias("same"), keysets.is_empty(keysets.make(F.lit(None).cast("array<binary>"))).alias("none"),
    ).first()
    assert [bytes(x) for x in got.a] == [b"a", b"b"]
    assert [bytes(x) for x in got.u] == [b"a", b"b", b"c"]
    assert [bytes(x) for x in got.m] == [b"a"] and [bytes(x) for x in got.i] == [b"b"]
    assert (got.has, got["not"], got.all, got.n, got.same, got.none) == (True, False, True, 2, False, True)


def test_key_rows(spark, rows):
    a = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    b = spark.createDataFrame([(2,), (3,)], "k int")
    assert rows(keysets.rows_union(a, b)) == [(1,), (2,), (3,)]
    assert rows(keysets.rows_minus(a, b)) == [(1,)]
    assert rows(keysets.rows_intersect(a, b)) == [(2,)]
