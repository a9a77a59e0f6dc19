"""Canonical byte encoding of keys.

Equality of keys and the order of children both follow these bytes (unsigned, lexicographic):

* null stays null; an empty struct is empty bytes, which no index holds;
* integers of any width: big-endian without leading zero bytes, zero is one ``00`` byte, negatives
  take eight bytes;
* strings: UTF-8; booleans: ``01`` / ``00``; binary: as it is;
* a struct of one field: that field; of several: the fields in order of their names, each with one
  byte of length before it, a null field as length 0.

Other types (floating point, decimals, dates, arrays, maps) are no keys and raise TypeError when the
plan is built. A field of a composite key that is longer than 255 bytes raises when the query runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def encode_key(col: Column, dtype: T.DataType) -> Column:
    """``col`` of type ``dtype`` as canonical bytes."""
    if isinstance(dtype, INTEGRAL):
        return F.unhex(F.hex(col.cast("bigint")))
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return F.encode(col, "UTF-8")
    if isinstance(dtype, T.BooleanType):
        return F.when(col, F.lit(bytearray(b"\x01"))).when(~col, F.lit(bytearray(b"\x00")))
    if isinstance(dtype, T.BinaryType):
        return col
    if isinstance(dtype, T.StructType):
        encoded = encode_composite([(f.name, col[f.name], f.dataType) for f in dtype.fields])
        return F.when(col.isNotNull(), encoded)
    raise TypeError(f"{dtype.simpleString()} cannot be a key")


def encode_composite(fields: Sequence[tuple[str, Column, T.DataType]]) -> Column:
    """Several named fields as one key; one field is itself, none is empty bytes."""
    if not fields:
        return F.lit(bytearray())
    if len(fields) == 1:
        return encode_key(fields[0][1], fields[0][2])
    parts = []
    for _, col, dtype in sorted(fields, key=lambda f: f[0]):
        data = F.coalesce(encode_key(col, dtype), F.lit(bytearray()))
        size = F.length(data)
        if not isinstance(dtype, (*INTEGRAL, T.BooleanType)):
            long = F.raise_error(F.lit("a field of a composite key is longer than 255 bytes")).cast("int")
            size = F.when(size <= 255, size).otherwise(long)
        parts += [F.unhex(F.hex(size)), data]  # up to 255 this is one byte
    return F.concat(*parts)


def encode_columns(df: DataFrame, names: Sequence[str]) -> Column:
    """The key made of the named columns of ``df``; null if a single one is null."""
    return encode_composite([(n, F.col(n), df.schema[n].dataType) for n in names])
