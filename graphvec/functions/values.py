"""Property values: kinds, literals and the columns that hold them.

A value is a string, 64-bit integer, boolean, byte string, double or float vector; a missing key is the only null. Values of different
kinds are never equal or ordered. NaN and vectors can be stored but match no filter.

``BAG`` is the lossless form of a property map: each value is a struct with its kind and one field of that kind.
"""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRING, INT, BOOL, BYTES, FLOAT, VECTOR = range(6)
#: Field of the bag and SQL type of each kind.
FIELDS = {STRING: ("s", "string"), INT: ("i", "bigint"), BOOL: ("b", "boolean"), BYTES: ("y", "binary"), FLOAT: ("f", "double"), VECTOR: ("v", "array<float>")}
VALUE = "struct<k:tinyint," + ",".join(f"{n}:{t}" for n, t in FIELDS.values()) + ">"
BAG = f"map<string,{VALUE}>"

Value = str | int | bool | bytes | float | list


def kind_of(value: Any) -> int:
    """Kind of a Python value; booleans before integers."""
    if isinstance(value, bool):
        return BOOL
    if isinstance(value, int):
        if not -(1 << 63) <= value < 1 << 63:
            raise ValueError(f"integer beyond 64 bits: {value}")
        return INT
    if isinstance(value, float):
        return FLOAT
    if isinstance(value, str):
        return STRING
    if isinstance(value, (bytes, bytearray)):
        return BYTES
    if isinstance(value, (list, tuple)) or type(value).__name__ == "ndarray":
        return VECTOR
    raise TypeError(f"no property value: {type(value).__name__}")


def kind_of_type(t: T.DataType) -> int:
    """Kind that a column of a label view holds."""
    if isinstance(t, (T.StringType, T.VarcharType, T.CharType)):
        return STRING
    if isinstance(t, T.LongType):
        return INT
    if isinstance(t, T.BooleanType):
        return BOOL
    if isinstance(t, T.BinaryType):
        return BYTES
    if isinstance(t, T.DoubleType):
        return FLOAT
    if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.FloatType):
        return VECTOR
    raise TypeError(f"not a property type: {t.simpleString()}")


def canonical(value: Any) -> Any:
    """The stored form: vectors as lists of floats, byte arrays as bytes."""
    k = kind_of(value)
    if k == VECTOR:
        return [float(x) for x in value]
    return bytes(value) if k == BYTES else value


def indexable(value: Any) -> bool:
    """Whether filters and unique constraints see the value."""
    k = kind_of(value)
    return k != VECTOR and not (k == FLOAT and math.isnan(value))


def index_key(value: Any) -> tuple | None:
    """(kind, value) that equality compares; -0.0 equals 0.0."""
    if not indexable(value):
        return None
    k = kind_of(value)
    return (k, 0.0 if k == FLOAT and value == 0 else bytes(value) if k == BYTES else value)


def literal(value: Any) -> Column:
    k = kind_of(value)
    if k == VECTOR:
        return F.array(*(F.lit(float(x)).cast("float") for x in value)).cast("array<float>")
    if k == BYTES:
        return F.lit(bytearray(value))
    return F.lit(value).cast(FIELDS[k][1])


def bag_value(value: Any) -> dict:
    """Row form of a value for a ``BAG`` column."""
    k = kind_of(value)
    return {"k": k, **{n: (canonical(value) if kind == k else None) for kind, (n, _) in FIELDS.items()}}


def from_bag(row: Any) -> Any:
    return canonical(row[FIELDS[row["k"]][0]])


def conform(column: Column, t: T.DataType) -> Column:
    """A table's column as a property: narrow integers widen, timestamps become microseconds, other numbers doubles."""
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
        return column.cast("bigint")
    if isinstance(t, (T.FloatType, T.DecimalType)):
        return column.cast("double")
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(column.cast("timestamp"))
    if isinstance(t, T.DateType):
        return F.unix_micros(column.cast("timestamp"))
    if isinstance(t, T.ArrayType) and isinstance(t.elementType, (T.FloatType, T.DoubleType)):
        return column.cast("array<float>")
    kind_of_type(t)
    return column
