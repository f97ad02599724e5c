"""Joins whose physical strategy depends on sizes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes up to which a side may be sent to every task.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def _width(column: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes in memory."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(column) + 8
    elif isinstance(kind, T.ArrayType):
        one = kind.elementType
        size = F.size(column) * 8 if not isinstance(one, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)) else F.aggregate(column, F.lit(0).cast("long"), lambda n, x: n + _width(x, one).cast("long"))
    elif isinstance(kind, T.MapType):
        size = _width(F.map_keys(column), T.ArrayType(kind.keyType)) + _width(F.map_values(column), T.ArrayType(kind.valueType))
    elif isinstance(kind, T.StructType):
        size = reduce(lambda a, f: a + _width(column[f.name], f.dataType), kind, F.lit(8))
    else:
        size = F.lit(16)
    return F.coalesce(size, F.lit(8)).cast("long")


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it has at most so many rows and bytes, else as it is: the join then shuffles both sides.

    Measured by a job over at most ``rows`` + 1 rows.
    """
    width = reduce(lambda a, f: a + _width(F.col(f"`{f.name}`"), f.dataType), df.schema, F.lit(16).cast("long"))
    n, total = df.select(width.alias("w")).limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum("w"), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= size else df


def salted_join(big: DataFrame, small: DataFrame, key: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """Equi join with every key of the big side dealt over ``salts`` tasks; the small side is repeated as often.

    The salt follows from the row and from the part of the input that holds it, so that equal
    rows of a key do not meet in one task either. For keys so hot that one task would hold
    most of the big side, where the other side is too large to broadcast. ``how`` is inner
    or left.
    """
    if how not in ("inner", "left"):
        raise ValueError("a repeated side cannot keep its own unmatched rows")
    order = F.pmod(F.xxhash64(F.spark_partition_id(), *(F.col(c) for c in big.columns)), F.lit(salts))
    left = big.withColumn("__salt", order.cast("int"))
    right = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "__salt"], how).drop("__salt")
