"""Vectors as whole numbers: what the operators on embeddings share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec: Column) -> Column:
    """Vectors that are there and hold neither null nor a number that is not finite."""
    x = vec.cast("array<double>")
    return F.coalesce(vec.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def whole(df: DataFrame, ident: str, vec: str, scale: int, shift: int, limit: int) -> DataFrame:
    """(id, v): each entry c as floor(scale * c) + shift, in doubles; unusable rows and rows with an entry of ``limit`` or more are left out.

    The limit keeps sums of products within 64 bits: what lies beyond has no exact result.
    """
    floored = F.transform(F.col(f"`{vec}`").cast("array<double>"), lambda c: F.floor(F.when(F.abs(c) * scale < limit, c) * scale) + F.lit(shift))
    rows = df.where(usable(F.col(f"`{vec}`"))).select(F.col(f"`{ident}`").cast("long").alias("id"), floored.alias("v"))
    return rows.where(F.forall("v", lambda c: c.isNotNull()))


def padded(v: Column, width: int) -> Column:
    """A shorter vector counts as ending in zeros."""
    return F.concat(v, F.array_repeat(F.lit(0).cast("int"), F.lit(width) - F.size(v)))
