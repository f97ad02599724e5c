"""Scalar functions of the domain, all native column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "2018-09-20"


def day_index(day: Column, epoch: str = EPOCH) -> Column:
    """Days since the epoch, int: frames by value need an integer order key."""
    return F.datediff(day, F.lit(epoch).cast("date")).cast("int")


def hash_bucket(key: Column) -> Column:
    """A uniform 32-bit integer of a key, the same in any engine with MD5."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long")


def hash_uniform(key: Column) -> Column:
    return hash_bucket(key) / F.lit(4294967296.0)


def recency_weight(age: Column, half_life: float = 30.0) -> Column:
    return F.pow(F.lit(0.5), age / F.lit(half_life))


def logq(score: Column, q: Column) -> Column:
    """Sampling-bias correction of an in-batch softmax score."""
    return score - F.log(q)


def elkan(p_s: Column, w) -> Column:
    """Probability before negatives were kept at rate w."""
    return p_s / (p_s + (1 - p_s) / F.lit(w))


def price_response(p0: Column, discount: Column, elasticity: float) -> Column:
    """Purchase probability at a discount, at most 1."""
    return F.least(F.lit(1.0), p0 * F.pow(1 - discount, F.lit(elasticity)))


def age_bucket(age: Column, edges=(20, 30, 40, 50, 60)) -> Column:
    """Number of edges at or below the age; null stays null."""
    return F.when(age.isNotNull(), reduce(lambda a, e: a + F.when(age >= e, 1).otherwise(0), edges, F.lit(0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def safe_ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0))
