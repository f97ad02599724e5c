"""Keyed merges, reconciliation and multiset comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class CardinalityError(ValueError):
    pass


def upsert(target: DataFrame, source: DataFrame, key: str, delete_missing: Column | None = None) -> DataFrame:
    """Matched rows take the source's columns, unmatched source rows are inserted, columns by name.

    Null keys match nothing and are inserted. Two source rows for one target row are an
    error. With ``delete_missing``, target rows that it selects and no source row matches go.
    """
    if set(target.columns) != set(source.columns):
        raise ValueError("source and target need the same columns")
    repeated = source.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key)
    if not repeated.join(target.select(key), key, "left_semi").limit(1).isEmpty():
        raise CardinalityError(f"several source rows match one target row on {key}")
    kept = target.join(source.select(key), key, "left_anti").select(*target.columns)
    if delete_missing is not None:
        kept = kept.where(~F.coalesce(delete_missing, F.lit(False)))
    return kept.unionByName(source.select(*target.columns))


def insert_new_batches(target: DataFrame, batches: DataFrame, batch_col: str) -> DataFrame:
    """Target plus the rows of batches that it has no row of."""
    landed = target.select(batch_col).distinct()
    return target.unionByName(batches.join(landed, batch_col, "left_anti").select(*target.columns))


def overwrite_days(target: DataFrame, batch: DataFrame, day: str) -> DataFrame:
    """Every day that the batch has rows for, replaced whole."""
    days = batch.select(day).distinct()
    return target.join(days, day, "left_anti").select(*target.columns).unionByName(batch.select(*target.columns))


def multiset_diff(a: DataFrame, b: DataFrame, ignore_cols=("_ingested_at",)) -> DataFrame:
    """Rows of either side beyond the other's, with a column ``side``; unknown ignored names do nothing."""
    a, b = a.drop(*ignore_cols), b.drop(*ignore_cols)
    if a.dtypes != b.dtypes:
        raise ValueError(f"schemas differ: {a.dtypes} and {b.dtypes}")
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def business_columns(df: DataFrame) -> list[str]:
    """The columns that are not pipeline metadata: those without a leading underscore."""
    return [c for c in df.columns if not c.startswith("_")]


def row_set_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has, with a column ``side``: whether rows exist, whatever their values and copies."""
    a, b = a.select(*keys).distinct(), b.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("a")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("b")))


def assert_identical(a: DataFrame, b: DataFrame, ignore_cols=("_ingested_at",)) -> None:
    """Raises unless both frames hold the same rows as often, metadata columns aside."""
    counts = {r["side"]: r["count"] for r in multiset_diff(a, b, ignore_cols).groupBy("side").count().collect()}
    if counts:
        raise AssertionError(f"frames differ: {counts.get('a', 0)} rows only in a, {counts.get('b', 0)} only in b")


def assert_identical_between(a: DataFrame, b: DataFrame, day: str, start, end, ignore_cols=("_ingested_at",)) -> None:
    """Total counts over everything, rows over the days that changed: a diff without shuffling the rest."""
    if a.count() != b.count():
        raise AssertionError("row counts differ")
    window = F.col(day).between(F.lit(start), F.lit(end))
    assert_identical(a.where(window), b.where(window), ignore_cols)
