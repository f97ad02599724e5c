"""The fact table, its grain study and data tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.operators.quantile import exact_quantiles

GRAIN = ["customer_id", "article_id", "t_dat", "sales_channel_id"]


def money(total) -> "F.Column":
    """An exact decimal sum as double, once at the end."""
    return total.cast("double")


def fact_transaction(tx: DataFrame, grain=GRAIN) -> DataFrame:
    """One row per grain: quantity, exact revenue, price range, latest arrival where known."""
    extra = [F.max("_ingested_at").alias("_ingested_at")] if "_ingested_at" in tx.columns else []
    total = F.sum("price")
    return tx.groupBy(*grain).agg(F.count("*").alias("qty"), money(total).alias("revenue"), (money(total) / F.count("price")).alias("price_avg"), F.min("price").cast("double").alias("price_min"), F.max("price").cast("double").alias("price_max"), *extra)


def grain_profile(tx: DataFrame, grain) -> DataFrame:
    """Groups, shares of groups with several rows or prices, largest group, collapsed share of rows."""
    groups = tx.groupBy(*grain).agg(F.count("*").alias("n"), F.countDistinct("price").alias("prices"))
    return groups.agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_rows"), F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("n_multi_row"), F.sum(F.when(F.col("prices") > 1, 1).otherwise(0)).alias("n_multi_price"), F.max("n").alias("max_group"), F.round(1 - F.count("*") / F.sum("n"), 8).alias("collapsed_share"))


def price_spread(tx: DataFrame, grain) -> DataFrame:
    """Exact quantiles of (max - min) / max over groups with several prices, by range counting."""
    groups = tx.groupBy(*grain).agg(F.min("price").cast("double").alias("lo"), F.max("price").cast("double").alias("hi")).where("hi > lo")
    spread = (F.col("hi") - F.col("lo")) / F.col("hi")
    return exact_quantiles(groups.select(spread.alias("s")), [], "s", {"p50": 0.5, "p90": 0.9, "p100": 1.0}, 8)


def check_unique(df: DataFrame, keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def check_not_null(df: DataFrame, columns) -> DataFrame:
    """One row per column: rows and nulls; a single scan."""
    counts = df.agg(F.count("*").alias("n_rows"), *(F.sum(F.col(c).isNull().cast("long")).alias(c) for c in columns))
    return counts.select("n_rows", F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(c), F.lit(0)).alias("n_null")) for c in columns))).alias("x")).select("x.column_name", "n_rows", "x.n_null")


def check_accepted(df: DataFrame, column: str, values) -> DataFrame:
    """Values outside the accepted ones with their counts; nulls pass."""
    return df.where(~F.col(column).isin(*values)).groupBy(column).agg(F.count("*").alias("n"))


def check_relationship(fact: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Fact keys without a dimension row, with their counts."""
    return fact.join(dim.select(key), key, "left_anti").groupBy(key).agg(F.count("*").alias("n"))


def cold_start(dim: DataFrame, fact: DataFrame, key: str) -> DataFrame:
    return dim.select(key).join(fact.select(key), key, "left_anti")


def check_daily_counts(df: DataFrame, day: str, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """Days whose row count is outside [low, high] times the mean of all days."""
    days = df.groupBy(day).agg(F.count("*").alias("n"))
    mean = days.agg(F.avg("n").alias("mean"))
    return days.join(F.broadcast(mean)).where((F.col("n") < low * F.col("mean")) | (F.col("n") > high * F.col("mean"))).select(day, "n")


def check_units(df: DataFrame, threshold: int, grain=("customer_id", "article_id", "t_dat")) -> DataFrame:
    return df.groupBy(*grain).agg(F.count("*").alias("units")).where(F.col("units") >= threshold)


def treat_outliers(df: DataFrame, column: str, cap, how: str = "cap") -> DataFrame:
    if how == "keep":
        return df
    if how == "exclude":
        return df.where(F.col(column).isNull() | (F.col(column) <= cap))
    return df.withColumn(column, F.when(F.col(column) > cap, F.lit(cap)).otherwise(F.col(column)))


def freshness(df: DataFrame, column: str, now) -> DataFrame:
    """Latest value and its age in days at ``now``."""
    return df.agg(F.max(column).alias("latest")).select(F.to_date("latest").alias("latest"), F.datediff(F.lit(now).cast("date"), F.to_date("latest")).alias("age_days"))


def drift_psi(a: DataFrame, b: DataFrame, column: str, width: float) -> DataFrame:
    """Population stability index of two frames over buckets of equal width."""
    part = lambda df, name: df.groupBy(F.floor(F.col(column) / width).alias("bucket")).agg(F.count("*").alias(name))
    both = part(a, "na").join(part(b, "nb"), "bucket", "full").select(F.coalesce("na", F.lit(0)).alias("na"), F.coalesce("nb", F.lit(0)).alias("nb"))
    total = both.agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"), F.count("*").alias("k"))
    p, q = (F.col("na") + 0.5) / (F.col("ta") + 0.5 * F.col("k")), (F.col("nb") + 0.5) / (F.col("tb") + 0.5 * F.col("k"))
    return both.join(F.broadcast(total)).agg(F.round(F.sum((p - q) * F.log(p / q)), 6).alias("psi"), F.count("*").alias("n_buckets"))
