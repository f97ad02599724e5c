"""The driver's star schema read as the retail model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Money is decimal end to end: sums do not depend on the order of rows.
MONEY = "decimal(12,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t_dat, customer_id, article_id, price, sales_channel_id) of ordered parts; has no key."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("customer_id"), F.to_date("o_orderdate").alias("t_dat"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("article_id"), F.col("l_extendedprice").cast(MONEY).alias("price"), (F.col("l_linenumber") % 2 + 1).alias("sales_channel_id"))
    return lines.join(orders, "o_orderkey").select("t_dat", "customer_id", "article_id", "price", "sales_channel_id")


def event_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same model over events: many rows of one customer, article and day."""
    return table(spark, sf_dir, "events").select(F.to_date("ts").alias("t_dat"), F.col("user_id").alias("customer_id"), F.col("event_type").alias("article_id"), F.col("value").cast(MONEY).alias("price"), F.lit(1).alias("sales_channel_id"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("article_id"), F.col("p_type").alias("product_type"), F.col("p_name").alias("prod_name"), F.col("p_brand").alias("brand"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
