"""Staging views over the raw tables, and the marts built from them in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallgrass.sources.snapshots import SnapshotTable
from tallgrass.sources.warehouse import Warehouse

#: Renaming and casting only; money becomes decimal here.
STAGING = {
    "stg_transactions": ("transactions", "SELECT t_dat, customer_id, article_id, CAST(price AS DECIMAL(12,6)) AS price, sales_channel_id, _ingested_at, _source_file FROM {source}"),
    "stg_customers": ("customers", "SELECT customer_id, CAST(FN AS BOOLEAN) AS gets_news, CAST(Active AS BOOLEAN) AS is_active, club_member_status, fashion_news_frequency, age, postal_code FROM {source}"),
    "stg_articles": ("articles", "SELECT article_id, prod_name, product_type_no, product_type_name AS product_type, product_group_name AS product_group, colour_group_name AS colour, department_name AS department, section_name AS section, garment_group_name AS garment_group FROM {source}"),
}
MARTS = {
    "fact_transaction": "SELECT customer_id, article_id, t_dat, sales_channel_id, count(*) AS qty, sum(price) AS revenue, min(price) AS price_min, max(price) AS price_max, max(_ingested_at) AS _ingested_at FROM stg_transactions GROUP BY ALL",
    "dim_article": "SELECT * FROM stg_articles",
    "dim_customer": "SELECT * FROM stg_customers",
}


def register_views(spark: SparkSession, frames: dict[str, DataFrame]) -> None:
    """Names frames for SQL in this session."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)


def staging(warehouse: Warehouse) -> dict[str, DataFrame]:
    """The staging views, registered; each reads its raw table as of now."""
    out = {}
    for name, (raw, sql) in STAGING.items():
        register_views(warehouse.spark, {f"raw_{raw}": warehouse.table(raw).read()})
        out[name] = warehouse.spark.sql(sql.format(source=f"raw_{raw}"))
    register_views(warehouse.spark, out)
    return out


def build_marts(warehouse: Warehouse, names=tuple(MARTS)) -> dict[str, SnapshotTable]:
    """The named marts, each written whole from the staging views; the fact by day."""
    staging(warehouse)
    out = {}
    for name in names:
        df = warehouse.spark.sql(MARTS[name])
        table = SnapshotTable(warehouse.spark, f"{warehouse.path}/marts/{name}")
        table.create(df.schema, "t_dat" if "t_dat" in df.columns else None)
        table.replace(df)
        out[name] = table
    return out
