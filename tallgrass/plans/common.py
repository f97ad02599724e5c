"""What the queries share: the retail model as SQL, and parameters."""

from __future__ import annotations

EPOCH, EVENT_EPOCH = "1995-01-01", "2024-01-01"
#: Last day of history and the days that follow it.
AS_OF, TRUTH = "2001-06-01", ("2001-06-01", "2001-08-01")

TX = """tx AS (SELECT CAST(o_orderdate AS DATE) AS t_dat, o_custkey AS customer_id, l_partkey AS article_id,
  CAST(l_extendedprice AS DECIMAL(12,2)) AS price, l_linenumber % 2 + 1 AS sales_channel_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""
EV = """tx AS (SELECT CAST(ts AS DATE) AS t_dat, user_id AS customer_id, event_type AS article_id,
  CAST(value AS DECIMAL(12,2)) AS price, 1 AS sales_channel_id FROM events)"""
ART = "art AS (SELECT p_partkey AS article_id, p_type AS product_type FROM part)"


def day(epoch: str, column: str = "t_dat") -> str:
    return f"CAST(date_diff('day', DATE '{epoch}', {column}) AS INTEGER)"
