"""Fact table, data tests, merges, late data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallgrass.operators import merge as g
from tallgrass.operators import model as m
from tallgrass.plans.common import EV, TX
from tallgrass.sources import adapter as a
from tallgrass.sources import csv

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


_FACT = "SELECT customer_id, article_id, t_dat, sales_channel_id, count(*) AS qty, CAST(sum(price) AS DOUBLE) AS revenue, CAST(sum(price) AS DOUBLE) / count(price) AS price_avg, CAST(min(price) AS DOUBLE) AS price_min, CAST(max(price) AS DOUBLE) AS price_max FROM tx GROUP BY ALL"


@query("fact_grain", f"WITH {TX} {_FACT}")
def fact_grain(spark, d):
    return m.fact_transaction(a.transactions(spark, d))


@query("fact_grain_events", f"WITH {EV} {_FACT}")
def fact_grain_events(spark, d):
    return m.fact_transaction(a.event_transactions(spark, d))


@query("grain_profile", f"WITH {EV}, g AS (SELECT count(*) AS n, count(DISTINCT price) AS p FROM tx GROUP BY customer_id, article_id, t_dat) SELECT count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_multi_row, CAST(sum(CASE WHEN p > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_multi_price, max(n) AS max_group, round(1 - count(*) / sum(n), 8) AS collapsed_share FROM g")
def grain_profile(spark, d):
    return m.grain_profile(a.event_transactions(spark, d), ["customer_id", "article_id", "t_dat"])


@query("price_spread_quantiles", f"WITH {EV}, g AS (SELECT CAST(min(price) AS DOUBLE) AS lo, CAST(max(price) AS DOUBLE) AS hi FROM tx GROUP BY customer_id, article_id, t_dat), s AS (SELECT (hi - lo) / hi AS s FROM g WHERE hi > lo) SELECT count(*) AS n, round(quantile_cont(s, 0.5), 8) AS p50, round(quantile_cont(s, 0.9), 8) AS p90, round(quantile_cont(s, 1.0), 8) AS p100 FROM s")
def price_spread_quantiles(spark, d):
    return m.price_spread(a.event_transactions(spark, d), ["customer_id", "article_id", "t_dat"])


@query("date_bounds_scan", f"WITH {TX} SELECT t_dat, count(*) AS n, CAST(sum(price) AS DOUBLE) AS revenue FROM tx WHERE t_dat >= DATE '2000-01-01' AND t_dat <= DATE '2000-01-31' GROUP BY t_dat")
def date_bounds_scan(spark, d):
    import datetime as dt

    rows = csv.between(a.transactions(spark, d), "t_dat", dt.date(2000, 1, 1), dt.date(2000, 1, 31))
    return rows.groupBy("t_dat").agg(F.count("*").alias("n"), m.money(F.sum("price")).alias("revenue"))


@query("dim_join_count", f"WITH {TX} SELECT count(*) AS matched FROM tx JOIN part ON article_id = p_partkey")
def dim_join_count(spark, d):
    return a.transactions(spark, d).join(a.articles(spark, d), "article_id").agg(F.count("*").alias("matched"))


@query("fk_orphans", f"WITH {TX} SELECT article_id, count(*) AS n FROM tx WHERE article_id NOT IN (SELECT p_partkey FROM part WHERE p_size > 10) GROUP BY article_id")
def fk_orphans(spark, d):
    dim = a.table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("article_id"))
    return m.check_relationship(a.transactions(spark, d), dim, "article_id")


@query("cold_start", f"WITH {TX} SELECT p_partkey AS article_id FROM part WHERE NOT EXISTS (SELECT 1 FROM tx WHERE article_id = p_partkey AND t_dat >= DATE '2001-06-01')")
def cold_start(spark, d):
    return m.cold_start(a.articles(spark, d), a.transactions(spark, d).where("t_dat >= DATE '2001-06-01'"), "article_id")


@query("accepted_values", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('O', 'F') GROUP BY 1")
def accepted_values(spark, d):
    return m.check_accepted(a.table(spark, d, "orders"), "o_orderstatus", ("O", "F"))


@query("unique_violations", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def unique_violations(spark, d):
    return m.check_unique(a.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("not_null_audit", "SELECT 'event_type' AS column_name, count(*) AS n_rows, count(*) - count(event_type) AS n_null FROM events UNION ALL SELECT 'value', count(*), count(*) - count(value) FROM events UNION ALL SELECT 'props', count(*), count(*) - count(props) FROM events")
def not_null_audit(spark, d):
    return m.check_not_null(a.table(spark, d, "events"), ["event_type", "value", "props"])


@query("units_anomaly", f"WITH {EV} SELECT customer_id, article_id, t_dat, count(*) AS units FROM tx GROUP BY ALL HAVING count(*) >= 3")
def units_anomaly(spark, d):
    return m.check_units(a.event_transactions(spark, d), 3)


@query("daily_rowcount_anomaly", f"WITH {TX}, c AS (SELECT t_dat, count(*) AS n FROM tx GROUP BY t_dat) SELECT t_dat, n FROM c WHERE n < 0.5 * (SELECT avg(n) FROM c) OR n > 2.0 * (SELECT avg(n) FROM c)")
def daily_rowcount_anomaly(spark, d):
    return m.check_daily_counts(a.transactions(spark, d), "t_dat")


@query("freshness", "SELECT CAST(max(ts) AS DATE) AS latest, CAST(date_diff('day', CAST(max(ts) AS DATE), DATE '2024-02-15') AS INTEGER) AS age_days FROM events")
def freshness(spark, d):
    return m.freshness(a.table(spark, d, "events"), "ts", "2024-02-15")


@query("outlier_cap", "SELECT count(*) AS n, round(sum(CAST(least(value, 50) AS DECIMAL(14,2))), 2)::DOUBLE AS total FROM events")
def outlier_cap(spark, d):
    rows = m.treat_outliers(a.table(spark, d, "events").select("value"), "value", 50.0)
    return rows.agg(F.count("*").alias("n"), m.money(F.sum(F.col("value").cast("decimal(14,2)"))).alias("total"))


@query("drift_psi", """WITH x AS (SELECT floor(value / 10) AS b, CASE WHEN CAST(ts AS DATE) < DATE '2024-01-16' THEN 1 ELSE 0 END AS first FROM events),
t AS (SELECT b, sum(first) AS na, sum(1 - first) AS nb FROM x GROUP BY b), s AS (SELECT sum(na) AS ta, sum(nb) AS tb, count(*) AS k FROM t),
r AS (SELECT (na + 0.5) / (ta + 0.5 * k) AS p, (nb + 0.5) / (tb + 0.5 * k) AS q FROM t, s) SELECT round(sum((p - q) * ln(CAST(p / q AS DOUBLE))), 6)::DOUBLE AS psi, count(*) AS n_buckets FROM r""")
def drift_psi(spark, d):
    e = a.table(spark, d, "events").select("value", F.to_date("ts").alias("day"))
    return m.drift_psi(e.where("day < DATE '2024-01-16'"), e.where("day >= DATE '2024-01-16'"), "value", 10.0)


_DIM = "SELECT c_custkey AS id, c_mktsegment AS segment, CAST(c_acctbal AS DECIMAL(12,2)) AS balance FROM customer"
_SRC = f"SELECT id + 100 AS id, upper(segment) AS segment, balance + 1 AS balance FROM ({_DIM}) WHERE id % 3 = 0"


def _dim(spark, d):
    return a.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").cast("decimal(12,2)").alias("balance"))


def _changed(dim):
    return dim.where("id % 3 = 0").select((F.col("id") + 100).alias("id"), F.upper("segment").alias("segment"), (F.col("balance") + 1).cast("decimal(12,2)").alias("balance"))


@query("upsert_dim", f"WITH t AS ({_DIM}), s AS ({_SRC}) SELECT id, segment, CAST(balance AS DOUBLE) AS balance FROM t WHERE id NOT IN (SELECT id FROM s) UNION ALL SELECT id, segment, CAST(balance AS DOUBLE) FROM s")
def upsert_dim(spark, d):
    dim = _dim(spark, d)
    return g.upsert(dim, _changed(dim), "id").withColumn("balance", F.col("balance").cast("double"))


@query("merge_reconcile_day", f"WITH t AS ({_DIM}), s AS ({_SRC}) SELECT id, segment, CAST(balance AS DOUBLE) AS balance FROM t WHERE id NOT IN (SELECT id FROM s) AND segment <> 'BUILDING' UNION ALL SELECT id, segment, CAST(balance AS DOUBLE) FROM s")
def merge_reconcile_day(spark, d):
    dim = _dim(spark, d)
    return g.upsert(dim, _changed(dim), "id", delete_missing=F.col("segment") == "BUILDING").withColumn("balance", F.col("balance").cast("double"))


@query("partition_overwrite", f"WITH {EV}, b AS (SELECT * FROM tx WHERE t_dat IN (DATE '2024-01-05', DATE '2024-01-06') AND article_id = 'click') SELECT t_dat, article_id, count(*) AS n FROM (SELECT * FROM tx WHERE t_dat NOT IN (SELECT t_dat FROM b) UNION ALL SELECT * FROM b) GROUP BY ALL")
def partition_overwrite(spark, d):
    tx = a.event_transactions(spark, d)
    batch = tx.where("t_dat IN (DATE '2024-01-05', DATE '2024-01-06') AND article_id = 'click'")
    return g.overwrite_days(tx, batch, "t_dat").groupBy("t_dat", "article_id").agg(F.count("*").alias("n"))


@query("multiset_diff", f"WITH {EV}, p AS (SELECT customer_id, article_id FROM tx), q AS (SELECT customer_id, article_id FROM tx WHERE t_dat <> DATE '2024-01-10'), d AS (SELECT 'a' AS side, * FROM (SELECT * FROM p EXCEPT ALL SELECT * FROM q) UNION ALL SELECT 'b', * FROM (SELECT * FROM q EXCEPT ALL SELECT * FROM p)) SELECT side, customer_id, article_id, count(*) AS n FROM d GROUP BY ALL")
def multiset_diff(spark, d):
    tx = a.event_transactions(spark, d)
    cols = ["customer_id", "article_id"]
    return g.multiset_diff(tx.select(*cols), tx.where("t_dat <> DATE '2024-01-10'").select(*cols)).groupBy("side", *cols).agg(F.count("*").alias("n"))


_LATE = f"WITH {EV} SELECT t_dat, article_id, count(*) AS n, CAST(sum(price) AS DOUBLE) AS revenue FROM tx GROUP BY ALL"


@query("late_arrival_state", _LATE)
def late_arrival_state(spark, d):
    """Half of a day arrives after the next day; the state equals a clean load."""
    tx = a.event_transactions(spark, d)
    late = (F.col("t_dat") == F.lit("2024-01-12").cast("date")) & (F.col("customer_id") % 2 == 0)
    log = g.insert_new_batches(tx.where(~late).withColumn("_source_file", F.lit("base")), tx.where(late).withColumn("_source_file", F.lit("late")), "_source_file")
    return log.groupBy("t_dat", "article_id").agg(F.count("*").alias("n"), m.money(F.sum("price")).alias("revenue"))


@query("replay_guard", _LATE)
def replay_guard(spark, d):
    """The same batch offered twice lands once."""
    tx = a.event_transactions(spark, d).withColumn("_source_file", F.when(F.col("customer_id") % 2 == 0, "late").otherwise("base"))
    late = tx.where("_source_file = 'late'")
    once = g.insert_new_batches(tx.where("_source_file = 'base'"), late, "_source_file")
    return g.insert_new_batches(once, late, "_source_file").groupBy("t_dat", "article_id").agg(F.count("*").alias("n"), m.money(F.sum("price")).alias("revenue"))
