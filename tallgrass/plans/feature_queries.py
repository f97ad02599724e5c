"""Daily aggregates, rolling features, slices, backfill."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallgrass.functions.scalars import day_index
from tallgrass.operators import distinct
from tallgrass.operators import features as f
from tallgrass.plans.common import ART, EPOCH, EV, EVENT_EPOCH, TX, day
from tallgrass.sources import adapter as a

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def _money(df, *columns):
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def _rolled(keys: str, tx: str, measures, windows, prefix: str, epoch: str, extra: str = "") -> str:
    kinds = {"n_txn": "BIGINT", "spend": "DOUBLE"}
    cols = ", ".join(f"CAST(coalesce(sum({m}) OVER (PARTITION BY {keys} ORDER BY day_index RANGE BETWEEN {w} PRECEDING AND 1 PRECEDING), 0) AS {kinds[m]}) AS {prefix}_{m}_{w}d" for m in measures for w in windows)
    return f"WITH {tx}{extra}, d AS (SELECT {keys}, {day(epoch)} AS day_index, count(*) AS n_txn, sum(price) AS spend FROM tx GROUP BY ALL) SELECT {keys}, day_index, {cols} FROM d"


@query("pit_customer_rolling", _rolled("customer_id", TX, ("n_txn", "spend"), (30, 90), "cust", EPOCH))
def pit_customer_rolling(spark, d):
    daily = f.daily_agg(a.transactions(spark, d), ["customer_id"], epoch=EPOCH)
    return _money(f.rolling_features(daily, ["customer_id"], ["n_txn", "spend"], (30, 90), prefix="cust"), "cust_spend_30d", "cust_spend_90d")


@query("pit_article_rolling", _rolled("article_id", TX, ("n_txn", "spend"), (30, 90), "art", EPOCH))
def pit_article_rolling(spark, d):
    daily = f.daily_agg(a.transactions(spark, d), ["article_id"], epoch=EPOCH)
    return _money(f.rolling_features(daily, ["article_id"], ["n_txn", "spend"], (30, 90), prefix="art"), "art_spend_30d", "art_spend_90d")


@query("pit_cross_rolling", f"WITH {TX}, {ART}, t AS (SELECT * FROM tx JOIN art USING (article_id)), d AS (SELECT customer_id, product_type, {day(EPOCH)} AS day_index, count(*) AS n_txn FROM t GROUP BY ALL) SELECT customer_id, product_type, day_index, CAST(coalesce(sum(n_txn) OVER (PARTITION BY customer_id, product_type ORDER BY day_index RANGE BETWEEN 90 PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS x_n_txn_90d FROM d")
def pit_cross_rolling(spark, d):
    tx = a.transactions(spark, d).join(a.articles(spark, d).select("article_id", "product_type"), "article_id")
    return f.rolling_features(f.daily_agg(tx, ["customer_id", "product_type"], epoch=EPOCH), ["customer_id", "product_type"], ["n_txn"], (90,), prefix="x")


def _distincts(keys: tuple[str, ...], member: str, prefix: str, extra: str = "", source: str = "tx") -> str:
    name, by, on = member.removesuffix("_id"), ", ".join(keys), " AND ".join(f"b.{k} = a.{k}" for k in keys)
    counts = ", ".join(f"count(DISTINCT CASE WHEN b.day_index >= a.day_index - {w} THEN b.{member} END) AS {prefix}_n_{name}s_{w}d" for w in f.WINDOWS)
    own = ", ".join(f"a.{k}" for k in keys)
    return f"WITH {TX}{extra}, s AS (SELECT DISTINCT {by}, {member}, {day(EPOCH)} AS day_index FROM {source}), d AS (SELECT DISTINCT {by}, day_index FROM s) SELECT {own}, a.day_index, {counts} FROM d a LEFT JOIN s b ON {on} AND b.day_index BETWEEN a.day_index - 90 AND a.day_index - 1 GROUP BY ALL"


@query("rolling_distinct_customer", _distincts(("customer_id",), "article_id", "cust"))
def rolling_distinct_customer(spark, d):
    """Articles that each customer bought in the days before, each once however often."""
    return distinct.rolling_distinct(a.transactions(spark, d), ["customer_id"], "article_id", prefix="cust", epoch=EPOCH)


@query("rolling_distinct_article", _distincts(("article_id",), "customer_id", "art"))
def rolling_distinct_article(spark, d):
    return distinct.rolling_distinct(a.transactions(spark, d), ["article_id"], "customer_id", prefix="art", epoch=EPOCH)


@query("rolling_distinct_cross", _distincts(("customer_id", "product_type"), "article_id", "cross", f", {ART}, typed AS (SELECT * FROM tx JOIN art USING (article_id))", "typed"))
def rolling_distinct_cross(spark, d):
    tx = a.transactions(spark, d).join(a.articles(spark, d).select("article_id", "product_type"), "article_id")
    return distinct.rolling_distinct(tx, ["customer_id", "product_type"], "article_id", prefix="cross", epoch=EPOCH)


_SPINE = f"""WITH {EV}, d AS (SELECT customer_id, {day(EVENT_EPOCH)} AS day_index, count(*) AS n_txn FROM tx GROUP BY ALL),
s AS (SELECT customer_id, day_index FROM (SELECT DISTINCT customer_id FROM tx), (SELECT unnest([7, 14, 21, 28]) AS day_index)),
j AS (SELECT coalesce(d.customer_id, s.customer_id) AS customer_id, coalesce(d.day_index, s.day_index) AS day_index, n_txn, s.customer_id IS NOT NULL AS wanted FROM d FULL JOIN s ON d.customer_id = s.customer_id AND d.day_index = s.day_index),
r AS (SELECT *, CAST(coalesce(sum(n_txn) OVER (PARTITION BY customer_id ORDER BY day_index RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ev_n_txn_7d FROM j)
"""


def _spine(spark, d):
    tx = a.event_transactions(spark, d)
    days = spark.createDataFrame([(x,) for x in (7, 14, 21, 28)], "day_index int")
    daily = f.daily_agg(tx, ["customer_id"], epoch=EVENT_EPOCH)
    wanted = f.spine(tx.select("customer_id"), days)
    return wanted, f.rolling_features(daily, ["customer_id"], ["n_txn"], (7,), wanted, prefix="ev")


@query("pit_spine_rolling", _SPINE + "SELECT customer_id, day_index, ev_n_txn_7d FROM r WHERE wanted")
def pit_spine_rolling(spark, d):
    return _spine(spark, d)[1]


@query("feature_coverage", _SPINE + ", cohort AS (SELECT customer_id, unnest([7, 14, 21, 28, 31]) AS day_index FROM (SELECT DISTINCT customer_id FROM tx)) SELECT count(*) AS n, round(avg(CASE WHEN ev_n_txn_7d IS NULL THEN 0.0 ELSE 1.0 END), 8) AS coverage FROM cohort LEFT JOIN (SELECT * FROM r WHERE wanted) r USING (customer_id, day_index)")
def feature_coverage(spark, d):
    """A cohort with one day that is not on the spine, so its rows find no feature."""
    wanted, rolled = _spine(spark, d)
    off = wanted.select("customer_id", F.lit(31).alias("day_index")).distinct()
    return f.coverage(wanted.unionByName(off), rolled, ["customer_id", "day_index"], "ev_n_txn_7d")


@query("rows_vs_range_gap", f"WITH {EV}, d AS (SELECT customer_id, {day(EVENT_EPOCH)} AS day_index, count(*) AS n_txn FROM tx GROUP BY ALL), r AS (SELECT customer_id, day_index, CAST(coalesce(sum(n_txn) OVER (PARTITION BY customer_id ORDER BY day_index RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS by_range, CAST(coalesce(sum(n_txn) OVER (PARTITION BY customer_id ORDER BY day_index ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS by_rows FROM d) SELECT * FROM r WHERE by_range <> by_rows")
def rows_vs_range_gap(spark, d):
    return f.gap_rows(f.daily_agg(a.event_transactions(spark, d), ["customer_id"], epoch=EVENT_EPOCH), ["customer_id"], "n_txn")


def _daily(entity: str, distinct: str, name: str) -> str:
    return f"WITH {TX} SELECT {entity}, t_dat AS feature_date, {day(EPOCH)} AS day_index, count(*) AS n_txn, count(DISTINCT {distinct}) AS {name}, CAST(sum(price) AS DOUBLE) AS spend, CAST(sum(price) AS DOUBLE) / count(price) AS avg_price FROM tx GROUP BY ALL"


@query("daily_customer_agg", _daily("customer_id", "article_id", "n_articles"))
def daily_customer_agg(spark, d):
    return _money(f.daily_agg(a.transactions(spark, d), ["customer_id"], "article_id", EPOCH), "spend")


@query("daily_article_agg", _daily("article_id", "customer_id", "n_customers"))
def daily_article_agg(spark, d):
    return _money(f.daily_agg(a.transactions(spark, d), ["article_id"], "customer_id", EPOCH), "spend")


@query("daily_cross_agg", f"WITH {TX}, {ART} SELECT customer_id, product_type, t_dat AS feature_date, {day(EPOCH)} AS day_index, count(*) AS n_txn FROM tx JOIN art USING (article_id) GROUP BY ALL")
def daily_cross_agg(spark, d):
    tx = a.transactions(spark, d).join(a.articles(spark, d).select("article_id", "product_type"), "article_id")
    return f.daily_agg(tx, ["customer_id", "product_type"], epoch=EPOCH).drop("spend", "avg_price")


@query("split_slices", f"WITH {TX}, m AS (SELECT max(t_dat) AS m FROM tx), s AS (SELECT CASE WHEN t_dat <= m - 42 THEN 'train' WHEN t_dat <= m - 28 THEN 'val_tune' WHEN t_dat <= m - 21 THEN 'val_calib' WHEN t_dat <= m - 14 THEN 'ope_env' WHEN t_dat <= m - 7 THEN 'test' ELSE 'holdout' END AS slice, t_dat FROM tx, m) SELECT slice, count(*) AS n, min(t_dat) AS first_day, max(t_dat) AS last_day FROM s GROUP BY slice")
def split_slices(spark, d):
    tx = a.transactions(spark, d)
    last = a.table(spark, d, "orders").agg(F.max(F.to_date("o_orderdate"))).first()[0]
    return tx.select(f.slice_of(F.col("t_dat"), last).alias("slice"), "t_dat").groupBy("slice").agg(F.count("*").alias("n"), F.min("t_dat").alias("first_day"), F.max("t_dat").alias("last_day"))


@query("backfill_window", f"WITH {TX}, d AS (SELECT customer_id, {day(EPOCH)} AS day_index, count(*) AS n_txn, sum(price) AS spend FROM tx GROUP BY ALL), r AS (SELECT customer_id, day_index, CAST(coalesce(sum(n_txn) OVER w, 0) AS BIGINT) AS cust_n_txn_90d, CAST(coalesce(sum(spend) OVER w, 0) AS DOUBLE) AS cust_spend_90d FROM d WINDOW w AS (PARTITION BY customer_id ORDER BY day_index RANGE BETWEEN 90 PRECEDING AND 1 PRECEDING)) SELECT * FROM r WHERE day_index BETWEEN 2000 AND 2030")
def backfill_window(spark, d):
    out = f.build_features(a.transactions(spark, d), start=2000, end=2030, epoch=EPOCH, windows=(90,))["customer"]
    return _money(out, "cust_spend_90d")


@query("historical_rates", f"WITH {TX}, {ART}, t AS (SELECT * FROM tx JOIN art USING (article_id)), d AS (SELECT customer_id, product_type, {day(EPOCH)} AS day_index, count(*) AS n FROM t GROUP BY ALL), c AS (SELECT customer_id, {day(EPOCH)} AS day_index, count(*) AS n FROM t GROUP BY ALL), x AS (SELECT customer_id, product_type, day_index, sum(n) OVER (PARTITION BY customer_id, product_type ORDER BY day_index RANGE BETWEEN 90 PRECEDING AND 1 PRECEDING) AS own FROM d), y AS (SELECT customer_id, day_index, sum(n) OVER (PARTITION BY customer_id ORDER BY day_index RANGE BETWEEN 90 PRECEDING AND 1 PRECEDING) AS everything FROM c) SELECT customer_id, product_type, day_index, round(CAST(coalesce(own, 0) AS DOUBLE) / everything, 8) AS type_rate FROM x JOIN y USING (customer_id, day_index) WHERE everything > 0")
def historical_rates(spark, d):
    tx = a.transactions(spark, d).join(a.articles(spark, d).select("article_id", "product_type"), "article_id")
    own = f.rolling_features(f.daily_agg(tx, ["customer_id", "product_type"], epoch=EPOCH), ["customer_id", "product_type"], ["n_txn"], (90,), prefix="own")
    every = f.rolling_features(f.daily_agg(tx, ["customer_id"], epoch=EPOCH), ["customer_id"], ["n_txn"], (90,), prefix="all").where("all_n_txn_90d > 0")
    return own.join(every, ["customer_id", "day_index"]).select("customer_id", "product_type", "day_index", F.round(F.col("own_n_txn_90d") / F.col("all_n_txn_90d"), 8).alias("type_rate"))


@query("mean_basket", f"WITH {TX}, b AS (SELECT customer_id, t_dat, count(DISTINCT article_id) AS n FROM tx GROUP BY ALL) SELECT count(*) AS n_customer_days, round(avg(n), 8) AS mean_basket FROM b")
def mean_basket(spark, d):
    return a.transactions(spark, d).groupBy("customer_id", "t_dat").agg(F.countDistinct("article_id").alias("n")).agg(F.count("*").alias("n_customer_days"), F.round(F.avg("n"), 8).alias("mean_basket"))


@query("fact_day_index", f"WITH {TX} SELECT {day(EPOCH)} AS day_index, count(*) AS n FROM tx GROUP BY ALL")
def fact_day_index(spark, d):
    return a.transactions(spark, d).groupBy(day_index(F.col("t_dat"), EPOCH).alias("day_index")).agg(F.count("*").alias("n"))


