"""Recommendations for one customer or all, with stage timings."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallgrass.operators.joins import small_side
from tallgrass.operators.quantile import exact_quantiles
from tallgrass.sources.scratch import shared_dir


def latest_features(features: DataFrame, day: str = "day_index") -> DataFrame:
    """The rows of the latest feature day."""
    last = features.agg(F.max(day).alias(day))
    return features.join(F.broadcast(last), day)


#: Files of a store: a request opens one of them.
STORE_BUCKETS = 64


class KeyedStore:
    """Candidates with all that ranking needs, bucketed by customer: a request reads one bucket, a batch of them joins without a shuffle of the store.

    The rows are hydrated when the store is written, by the code that made the features to train
    on, so serving computes none again.
    """

    def __init__(self, spark: SparkSession, name: str, key: str = "customer_id"):
        self.spark, self.name, self.key = spark, name, key

    @classmethod
    def write(cls, rows: DataFrame, key: str = "customer_id", buckets: int = STORE_BUCKETS) -> KeyedStore:
        """A store of ``rows``; one file a bucket, sorted by the key."""
        spark, name = rows.sparkSession, f"store_{uuid.uuid4().hex}"
        rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", f"{shared_dir(spark)}/tables/{name}").saveAsTable(name)
        return cls(spark, name, key)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def of(self, key) -> DataFrame:
        """The rows of one key."""
        return self.rows().where(F.col(self.key) == F.lit(key))

    def recommend(self, key, k: int = 12, score: str = "score", item: str = "article_id") -> DataFrame:
        """The key's k best rows, those without a score last; none for a key that is not there."""
        return self.of(key).orderBy(F.desc_nulls_last(score), item).limit(k)

    def recommend_all(self, requests: DataFrame, k: int = 12, score: str = "score", item: str = "article_id") -> DataFrame:
        """The k best rows of every key that is asked for, with their rank."""
        met = self.rows().join(requests.select(self.key).distinct(), self.key)
        w = Window.partitionBy(self.key).orderBy(F.desc_nulls_last(score), item)
        return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(self.spark)}/tables/{self.name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def recommend(cands: DataFrame, scores: DataFrame, customer_id, k: int = 12) -> tuple[DataFrame, dict[str, float]]:
    """The customer's k best candidates, and the seconds that retrieving, hydrating and ranking them took.

    ``cands`` are best a store's rows, of which a request reads one bucket. It handles one
    customer's few candidates, so each stage ends in the driver.
    """
    spark, took, start = cands.sparkSession, {}, time.perf_counter()

    def done(name: str, df: DataFrame) -> DataFrame:
        nonlocal start
        rows = spark.createDataFrame(df.collect(), df.schema)
        took[name], start = time.perf_counter() - start, time.perf_counter()
        return rows

    own = done("retrieve", cands.where(F.col("customer_id") == customer_id))
    hydrated = done("hydrate", own.join(scores, "article_id", "left"))
    return done("rank", hydrated.orderBy(F.desc_nulls_last("score"), "article_id").limit(k)), took


def submission(ranked: DataFrame, customers: DataFrame, fallback: list, k: int = 12) -> DataFrame:
    """k articles for every customer as one string; customers without candidates get the fallback."""
    best = ranked.where(F.col("rank") <= k).groupBy("customer_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "article_id"))), lambda x: x["article_id"].cast("string")), " ").alias("prediction"))
    return customers.select("customer_id").join(best, "customer_id", "left").select("customer_id", F.coalesce("prediction", F.lit(" ".join(map(str, fallback[:k])))).alias("prediction"))


def fill_lists(own: DataFrame, category: DataFrame, best: DataFrame, customers: DataFrame, k: int = 12) -> DataFrame:
    """(customer_id, article_id, rank): k articles for every customer: own ones, then the category's, then best sellers, each once.

    Each list ranks its articles from 1 without gaps, so none beyond its k-th can be among a
    customer's k. Own and category rows meet as one array a customer; of ``best`` (article_id,
    rank), a short list, the first k go to all tasks as one array, so no row is made of them for a
    customer before the k are known.
    """
    place = lambda df, tier: df.where(F.col("rank") <= k).select("customer_id", F.struct(F.lit(tier).alias("tier"), F.col("rank").cast("int").alias("rank"), F.col("article_id").cast("long").alias("article_id")).alias("x"))
    rows = place(own, 0).unionByName(place(category, 1))
    everyone = customers.select("customer_id", F.lit(None).cast(rows.schema["x"].dataType).alias("x"))
    lists = rows.unionByName(everyone).groupBy("customer_id").agg(F.sort_array(F.collect_list("x")).alias("x"), F.max(F.col("x").isNull()).alias("listed"))
    last = best.where(F.col("rank") <= k).agg(F.sort_array(F.collect_list(F.struct("rank", F.col("article_id").cast("long").alias("article_id")))).alias("last"))
    ids = F.concat("x.article_id", F.when(F.col("listed"), F.col("last.article_id")).otherwise(F.array().cast("array<long>")))
    first = lists.crossJoin(F.broadcast(last)).select("customer_id", F.posexplode(F.slice(F.array_distinct(ids), 1, k)).alias("rank", "article_id"))
    return first.select("customer_id", F.col("article_id").cast(own.schema["article_id"].dataType).alias("article_id"), (F.col("rank") + 1).alias("rank"))


def score_catalog(customers: DataFrame, catalog: DataFrame, score, k: int, salts: int = 16) -> DataFrame:
    """One stage: every listed customer against every article, k best. The catalogue goes to all tasks if it is small enough.

    The comparison that the two stages are held against, for a cohort; it scores customers times
    articles by definition. The k best of each part of the catalogue come first, so that what
    meets for a customer is at most ``salts`` times k rows.
    """
    pairs = customers.crossJoin(small_side(catalog)).withColumn("score", score).withColumn("__part", F.pmod(F.xxhash64("article_id"), F.lit(salts)))
    by = lambda *keys: Window.partitionBy(*keys).orderBy(F.desc("score"), "article_id")
    first = pairs.withColumn("rank", F.row_number().over(by("customer_id", "__part"))).where(F.col("rank") <= k)
    return first.withColumn("rank", F.row_number().over(by("customer_id"))).where(F.col("rank") <= k).drop("__part")


def score_catalog_by_taste(taste: DataFrame, customers: DataFrame, catalog: DataFrame, score, k: int) -> DataFrame:
    """(customer_id, article_id, score, rank): ``score_catalog`` where the score of an article depends on the customer only through ``n_own``, and does not fall with it.

    ``taste`` (customer_id, product_type, n_own > 0) says how much of a type a customer owns, else it
    is 0. Customers who own as much of a type rank its articles alike, so each article is scored
    once for every amount that somebody owns of its type, and the k best of each (type, amount) are
    kept. Of the types that a customer does not own only the k best of the whole catalogue at
    amount 0 can be among the customer's: one of them that is of an own type scores no less than
    at 0. So a customer meets k rows for each own type and k more, not the catalogue.
    """
    order = [F.desc("score"), "article_id"]
    best = lambda rows, *by: rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k).drop("rank")
    own = taste.where("product_type IS NOT NULL AND n_own > 0")
    classes = own.select("product_type", "n_own").distinct()
    listed = best(catalog.join(small_side(classes), "product_type").withColumn("score", score).select("product_type", "n_own", "article_id", "score"), "product_type", "n_own")
    first = catalog.withColumn("n_own", F.lit(0).cast("long")).withColumn("score", score).orderBy(*order).limit(k).select("article_id", "score")
    met = own.join(small_side(listed), ["product_type", "n_own"]).join(customers.select("customer_id").distinct(), "customer_id", "left_semi").select("customer_id", "article_id", "score")
    every = met.unionByName(customers.select("customer_id").crossJoin(F.broadcast(first)))
    once = every.groupBy("customer_id", "article_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("customer_id").orderBy(*order))).where(F.col("rank") <= k)


def latency(events: DataFrame) -> DataFrame:
    """Exact p50, p95 and p99 of (stage, ms), by range counting."""
    return exact_quantiles(events, ["stage"], "ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, 6)


def two_stage_overlap(one: DataFrame, two: DataFrame) -> DataFrame:
    """Share of the one-stage top-k that the two-stage path also returns."""
    hit = one.select("customer_id", "article_id").join(two.select("customer_id", "article_id", F.lit(1).alias("hit")), ["customer_id", "article_id"], "left")
    return hit.agg(F.count("*").alias("n"), F.round(F.count("hit") / F.count("*"), 8).alias("overlap"))


