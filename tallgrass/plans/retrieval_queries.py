"""Candidate sources, their union, recall and contributions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallgrass.operators import graph_index, serving
from tallgrass.operators import retrieval as r
from tallgrass.plans.common import ART, AS_OF, TRUTH, TX
from tallgrass.sources import adapter as a
from tallgrass.sources.scratch import Scratch, Table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def _before(days: int | None = None) -> str:
    return f"t_dat < DATE '{AS_OF}'" + (f" AND t_dat >= DATE '{AS_OF}' - {days}" if days else "")


_POP = f"pop AS (SELECT article_id, count(*) AS n_sold FROM tx WHERE {_before(90)} GROUP BY article_id ORDER BY n_sold DESC, article_id LIMIT 40)"
_REP = f"rep AS (SELECT customer_id, article_id, last_day, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY last_day DESC, article_id) AS INTEGER) AS rank FROM (SELECT customer_id, article_id, max(t_dat) AS last_day FROM tx WHERE {_before()} GROUP BY ALL)) WHERE rank <= 12)"
_CAT = f"""sold AS (SELECT product_type, article_id, count(*) AS n FROM tx JOIN art USING (article_id) WHERE {_before(365)} GROUP BY ALL),
best AS (SELECT product_type, article_id, CAST(row_number() OVER (PARTITION BY product_type ORDER BY n DESC, article_id) AS INTEGER) AS rank FROM sold),
dom AS (SELECT customer_id, product_type FROM (SELECT customer_id, product_type, row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, product_type) AS k FROM tx JOIN art USING (article_id) WHERE {_before()} GROUP BY customer_id, product_type) WHERE k = 1),
cat AS (SELECT customer_id, article_id, product_type, rank FROM dom JOIN best USING (product_type) WHERE rank <= 20)"""
_BASKET = f"bask AS (SELECT customer_id, article_id, t_dat FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY t_dat DESC, article_id) AS k FROM (SELECT DISTINCT customer_id, article_id, t_dat FROM tx WHERE {_before(365)})) WHERE k <= 50)"
_PAIRS = f"""pairs AS (SELECT a, b, weight, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY a ORDER BY weight DESC, b) AS INTEGER) AS rank FROM (
  SELECT x.article_id AS a, y.article_id AS b, round(sum(pow(0.5, date_diff('day', greatest(x.t_dat, y.t_dat), DATE '{AS_OF}') / 30.0)), 6) AS weight
  FROM bask x JOIN bask y ON x.customer_id = y.customer_id AND x.article_id <> y.article_id AND abs(date_diff('day', x.t_dat, y.t_dat)) <= 7 GROUP BY ALL)) WHERE rank <= 40)"""
_COV = "cov AS (SELECT customer_id, article_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, article_id) AS INTEGER) AS rank FROM (SELECT customer_id, b AS article_id, CAST(sum(CAST(weight AS DECIMAL(18,6))) AS DOUBLE) AS score FROM (SELECT DISTINCT customer_id, article_id FROM bask) o JOIN pairs ON o.article_id = a GROUP BY ALL)) WHERE rank <= 60)"


def _pairs(spark, d):
    return r.covisit_pairs(a.transactions(spark, d), AS_OF, lookback=365)


def _covisit(spark, d):
    return r.covisit_candidates(a.transactions(spark, d), _pairs(spark, d), AS_OF, lookback=365)


def _category(spark, d):
    return r.category_popular(a.transactions(spark, d), a.articles(spark, d), AS_OF, 365, 20)


@query("global_pop", f"WITH {TX}, {_POP} SELECT * FROM pop")
def global_pop(spark, d):
    return r.popular(a.transactions(spark, d), AS_OF, 90, 40)


@query("repurchase", f"WITH {TX}, {_REP} SELECT * FROM rep")
def repurchase(spark, d):
    return r.repurchase(a.transactions(spark, d), AS_OF, 12)


@query("category_pop", f"WITH {TX}, {ART}, {_CAT} SELECT * FROM cat")
def category_pop(spark, d):
    return _category(spark, d)


@query("covisit_pairs", f"WITH {TX}, {_BASKET}, {_PAIRS} SELECT * FROM pairs")
def covisit_pairs(spark, d):
    return _pairs(spark, d)


@query("covisit_candidates", f"WITH {TX}, {_BASKET}, {_PAIRS}, {_COV} SELECT * FROM cov")
def covisit_candidates(spark, d):
    return _covisit(spark, d)


_VEC = "SELECT q_id, item_id, score, CAST(row_number() OVER (PARTITION BY q_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM (SELECT q.vec_id AS q_id, i.vec_id AS item_id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings i WHERE q.vec_id % 100 = 0)"


@query("vector_topk", f"SELECT * FROM ({_VEC}) WHERE rank <= 10")
def vector_topk(spark, d):
    """Queries are the vectors whose id is divisible by 100, against all vectors."""
    e = a.table(spark, d, "embeddings").select("vec_id", "embedding")
    return r.vector_topk(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("v")), e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v")), 10)


@query("mean_vector", f"WITH {TX}, {_REP}, v AS (SELECT vec_id AS article_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) SELECT customer_id, CAST(pos AS INTEGER) AS pos, round(avg(CAST(x AS DOUBLE)), 6) + 0.0 AS x FROM rep JOIN v USING (article_id) WHERE rank <= 10 GROUP BY ALL")
def mean_vector(spark, d):
    vectors = a.table(spark, d, "embeddings").select(F.col("vec_id").alias("article_id"), F.col("embedding").alias("v"))
    return r.mean_vector(a.transactions(spark, d), vectors, AS_OF, 10)


def _graph(spark, d, scratch):
    """Neighbours by graphs, the vectors scored for each query, and both sides of the search."""
    e = a.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    index, centre = graph_index.build_index(e, scratch)
    return *graph_index.graph_topk(e.where("id % 100 = 0"), index, centre, 10), e


@query("graph_topk")
def graph_topk(spark, d):
    """Approximate neighbours of the vectors whose id is divisible by 100; recall in ``graph_recall``."""
    with Scratch() as scratch:
        return _graph(spark, d, scratch)[0]


@query("graph_recall")
def graph_recall(spark, d):
    """Recall@10 of the graphs against the exact search, and the share of the vectors that a query scores."""
    with Scratch() as scratch:
        found, scored, e = _graph(spark, d, scratch)
    exact = r.vector_topk(e.where("id % 100 = 0").withColumnRenamed("id", "q_id"), e.withColumnRenamed("id", "item_id"), 10)
    return graph_index.recall_and_share(found, exact, scored, e.count())


@query("lsh_topk")
def lsh_topk(spark, d):
    """The same neighbours by L2 distance of unit vectors; the name is that of the hashing that the graphs replaced."""
    return graph_topk(spark, d).select("q_id", "item_id", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score"))).alias("d"), "rank")


#: Best sellers for every customer with a history, and the articles nearest to the mean of the customer's latest ones.
_GPOP = f"gpop AS (SELECT customer_id, article_id FROM (SELECT DISTINCT customer_id FROM tx WHERE {_before()}), pop)"
_ANN = """pos AS (SELECT vec_id AS article_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
means AS (SELECT customer_id, pos, round(avg(CAST(x AS DOUBLE)), 6) AS x FROM rep JOIN pos USING (article_id) WHERE rank <= 10 GROUP BY ALL),
users AS (SELECT customer_id, list(x ORDER BY pos) AS v FROM means GROUP BY customer_id),
near AS (SELECT customer_id, vec_id AS article_id, round(list_dot_product(CAST(CAST(v AS FLOAT[]) AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS score FROM users, embeddings),
ann AS (SELECT customer_id, article_id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, article_id) AS INTEGER) AS rank FROM near) WHERE rank <= 20)"""
_ALL = f"WITH {TX}, {ART}, {_REP}, {_CAT}, {_BASKET}, {_PAIRS}, {_COV}, {_POP}, {_GPOP}, {_ANN}, un AS (SELECT customer_id, article_id, 'repurchase' AS source FROM rep UNION ALL SELECT customer_id, article_id, 'category_pop' FROM cat UNION ALL SELECT customer_id, article_id, 'covisit' FROM cov UNION ALL SELECT customer_id, article_id, 'global_pop' FROM gpop UNION ALL SELECT customer_id, article_id, 'ann' FROM ann), cands AS (SELECT customer_id, article_id, list_sort(list(DISTINCT source)) AS sources FROM un GROUP BY ALL), truth AS (SELECT DISTINCT customer_id, article_id FROM tx WHERE t_dat BETWEEN DATE '{TRUTH[0]}' AND DATE '{TRUTH[1]}')"


def _log(spark, d):
    """The joined transactions, written once: every source reads them."""
    return Table(a.transactions(spark, d), "transactions").df


def _vectors(spark, d):
    return a.table(spark, d, "embeddings").select(F.col("vec_id").alias("article_id"), F.col("embedding").alias("v"))


def _ann(tx, vectors):
    users = r.customer_vectors(tx, vectors, AS_OF, 10).withColumnRenamed("customer_id", "q_id")
    near = r.shared_topk(users, vectors.withColumnRenamed("article_id", "item_id"), 20)
    return near.select(F.col("q_id").alias("customer_id"), F.col("item_id").alias("article_id"), "score", "rank")


def _cands(spark, d, tx=None):
    """All five sources."""
    tx, dim = _log(spark, d) if tx is None else tx, a.articles(spark, d)
    pairs = r.covisit_pairs(tx, AS_OF, lookback=365)
    return r.union_candidates(
        repurchase=r.repurchase(tx, AS_OF, 12), category_pop=r.category_popular(tx, dim, AS_OF, 365, 20),
        covisit=r.covisit_candidates(tx, pairs, AS_OF, lookback=365), global_pop=r.popular_for(tx, AS_OF, 90, 40), ann=_ann(tx, _vectors(spark, d)),
    )


def _truth(spark, d, tx=None):
    return r.truth_pairs(a.transactions(spark, d) if tx is None else tx, *TRUTH)


@query("candidate_union_tags", _ALL + " SELECT array_to_string(sources, '+') AS tags, count(*) AS n FROM cands GROUP BY 1")
def candidate_union_tags(spark, d):
    return _cands(spark, d).groupBy(F.array_join("sources", "+").alias("tags")).agg(F.count("*").alias("n"))


@query("recall_at_k", f"WITH {TX}, {ART}, {_CAT}, truth AS (SELECT DISTINCT customer_id, article_id FROM tx WHERE t_dat BETWEEN DATE '{TRUTH[0]}' AND DATE '{TRUTH[1]}') SELECT count(c.rank) AS hits, count(*) AS n_true, round(count(c.rank) / count(*), 8) AS recall FROM truth LEFT JOIN (SELECT * FROM cat WHERE rank <= 20) c USING (customer_id, article_id)")
def recall_at_k(spark, d):
    return r.recall_at_k(_category(spark, d), _truth(spark, d), 20)


@query("recall_ceiling", _ALL + " SELECT count(sources) AS hits, count(*) AS n_true, round(count(sources) / count(*), 8) AS recall FROM truth LEFT JOIN cands USING (customer_id, article_id)")
def recall_ceiling(spark, d):
    tx = _log(spark, d)
    return r.recall_ceiling(_cands(spark, d, tx), _truth(spark, d, tx))


@query("source_marginals", _ALL + ", h AS (SELECT sources, CASE WHEN t.customer_id IS NULL THEN 0 ELSE 1 END AS hit FROM cands c LEFT JOIN truth t USING (customer_id, article_id)), e AS (SELECT unnest(sources) AS source, len(sources) = 1 AS alone, hit FROM h) SELECT source, count(*) AS n_cands, CAST(sum(CASE WHEN alone THEN 1 ELSE 0 END) AS BIGINT) AS n_alone, CAST(sum(hit) AS BIGINT) AS solo_hits, CAST(sum(CASE WHEN alone THEN hit ELSE 0 END) AS BIGINT) AS marginal_hits, round(sum(CASE WHEN alone THEN hit ELSE 0 END) / nullif(sum(CASE WHEN alone THEN 1 ELSE 0 END), 0), 8) AS per_slot FROM e GROUP BY source")
def source_marginals(spark, d):
    tx = _log(spark, d)
    return r.source_contributions(_cands(spark, d, tx), _truth(spark, d, tx))


@query("submission", f"WITH {TX}, {ART}, {_REP}, {_CAT}, {_POP}, best_all AS (SELECT article_id, row_number() OVER (ORDER BY n_sold DESC, article_id) AS rank FROM pop), un AS (SELECT customer_id, article_id, 0 AS tier, rank FROM rep UNION ALL SELECT customer_id, article_id, 1, rank FROM cat UNION ALL SELECT c_custkey, article_id, 2, rank FROM customer, best_all), once AS (SELECT customer_id, article_id, min(tier * 1000 + rank) AS place FROM un GROUP BY ALL), pl AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY place, article_id) AS k FROM once) SELECT customer_id, string_agg(CAST(article_id AS VARCHAR), ' ' ORDER BY k) AS prediction FROM pl WHERE k <= 12 GROUP BY customer_id")
def submission(spark, d):
    """Twelve articles for every customer: own ones, then the category's, then best sellers."""
    tx, customers = _log(spark, d), a.customers(spark, d)
    best = r.popular(tx, AS_OF, 90, 40).select("article_id", F.row_number().over(Window.orderBy(F.desc("n_sold"), "article_id")).alias("rank"))
    lists = serving.fill_lists(r.repurchase(tx, AS_OF, 12), r.category_popular(tx, a.articles(spark, d), AS_OF, 365, 20), best, customers)
    return serving.submission(lists, customers, [])


@query("event_latency", "SELECT event_type AS stage, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def event_latency(spark, d):
    return serving.latency(a.table(spark, d, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("ms")))
