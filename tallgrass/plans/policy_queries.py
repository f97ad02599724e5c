"""Ranking metrics, calibration, decisions and off-policy evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallgrass.functions import scalars as s
from tallgrass.operators import calibration
from tallgrass.operators import decision as p
from tallgrass.operators import ranking as k
from tallgrass.plans.common import AS_OF, TX
from tallgrass.sources import adapter as a

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


#: Scores fixed by hash, so that both engines score alike: lines as decisions over parts.
_HASH = "CAST(('0x' || substr(md5({}), 1, 8)) AS BIGINT)"
_SCORED = f"sc AS (SELECT l_orderkey AS group_id, l_partkey AS article_id, round({_HASH.format('CAST(l_orderkey AS VARCHAR) || chr(58) || CAST(l_partkey AS VARCHAR)')} / 4294967296.0, 4) AS score, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS label FROM lineitem GROUP BY 1, 2)"


#: Lines in a task where they are dealt by a column.
DEALT_ROWS = 250_000


def _scored(spark, d, dealt=()):
    """Scored lines; ``dealt`` names columns of the lines by whose values they are dealt, if what follows needs them together."""
    key = F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"))
    lines = a.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    rows = (lines.repartition(max(1, -(-lines.count() // DEALT_ROWS)), *dealt) if dealt else lines).groupBy("l_orderkey", "l_partkey").agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("label"))
    return rows.select(F.col("l_orderkey").alias("group_id"), F.col("l_partkey").alias("article_id"), F.round(s.hash_uniform(key), 4).alias("score"), "label")


@query("negative_downsample", f"SELECT event_type, count(*) AS n FROM events WHERE event_type = 'purchase' OR {_HASH.format('CAST(event_id AS VARCHAR)')} < 429496729 GROUP BY 1")
def negative_downsample(spark, d):
    e = a.table(spark, d, "events").withColumn("label", (F.col("event_type") == "purchase").cast("int"))
    return k.downsample_negatives(e, 0.1, F.col("event_id")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("elkan", f"WITH {_SCORED} SELECT group_id, article_id, round(score / (score + (1 - score) / 0.1), 8) AS p FROM sc")
def elkan(spark, d):
    return _scored(spark, d).select("group_id", "article_id", F.round(s.elkan(F.col("score"), 0.1), 8).alias("p"))


@query("ndcg12", f"WITH {_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, article_id) AS rk, row_number() OVER (PARTITION BY group_id ORDER BY label DESC, article_id) AS bk FROM sc), g AS (SELECT group_id, sum(CASE WHEN rk <= 12 THEN label / log2(rk + 1) ELSE 0 END) AS dcg, sum(CASE WHEN bk <= 12 THEN label / log2(bk + 1) ELSE 0 END) AS idcg FROM r GROUP BY 1) SELECT count(*) AS n_groups, round(avg(dcg / idcg), 6) AS ndcg FROM g WHERE idcg > 0")
def ndcg12(spark, d):
    return k.ndcg_at_k(_scored(spark, d), ["group_id"])


@query("map12", f"WITH {_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, article_id) AS rk FROM sc), h AS (SELECT *, sum(label) OVER (PARTITION BY group_id ORDER BY rk) AS hits FROM r), g AS (SELECT group_id, sum(CASE WHEN label = 1 AND rk <= 12 THEN hits / rk ELSE 0 END) AS p, sum(label) AS n1 FROM h GROUP BY 1) SELECT count(*) AS n_groups, round(avg(p / least(n1, 12)), 6) AS map FROM g WHERE n1 > 0")
def map12(spark, d):
    return k.map_at_k(_scored(spark, d), ["group_id"])


@query("auc_rank", f"WITH {_SCORED}, b AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM sc GROUP BY 1), c AS (SELECT *, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b) SELECT CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(n) AS BIGINT) AS n_neg, round(sum(p * (below + n / 2)) / (CAST(sum(p) AS DOUBLE) * sum(n)), 8) AS auc FROM c")
def auc_rank(spark, d):
    return k.auc(_scored(spark, d))


_BIN = "CAST(least(floor(score * 10), 9) AS INTEGER)"


@query("reliability_bins", f"WITH {_SCORED} SELECT {_BIN} AS bin, count(*) AS n, round(avg(score), 8) AS mean_p, round(avg(label), 8) AS mean_y FROM sc GROUP BY 1")
def reliability_bins(spark, d):
    return k.reliability(_scored(spark, d))


@query("ece_bins", f"WITH {_SCORED}, t AS (SELECT {_BIN} AS b, count(*) AS n, avg(score) AS p, avg(label) AS y FROM sc GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(n * abs(p - y)) / sum(n), 6) AS ece FROM t")
def ece_bins(spark, d):
    return k.ece(_scored(spark, d))


_PANEL = f"WITH {TX}, panel AS (SELECT article_id, CAST(date_trunc('week', t_dat) AS DATE) AS week, CAST(sum(price) AS DOUBLE) / count(*) AS mean_price, count(*) AS units FROM tx GROUP BY ALL)"


@query("article_week_panel", _PANEL + " SELECT * FROM panel")
def article_week_panel(spark, d):
    return p.article_week_panel(a.transactions(spark, d))


@query("elasticity_fe", _PANEL + ", d AS (SELECT ln(mean_price) - avg(ln(mean_price)) OVER w AS x, ln(units) - avg(ln(units)) OVER w AS y FROM panel WHERE mean_price > 0 WINDOW w AS (PARTITION BY article_id)) SELECT count(*) AS n, round(sum(x * y) / sum(x * x), 6) AS elasticity FROM d")
def elasticity_fe(spark, d):
    return p.elasticity(p.article_week_panel(a.transactions(spark, d)))


_OFFERS = "base AS (SELECT p_partkey AS id, p_retailprice AS price, 0.05 + (p_size % 10) / 50.0 AS p0 FROM part), offers AS (SELECT id, discount, least(1.0, p0 * pow(1 - discount, -2.5)) AS p, price FROM base, (SELECT unnest([0.0, 0.1, 0.2, 0.3])::DOUBLE AS discount)), o AS (SELECT id, discount, p, p * price * (1 - discount) AS revenue, p * price * discount AS spend FROM offers)"


def _offers(spark, d):
    base = a.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"), (0.05 + (F.col("p_size") % 10) / 50.0).alias("p0"))
    return p.offers(base, -2.5)


@query("price_response", f"WITH {_OFFERS} SELECT id, discount, round(p, 8) AS p, round(revenue, 6) AS revenue, round(spend, 6) AS spend FROM o")
def price_response(spark, d):
    return _offers(spark, d).select("id", "discount", *(F.round(c, n).alias(c) for c, n in (("p", 8), ("revenue", 6), ("spend", 6))))


@query("greedy_allocation", f"WITH {_OFFERS}, st AS (SELECT id, discount, round(revenue - lag(revenue) OVER w, 6) AS gain, round(spend - lag(spend) OVER w, 6) AS cost FROM o WINDOW w AS (PARTITION BY id ORDER BY discount)), ra AS (SELECT *, round(gain / cost, 6) AS ratio FROM st WHERE gain > 0 AND cost > 0), ru AS (SELECT *, CAST(sum(CAST(cost AS DECIMAL(20,6))) OVER (ORDER BY floor(ratio * 1000) DESC, ratio DESC, id, discount ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS spent FROM ra) SELECT id, discount, gain, cost, spent FROM ru WHERE spent <= 5000")
def greedy_allocation(spark, d):
    return p.allocate_greedy(_offers(spark, d), 5000.0)


#: A menu whose first step can lose revenue and whose later steps gain again: demand jumps at a fifth off.
_PROMO = """base AS (SELECT p_partkey AS id, p_retailprice AS price, 0.05 + (p_size % 10) / 50.0 AS p0, -0.5 - (p_size % 4) AS eps FROM part),
offers AS (SELECT id, discount, least(1.0, p0 * pow(1 - discount, eps) * CASE WHEN discount >= 0.2 THEN 1.4 ELSE 1.0 END) AS p, price FROM base, (SELECT unnest([0.0, 0.1, 0.2, 0.3, 0.4])::DOUBLE AS discount)),
o AS (SELECT id, discount, p * price * (1 - discount) AS revenue, p * price * discount AS spend FROM offers),
v AS (SELECT * FROM o j WHERE NOT EXISTS (SELECT 1 FROM o i WHERE i.id = j.id AND i.discount <> j.discount AND i.spend <= j.spend AND i.revenue >= j.revenue)
  AND NOT EXISTS (SELECT 1 FROM o i JOIN o k ON k.id = i.id WHERE i.id = j.id AND i.spend < j.spend AND j.spend < k.spend AND (j.revenue - i.revenue) * (k.spend - i.spend) <= (k.revenue - i.revenue) * (j.spend - i.spend))),
st AS (SELECT id, discount, round(revenue - lag(revenue) OVER w, 6) AS gain, round(spend - lag(spend) OVER w, 6) AS cost, row_number() OVER w AS step FROM v WINDOW w AS (PARTITION BY id ORDER BY spend)),
ra AS (SELECT *, round(gain / cost, 6) AS ratio FROM st WHERE gain > 0 AND cost > 0),
ru AS (SELECT *, CAST(sum(CAST(cost AS DECIMAL(20,6))) OVER (ORDER BY ratio DESC, id, step ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS spent FROM ra)"""


def _promo(spark, d):
    part = a.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"), (0.05 + (F.col("p_size") % 10) / 50.0).alias("p0"), (-0.5 - F.col("p_size") % 4).alias("eps"))
    rows = part.withColumn("discount", F.explode(F.array(*map(F.lit, (0.0, 0.1, 0.2, 0.3, 0.4)))))
    p_ = F.least(F.lit(1.0), F.col("p0") * F.pow(1 - F.col("discount"), F.col("eps")) * F.when(F.col("discount") >= 0.2, 1.4).otherwise(1.0))
    return rows.select("id", "discount", (p_ * F.col("price") * (1 - F.col("discount"))).alias("revenue"), (p_ * F.col("price") * F.col("discount")).alias("spend"))


@query("allocation_any_menu", f"WITH {_PROMO} SELECT id, discount, gain, cost, spent FROM ru WHERE spent <= 5000")
def allocation_any_menu(spark, d):
    """Steps along each id's hull, so that one which loses revenue is passed over together with the next."""
    return p.allocate_greedy(_promo(spark, d), 5000.0)


@query("allocation_dual", f"""WITH {_PROMO}, cum AS (SELECT r, sum(c) OVER (ORDER BY r DESC) - c AS above FROM (SELECT gain / cost AS r, sum(cost) AS c FROM ra GROUP BY 1)),
pr AS (SELECT CASE WHEN (SELECT sum(cost) FROM ra) <= 5000 THEN 0 ELSE min(r) END AS price FROM cum WHERE above <= 5000),
ch AS (SELECT id, max(revenue - price * spend) - max(CASE WHEN discount = 0 THEN revenue END) AS gain, max(price) AS price FROM o, pr GROUP BY id)
SELECT count(CASE WHEN spent <= 5000 THEN 1 END) AS n_steps, round(sum(CASE WHEN spent <= 5000 THEN gain END), 4) AS greedy_gain, round(sum(CASE WHEN spent <= 5000 THEN cost END), 4) AS greedy_spend,
round(sum(gain * greatest(0.0, least(cost, 5000 - (spent - cost))) / cost), 4) AS lp_gain, (SELECT round(sum(gain) + 5000 * max(price), 4) FROM ch) AS dual_gain FROM ru""")
def allocation_dual(spark, d):
    """Greedy, relaxed and dual value of one budget, each at least the one before."""
    return p.dual_bound(_promo(spark, d), 5000.0)


_DEC = "dec AS (SELECT l_partkey AS article_id, c_mktsegment AS segment, l_quantity > 45 AS is_new, l_discount AS relevance, CAST(l_tax AS DECIMAL(12,4)) AS spend FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"


@query("guardrails", f"WITH {_DEC}, one AS (SELECT count(DISTINCT article_id) / (SELECT count(*) FROM part) AS coverage, avg(CASE WHEN is_new THEN 1.0 ELSE 0.0 END) AS new_share, (SELECT min(r) FROM (SELECT avg(relevance) AS r FROM dec GROUP BY segment)) AS min_relevance, CAST(sum(spend) AS DOUBLE) AS spend FROM dec) SELECT 'coverage' AS metric, round(coverage, 6) AS value, coverage >= 0.5 AS ok FROM one UNION ALL SELECT 'new_share', round(new_share, 6), new_share >= 0.2 FROM one UNION ALL SELECT 'min_relevance', round(min_relevance, 6), min_relevance >= 0.01 FROM one UNION ALL SELECT 'spend', round(spend, 6), spend <= 1000000 FROM one")
def guardrails(spark, d):
    lines = a.table(spark, d, "lineitem").join(a.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(a.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    decisions = lines.select(F.col("l_partkey").alias("article_id"), F.col("c_mktsegment").alias("segment"), (F.col("l_quantity") > 45).alias("is_new"), F.col("l_discount").alias("relevance"), F.col("l_tax").cast("decimal(12,4)").alias("spend"))
    return p.guardrails(decisions, a.table(spark, d, "part"), {"coverage": 0.5, "new_share": 0.2, "min_relevance": 0.01, "spend": 1e6})


@query("frontier", f"WITH {_SCORED}, f AS (SELECT group_id, article_id, score AS relevance, round(1 - score * score, 6) AS revenue FROM sc), w AS (SELECT *, round((1 - weight) * relevance + weight * revenue, 9) AS s FROM f, (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS weight)), b AS (SELECT *, row_number() OVER (PARTITION BY weight, group_id ORDER BY s DESC, article_id) AS rk FROM w) SELECT weight, count(*) AS n, round(avg(relevance), 6) AS relevance, round(avg(revenue), 6) AS revenue FROM b WHERE rk = 1 GROUP BY 1")
def frontier(spark, d):
    rows = _scored(spark, d, ("l_orderkey",)).select("group_id", "article_id", F.col("score").alias("relevance"), F.round(1 - F.col("score") * F.col("score"), 6).alias("revenue"))
    return p.frontier(rows, (0, 0.25, 0.5, 0.75, 1))


@query("softmax_policy", f"WITH {_SCORED}, e AS (SELECT group_id, article_id, exp((score - max(score) OVER (PARTITION BY group_id)) / 0.5) AS e FROM sc) SELECT group_id, article_id, round(e / sum(e) OVER (PARTITION BY group_id), 8) AS prob FROM e")
def softmax_policy(spark, d):
    return p.softmax_policy(_scored(spark, d), ["group_id"], 0.5).select("group_id", "article_id", F.round("prob", 8).alias("prob"))


_OPE = "lg AS (SELECT CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END AS reward, 0.1 + (user_id % 5) / 10.0 AS p0, 0.1 + (event_id % 7) / 10.0 AS p1, 0.1 + (user_id % 3) / 20.0 AS ql, 0.12 + (event_id % 2) / 20.0 AS qt FROM events), wt AS (SELECT *, p1::DOUBLE / p0 AS w FROM lg)"


@query("ope_ips_dm_dr", f"WITH {_OPE} SELECT count(*) AS n, round(avg(qt), 6) AS dm, round(avg(w * reward), 6) AS ips, round(avg(qt + w * (reward - ql)), 6) AS dr, round(sum(w) * sum(w) / sum(w * w), 4) AS ess, round(max(w) / sum(w), 8) AS max_weight_share FROM wt")
def ope_ips_dm_dr(spark, d):
    e = a.table(spark, d, "events")
    return p.ope(e.select((F.col("event_type") == "purchase").cast("double").alias("reward"), (0.1 + (F.col("user_id") % 5) / 10.0).alias("p0"), (0.1 + (F.col("event_id") % 7) / 10.0).alias("p1"), (0.1 + (F.col("user_id") % 3) / 20.0).alias("q_logged"), (0.12 + (F.col("event_id") % 2) / 20.0).alias("q_target")))


_AGE = f"date_diff('day', t_dat, DATE '{AS_OF}')"


@query("recency_weights_ess", f"WITH {TX}, w AS (SELECT pow(0.5, {_AGE} / 30.0) AS w FROM tx WHERE t_dat < DATE '{AS_OF}') SELECT count(*) AS n, round(sum(w) * sum(w) / sum(w * w), 4) AS ess, round(sum(w) * sum(w) / sum(w * w) / count(*), 8) AS ess_fraction FROM w")
def recency_weights_ess(spark, d):
    tx = a.transactions(spark, d).where(F.col("t_dat") < F.lit(AS_OF).cast("date"))
    return p.ess(tx.withColumn("w", s.recency_weight(F.datediff(F.lit(AS_OF).cast("date"), F.col("t_dat")))), "w")


@query("logq", f"WITH {TX}, n AS (SELECT article_id, count(*) AS n FROM tx GROUP BY 1) SELECT article_id, round(1.0 - ln(n / sum(n) OVER ()), 6) AS corrected FROM n")
def logq(spark, d):
    n = a.transactions(spark, d).groupBy("article_id").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.join(F.broadcast(total)).select("article_id", F.round(s.logq(F.lit(1.0), F.col("n") / F.col("total")), 6).alias("corrected"))


_POISSON = " + ".join(f"CASE WHEN u >= {c} THEN 1 ELSE 0 END" for c in p.POISSON)


@query("bootstrap_ci", f"WITH b AS (SELECT event_id, value AS x, b FROM events, (SELECT unnest(range(0, 50)) AS b)), u AS (SELECT x, b, {_HASH.format('CAST(event_id AS VARCHAR) || chr(58) || CAST(b AS VARCHAR)')} / 4294967296.0 AS u FROM b), n AS (SELECT b, x, {_POISSON} AS n FROM u), m AS (SELECT b, sum(x * n) / sum(n) AS m FROM n GROUP BY b) SELECT count(*) AS replicates, round(quantile_cont(m, 0.05), 6) AS lo, round(quantile_cont(m, 0.95), 6) AS hi FROM m")
def bootstrap_ci(spark, d):
    return p.bootstrap_ci(a.table(spark, d, "events"), "event_id", "value")


@query("age_buckets", "SELECT b AS bucket, count(*) AS n FROM (SELECT CASE WHEN c_acctbal >= 7500 THEN 3 WHEN c_acctbal >= 5000 THEN 2 WHEN c_acctbal >= 2500 THEN 1 ELSE 0 END AS b FROM customer) GROUP BY 1")
def age_buckets(spark, d):
    return a.table(spark, d, "customer").groupBy(s.age_bucket(F.col("c_acctbal"), (2500, 5000, 7500)).alias("bucket")).agg(F.count("*").alias("n"))


@query("isotonic", f"""WITH {_SCORED}, ro AS (SELECT group_id, article_id, round(score, 3) AS score, label FROM sc), pt AS (SELECT score, sum(label) AS y, count(*) AS n FROM ro WHERE group_id % 2 = 0 GROUP BY 1),
cu AS (SELECT row_number() OVER w AS i, score, y, n, sum(y) OVER w AS sy, sum(n) OVER w AS sn FROM pt WINDOW w AS (ORDER BY score)),
pr AS (SELECT a.i AS a, b.i AS b, min((b.sy - a.sy + a.y) / CAST(b.sn - a.sn + a.n AS DOUBLE)) OVER (PARTITION BY a.i ORDER BY b.i DESC) AS least FROM cu a JOIN cu b ON a.i <= b.i),
fit AS (SELECT score, value, lead(score) OVER (ORDER BY score) AS score2, lead(value) OVER (ORDER BY score) AS value2 FROM (SELECT b, max(least) AS value FROM pr GROUP BY b) JOIN cu ON cu.i = b),
al AS (SELECT ro.*, CASE WHEN f.score IS NULL THEN (SELECT min(value) FROM fit) WHEN f.score2 IS NULL OR ro.score = f.score THEN f.value ELSE f.value + (f.value2 - f.value) * (ro.score - f.score) / (f.score2 - f.score) END AS c FROM ro ASOF LEFT JOIN fit f ON ro.score >= f.score)
SELECT group_id, article_id, CASE WHEN group_id % 2 = 0 THEN 'calib' ELSE 'rest' END AS fold, round(c, 6) AS calibrated FROM al""")
def isotonic(spark, d):
    """Fitted on even groups; all rows are calibrated, and ``fold`` tells which were fitted on. The SQL is the min-max formula."""
    rows = _scored(spark, d).select("group_id", "article_id", F.round("score", 3).alias("score"), "label")
    fold = F.col("group_id") % 2 == 0
    done = calibration.calibrate(rows, calibration.fit_isotonic(rows.where(fold)))
    return done.select("group_id", "article_id", F.when(fold, "calib").otherwise("rest").alias("fold"), F.round("calibrated", 6).alias("calibrated"))
