"""Elasticity, budgeted discounts, guardrails and off-policy evaluation."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.functions.scalars import hash_bucket, hash_uniform, price_response
from tallgrass.operators.model import money
from tallgrass.operators.prefix import running_total
from tallgrass.sources.scratch import Table

#: The discount menu.
MENU = (0.0, 0.1, 0.2, 0.3)


def article_week_panel(tx: DataFrame) -> DataFrame:
    return tx.groupBy("article_id", F.date_trunc("week", "t_dat").cast("date").alias("week")).agg((money(F.sum("price")) / F.count("*")).alias("mean_price"), F.count("*").alias("units"))


def elasticity(panel: DataFrame) -> DataFrame:
    """Slope of log units on log price within articles that vary; article effects by demeaning."""
    w = Window.partitionBy("article_id")
    x, y = F.log("mean_price"), F.log("units")
    d = panel.where("mean_price > 0").select((x - F.avg(x).over(w)).alias("x"), (y - F.avg(y).over(w)).alias("y"))
    return d.agg(F.count("*").alias("n"), F.round(F.sum(F.col("x") * F.col("y")) / F.sum(F.col("x") * F.col("x")), 6).alias("elasticity"))


#: Weeks of a year, as ISO numbers them.
WEEKS = 53


def elasticity_with_weeks(panel: DataFrame) -> DataFrame:
    """The same slope with an effect for every article and every week of the year.

    Least squares needs the cross moments of price, units and the 53 week indicators about the
    articles' means only. These follow from each article's sums by week, one shuffle of the
    panel; each task adds them up to one matrix of 55 by 55, and the driver solves the sum.
    """
    d = panel.where("mean_price > 0").select("article_id", F.log("mean_price").alias("x"), F.log("units").alias("y"), F.weekofyear("week").alias("woy"))
    weekly = d.groupBy("article_id", "woy").agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("x") * F.col("y")).alias("xy"))
    weekly = weekly.select("article_id", "woy", F.col("n").cast("double").alias("n"), "x", "y", "xx", "xy")
    own = weekly.groupBy("article_id").agg(F.collect_list(F.struct("woy", "n", "x", "y", "xx", "xy")).alias("w")).select("w")  # 53 at most
    size = WEEKS + 2

    def moments(batches):
        total = np.zeros((size, size))
        for batch in batches:
            for article in batch.column(0):
                w = np.array([list(r.values()) for r in article.as_py()])
                at, n = 1 + w[:, 0].astype(int), w[:, 1]
                sums = np.zeros(size)
                sums[0], sums[1], sums[at] = w[:, 2].sum(), w[:, 3].sum(), n
                total[0, 0] += w[:, 4].sum()
                total[0, 1] += w[:, 5].sum()
                total[0, at] += w[:, 2]
                total[1, at] += w[:, 3]
                total[at, at] += n
                total -= np.triu(np.outer(sums, sums)) / n.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["row", "part"])

    parts = own.mapInArrow(moments, "row int, part array<double>")
    m = np.zeros((size, size))
    for r in parts.groupBy("row").agg(vector_to_array(Summarizer.sum(array_to_vector("part"))).alias("sum")).collect():
        m[r.row] = r.sum
    m = np.triu(m) + np.triu(m, 1).T
    use = np.array([0, *range(2, size)])
    slope = np.linalg.lstsq(m[np.ix_(use, use)], m[use, 1], rcond=1e-11)[0][0] if m[0, 0] > 0 else None
    return d.agg(F.count("*").alias("n"), F.round(F.lit(None if slope is None else float(slope)).cast("double"), 6).alias("elasticity"))


def offers(base: DataFrame, eps: float, menu=MENU) -> DataFrame:
    """(id, discount, p, revenue, spend) of each menu step of each (id, p0, price) row."""
    d = base.withColumn("discount", F.explode(F.array(*map(F.lit, menu))))
    p = price_response(F.col("p0"), F.col("discount"), eps)
    return d.select("id", "discount", p.alias("p"), (p * F.col("price") * (1 - F.col("discount"))).alias("revenue"), (p * F.col("price") * F.col("discount")).alias("spend"))


def _hull(points):
    """The vertices of the upper hull of (spend, revenue), spend rising: from each the steepest rise, of equal ones the farthest.

    ``points`` is an array column of (spend, revenue, discount), one id's menu.
    """
    first = F.array_sort(points, lambda a, b: F.when(a["spend"] != b["spend"], F.signum(a["spend"] - b["spend"])).when(a["revenue"] != b["revenue"], F.signum(b["revenue"] - a["revenue"])).otherwise(F.signum(a["discount"] - b["discount"])).cast("int"))
    rise = lambda at, p: (p["revenue"] - at["revenue"]) / (p["spend"] - at["spend"])

    def follow(found, _):
        at = F.element_at(found, -1)
        ahead = F.filter(first, lambda p: (p["spend"] > at["spend"]) & (p["revenue"] > at["revenue"]))
        best = F.array_max(F.transform(ahead, lambda p: F.struct(rise(at, p).alias("rise"), p["spend"].alias("spend"), (-p["discount"]).alias("back"), p.alias("p"))))
        return F.when(F.size(ahead) == 0, found).otherwise(F.concat(found, F.array(best["p"])))

    return F.aggregate(first, F.slice(first, 1, 1), follow)


def discount_steps(offer: DataFrame) -> DataFrame:
    """(id, discount, gain, cost, step, ratio): what each step along the upper hull of an id's menu adds in revenue and spend.

    Choices below the hull are left out, as some mix of two others gives more for the same
    spend; so each step is taken over the choice that it replaces, ratios fall along a
    menu, and the steps of an id are taken in order. Rows whose spend or revenue is
    null or not finite are no choice. A menu is gathered per id, and has to be as short as menus are.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    menu = offer.where(finite("spend") & finite("revenue")).groupBy("id").agg(F.collect_list(F.struct(*(F.col(c).cast("double").alias(c) for c in ("spend", "revenue", "discount")))).alias("menu"))
    hull = menu.select("id", _hull(F.col("menu")).alias("hull"))
    pairs = F.zip_with(F.slice("hull", F.lit(1), F.size("hull") - 1), F.slice("hull", F.lit(2), F.size("hull") - 1), lambda a, b: F.struct(b["discount"].alias("discount"), F.round(b["revenue"] - a["revenue"], 6).alias("gain"), F.round(b["spend"] - a["spend"], 6).alias("cost")))
    steps = hull.where(F.size("hull") > 1).select("id", F.posexplode(pairs).alias("step", "s")).select("id", "s.*", "step").where((F.col("gain") > 0) & (F.col("cost") > 0))
    return steps.withColumn("ratio", F.round(F.col("gain") / F.col("cost"), 6))


def _taken(offer: DataFrame) -> DataFrame:
    """The steps with ``spent``, the spend up to each, in the order of their ratios; an id's steps keep theirs where rounded ratios are equal."""
    order = [F.desc("ratio"), F.asc("id"), F.asc("step")]
    spent = running_total(discount_steps(offer), order, F.col("cost").cast("decimal(20,6)"), "spent")
    return spent.withColumn("spent", F.col("spent").cast("double"))


def allocate_greedy(offer: DataFrame, budget: float) -> DataFrame:
    """Discount steps by marginal revenue per unit of spend until the budget is reached; a prefix, nothing skipped."""
    return _taken(offer).where(F.col("spent") <= budget).select("id", "discount", "gain", "cost", "spent")


def allocation_bound(offer: DataFrame, budget: float) -> DataFrame:
    """The greedy allocation beside its linear program: gain and spend of the prefix, and the optimum with a fractional last step.

    Ratios fall along each id's hull, so the relaxed program takes steps in the order of
    their ratios too, and the part of the first step beyond the budget that still fits.
    """
    spent = _taken(offer)
    inside = F.col("spent") <= budget
    part = F.greatest(F.lit(0.0), F.least(F.col("cost"), budget - (F.col("spent") - F.col("cost"))))
    return spent.agg(
        F.count(F.when(inside, 1)).alias("n_steps"), F.round(F.sum(F.when(inside, F.col("gain").cast("decimal(20,6)"))).cast("double"), 4).alias("greedy_gain"),
        F.round(F.sum(F.when(inside, F.col("cost").cast("decimal(20,6)"))).cast("double"), 4).alias("greedy_spend"),
        F.round(F.sum(F.col("gain") * part / F.col("cost")), 4).alias("lp_gain"),
    )


def dual_price(offer: DataFrame, budget: float, prices: int = 64, passes: int = 9) -> float:
    """The price of a unit of spend at which the ids, each taking its best choice for it, stay within the budget.

    Each pass sums the spend at ``prices`` prices in one aggregate over the steps and narrows
    the interval between the last price above the budget and the first within it; what
    reaches the driver is one row. No step is sorted.
    """
    steps = Table(discount_steps(offer).select("gain", "cost"), "steps")
    ratio, high = F.col("gain") / F.col("cost"), 0.0
    try:
        top = steps.df.agg(F.max(ratio), F.sum("cost")).first()
        if top[0] is None or top[1] <= budget:
            return 0.0
        low, high = 0.0, float(top[0])
        for _ in range(passes):
            tried = [low + (high - low) * k / (prices + 1) for k in range(1, prices + 1)]
            spend = steps.df.agg(*(F.coalesce(F.sum(F.when(ratio > p, F.col("cost"))), F.lit(0.0)) for p in tried)).first()
            fits = next((k for k, x in enumerate(spend) if x <= budget), prices)
            low, high = tried[fits - 1] if fits else low, tried[fits] if fits < prices else high
    finally:
        steps.drop()
    return high


def dual_bound(offer: DataFrame, budget: float) -> DataFrame:
    """Greedy gain, relaxed optimum and dual bound over the choice of each id that costs least, in rising order.

    The dual bound is taken on the whole menus, not on hulls: budget times the price, plus for
    every id the most of revenue less price times spend. No allocation within the budget gains more.
    """
    price = dual_price(offer, budget)
    rows = offer.where(F.col("spend").isNotNull() & F.col("revenue").isNotNull())
    base = F.min(F.struct(F.col("spend").cast("double").alias("spend"), (-F.col("revenue")).cast("double").alias("revenue")))
    each = rows.groupBy("id").agg(F.max(F.col("revenue") - price * F.col("spend")).alias("best"), base.alias("base"))
    gain = F.col("best") + F.col("base.revenue") + price * F.col("base.spend")
    dual = each.agg(F.round(F.coalesce(F.sum(gain), F.lit(0.0)) + price * budget, 4).alias("dual_gain"))
    return allocation_bound(offer, budget).join(F.broadcast(dual))


def guardrails(decisions: DataFrame, catalog: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Catalog coverage, share of new articles, lowest segment relevance, discount spend, each against its threshold."""
    total = catalog.agg(F.count("*").alias("n_catalog"))
    main = decisions.agg(F.countDistinct("article_id").alias("shown"), F.avg(F.col("is_new").cast("double")).alias("new_share"), money(F.sum("spend")).alias("spend"))
    seg = decisions.groupBy("segment").agg(F.avg("relevance").alias("r")).agg(F.min("r").alias("min_relevance"))
    one = main.join(F.broadcast(total)).join(F.broadcast(seg)).select((F.col("shown") / F.col("n_catalog")).alias("coverage"), "new_share", "min_relevance", "spend")
    rows = F.array(*(F.struct(F.lit(k).alias("metric"), F.round(F.col(k), 6).alias("value"), (F.col(k) <= v if k == "spend" else F.col(k) >= v).alias("ok")) for k, v in thresholds.items()))
    return one.select(F.explode(rows).alias("r")).select("r.metric", "r.value", "r.ok")


def frontier(df: DataFrame, weights, k: int = 1) -> DataFrame:
    """Mean relevance and revenue of each group's best item as the weight of price grows.

    Rows are dealt by group once and ranked there for one weight after the other; only the k
    best of a weight become a row of it.
    """
    chosen = []
    for i, x in enumerate(map(float, weights)):
        score = F.round((1 - F.lit(x)) * F.col("relevance") + F.lit(x) * F.col("revenue"), 9)
        df = df.withColumn(f"__rank_{i}", F.row_number().over(Window.partitionBy("group_id").orderBy(score.desc(), "article_id")))
        chosen.append(F.when(F.col(f"__rank_{i}") <= k, F.lit(x)))
    best = df.select("relevance", "revenue", F.explode(F.array_compact(F.array(*chosen))).alias("weight"))
    return best.groupBy("weight").agg(F.count("*").alias("n"), F.round(F.avg("relevance"), 6).alias("relevance"), F.round(F.avg("revenue"), 6).alias("revenue"))


def softmax_policy(scores: DataFrame, by: list[str], tau: float) -> DataFrame:
    w = Window.partitionBy(*by)
    e = F.exp((F.col("score") - F.max("score").over(w)) / tau)
    return scores.withColumn("__e", e).withColumn("prob", F.col("__e") / F.sum("__e").over(w)).drop("__e")


def sample_policy(policy: DataFrame, by: list[str], item: str = "article_id") -> DataFrame:
    """One item per decision by inverse CDF at a uniform number hashed from the decision."""
    w = Window.partitionBy(*by).orderBy(item)
    hi = F.sum("prob").over(w.rowsBetween(Window.unboundedPreceding, 0))
    u = hash_uniform(F.concat_ws(":", *(F.col(c).cast("string") for c in by)))
    last = F.lead(item).over(w).isNull()
    drawn = policy.withColumns({"__hi": hi, "__u": u, "__last": last}).where((F.col("__u") < F.col("__hi")) & (F.col("__u") >= F.col("__hi") - F.col("prob")) | (F.col("__last") & (F.col("__u") >= F.col("__hi"))))
    return drawn.drop("__hi", "__u", "__last")


def fit_reward_model(logged: DataFrame, context: list[str], action: str, prior: float = 10.0, slice_col: str = "slice") -> DataFrame:
    """(context, action, q): mean reward, drawn to the mean over contexts by ``prior`` pseudo-rows; from the ``ope_env`` slice only."""
    own = logged.where(F.col(slice_col) == "ope_env")
    total = own.groupBy(action).agg((F.sum("reward") / F.count("*")).alias("overall"))
    each = own.groupBy(*context, action).agg(F.sum("reward").alias("r"), F.count("*").alias("n"))
    return each.join(total, action).select(*context, action, ((F.col("r") + prior * F.col("overall")) / (F.col("n") + prior)).alias("q"))


def ope(logged: DataFrame) -> DataFrame:
    """Direct, IPS and doubly robust values, effective sample size and largest weight share.

    Rows: reward, logging propensity p0, target probability p1 of the logged action,
    q_logged the modelled reward of that action, q_target its mean under the target.
    """
    w = F.col("p1") / F.col("p0")
    d = logged.withColumn("w", w)
    return d.agg(
        F.count("*").alias("n"), F.round(F.avg("q_target"), 6).alias("dm"), F.round(F.avg(F.col("w") * F.col("reward")), 6).alias("ips"),
        F.round(F.avg(F.col("q_target") + F.col("w") * (F.col("reward") - F.col("q_logged"))), 6).alias("dr"),
        F.round(F.sum("w") * F.sum("w") / F.sum(F.col("w") * F.col("w")), 4).alias("ess"), F.round(F.max("w") / F.sum("w"), 8).alias("max_weight_share"),
    )


def ess(df: DataFrame, weight: str) -> DataFrame:
    w = F.col(weight)
    return df.agg(F.count("*").alias("n"), F.round(F.sum(w) * F.sum(w) / F.sum(w * w), 4).alias("ess"), F.round(F.sum(w) * F.sum(w) / F.sum(w * w) / F.count("*"), 8).alias("ess_fraction"))


# Cumulative Poisson(1) probabilities.
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676)


def bootstrap_ci(df: DataFrame, key: str, value: str, replicates: int = 50, level: float = 0.9) -> DataFrame:
    """Percentile interval of the mean; each row counts Poisson(1) times in a replicate, by hash, without a resample."""
    b = df.select(F.col(key).alias("k"), F.col(value).cast("double").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("b"))
    u = hash_bucket(F.concat_ws(":", F.col("k").cast("string"), F.col("b").cast("string"))) / F.lit(4294967296.0)
    n = reduce(lambda a, c: a + F.when(F.col("u") >= c, 1).otherwise(0), POISSON, F.lit(0))
    means = b.withColumn("u", u).withColumn("n", n).groupBy("b").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("m"))
    lo, hi = (1 - level) / 2, (1 + level) / 2
    return means.agg(F.count("*").alias("replicates"), F.round(F.percentile("m", F.lit(lo)), 6).alias("lo"), F.round(F.percentile("m", F.lit(hi)), 6).alias("hi"))
