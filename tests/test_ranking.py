import numpy as np
import pytest
from pyspark.sql import functions as F

from tallgrass.functions import scalars as s
from tallgrass.operators import decision, ranking, retrieval
from tallgrass.operators.prefix import running_total


def test_recall_by_hand(spark):
    cands = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 20, 1), (3, 30, 1)], "customer_id int, article_id int, rank int")
    truth = spark.createDataFrame([(1, 11), (1, 12), (2, 20), (4, 1)], "customer_id int, article_id int")
    r = retrieval.recall_at_k(cands, truth, 2).first()
    assert (r.hits, r.n_true, r.recall) == (2, 4, 0.5)
    assert retrieval.recall_at_k(cands, truth, 1).first().hits == 1


def test_vector_topk_returns_exact_ids(spark):
    items = spark.createDataFrame([(100 + i, [float(i == j) for j in range(5)]) for i in range(5)], "item_id long, v array<double>")
    got = retrieval.vector_topk(items.select(F.col("item_id").alias("q_id"), "v"), items, 1).collect()
    assert {(r.q_id, r.item_id) for r in got} == {(100 + i, 100 + i) for i in range(5)}


def test_vector_topk_by_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    v = rng.integers(-2, 3, (60, 4)).astype(float)  # many ties
    items = spark.createDataFrame([(200 - i, x.tolist()) for i, x in enumerate(v)], "item_id long, v array<double>")
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.integers(-2, 3, (23, 4)).astype(float))], "q_id long, v array<double>")
    monkeypatch.setattr(retrieval, "QUERY_ROWS", 5)
    monkeypatch.setattr(retrieval, "ITEM_ROWS", 7)
    got = {(r.q_id, r["rank"]): (r.item_id, r.score) for r in retrieval.vector_topk(queries, items, 9).collect()}
    for q in queries.collect():
        best = sorted(((-float(np.dot(q.v, x)), 200 - i) for i, x in enumerate(v)))[:9]
        assert [got[(q.q_id, k + 1)] for k in range(9)] == [(i, -s) for s, i in best]
    assert len(got) == 23 * 9
    assert retrieval.vector_topk(queries.limit(0), items, 3).count() == 0 and retrieval.vector_topk(queries, items.limit(0), 3).count() == 0


def test_vector_topk_reads_the_items_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_ROWS", 5)
    monkeypatch.setattr(retrieval, "PAIRS", 1)
    v = np.random.default_rng(3).normal(size=(40, 3))
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item_id long, v array<double>")
    plan = retrieval.vector_topk(items.withColumnRenamed("item_id", "q_id"), items, 4)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan and "Window" not in plan  # no copy of the items a block of queries, no second top-k


def test_nearest_tells_scores_apart_that_single_precision_does_not():
    rng = np.random.default_rng(4)
    v, q = np.full((900, 8), 30.0), np.full((3, 8), 40.0)
    v[:, 0] += rng.permutation(900) * 2.0**-20  # scores differ by 4e-5 of 9,600
    v[500:520] = v[499]
    found = retrieval.Nearest(np.arange(3), q, 7)
    for part in np.array_split(rng.permutation(900), 4):
        found.meet(part, v[part])
    want = sorted((-round(float(40 * x.sum()), 6), i) for i, x in enumerate(v))[:7]
    _, item, score, rank = found.rows()
    assert item.reshape(3, 7).tolist() == [[i for _, i in want]] * 3 and score[:7].tolist() == [-s for s, _ in want] and rank[:7].tolist() == list(range(1, 8))


def test_running_total_of_one_hot_key_and_of_distinct_ones(spark):
    df = spark.createDataFrame([(1.0, k, k % 5) for k in range(300)], "ratio double, id int, cost int")
    got = {r.id: r.t for r in running_total(df, [F.desc("ratio"), F.asc("id")], F.col("cost"), "t").collect()}
    assert got == dict(enumerate(np.cumsum([k % 5 for k in range(300)]).tolist()))
    assert running_total(df.limit(0), [F.asc("id")], F.col("cost"), "t").count() == 0


def test_auc_of_distinct_scores(spark):
    rng = np.random.default_rng(1)
    y, x = rng.integers(0, 2, 500), rng.random(500)
    want = (x[y == 1][:, None] > x[y == 0]).mean()
    got = ranking.auc(spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "score double, label int")).first()
    assert got.auc == pytest.approx(want, abs=1e-8)


def test_contributions(spark):
    a = spark.createDataFrame([(1, 1), (1, 2)], "customer_id int, article_id int")
    b = spark.createDataFrame([(1, 2), (1, 3)], "customer_id int, article_id int")
    c = retrieval.source_contributions(retrieval.union_candidates(a=a, b=b), spark.createDataFrame([(1, 2), (1, 3)], "customer_id int, article_id int"))
    got = {r.source: (r.n_cands, r.n_alone, r.solo_hits, r.marginal_hits) for r in c.collect()}
    assert got == {"a": (2, 1, 1, 0), "b": (2, 1, 2, 1)}
    assert [r.source for r in retrieval.keep_sources(c, "b").collect()] == ["b"]


def test_metrics_closed_form(spark):
    df = spark.createDataFrame([(1, 1, 0.9, 1), (1, 2, 0.8, 0), (1, 3, 0.7, 1)], "g int, article_id int, score double, label int")
    assert ranking.map_at_k(df, ["g"]).first()["map"] == round((1 + 2 / 3) / 2, 6)
    assert ranking.ndcg_at_k(df, ["g"]).first().ndcg == round((1 + 0.5) / (1 + 1 / 1.584962500721156), 6)
    assert ranking.auc(df).first().auc == 0.5


def test_ope_closed_form(spark):
    df = spark.createDataFrame([(1.0, 0.5, 1.0, 0.5, 0.6), (0.0, 0.5, 0.0, 0.5, 0.6)], "reward double, p0 double, p1 double, q_logged double, q_target double")
    r = decision.ope(df).first()
    assert (r.dm, r.ips, r.dr, r.ess, r.max_weight_share) == (0.6, 1.0, 1.1, 1.0, 1.0)


def test_policy_sums_to_one_and_draws_one(spark):
    df = spark.createDataFrame([(g, a, float(a)) for g in range(20) for a in range(3)], "g int, article_id int, score double")
    pol = decision.softmax_policy(df, ["g"], 1.0)
    assert all(abs(r.s - 1) < 1e-9 for r in pol.groupBy("g").agg(F.sum("prob").alias("s")).collect())
    assert decision.sample_policy(pol, ["g"]).groupBy("g").count().where("count <> 1").isEmpty()


def test_greedy_is_a_prefix(spark):
    base = spark.createDataFrame([(1, 0.2, 10.0), (2, 0.3, 20.0)], "id int, p0 double, price double")
    rows = decision.allocate_greedy(decision.offers(base, -3.0), 2.0).collect()
    assert rows and max(r.spent for r in rows) <= 2.0


def test_slices_must_not_overlap(spark):
    df = spark.createDataFrame([(1, 0.0, 0)], "k int, x double, label int")
    with pytest.raises(ValueError):
        ranking.fit_ranker(df, df, ["x"], ["k"])


def test_scalars(spark):
    r = spark.range(1).select(s.elkan(F.lit(0.5), 0.1).alias("e"), s.price_response(F.lit(0.9), F.lit(0.5), -2.0).alias("p"), s.age_bucket(F.lit(35)).alias("a"), s.l2_norm(F.array(F.lit(3.0), F.lit(4.0))).alias("n")).first()
    assert (round(r.e, 6), r.p, r.a, r.n) == (round(0.5 / 5.5, 6), 1.0, 2, 5.0)


def test_oracles_on_small_tables(spark):
    import glob
    import os

    import duckdb

    from tallgrass.plans import registry

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    queries, sql = registry.queries(), registry.oracle_sql()
    for name in ("pit_customer_rolling", "fact_grain_events", "covisit_candidates", "source_marginals", "greedy_allocation", "upsert_dim", "replay_guard"):
        df = queries[name](spark, sf)
        cols = sorted(df.columns)
        text = lambda rows: sorted(tuple(str(x) for x in r) for r in rows)
        assert text(df.select(*cols).collect()) == text(con.sql(f"SELECT {', '.join(cols)} FROM ({sql[name]})").fetchall()), name


def test_frontier_deals_each_row_once(spark):
    rows = [(g, x, round((g * 7 + x * 13) % 10 / 10, 4), round((g * 3 + x * 5) % 4 / 4, 4)) for g in range(30) for x in range(6)]
    df = spark.createDataFrame(rows, "group_id long, article_id long, relevance double, revenue double")
    for k in (1, 2):
        got = decision.frontier(df, (0, 0.5, 1), k)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("hashpartitioning(group_id") == 1 and plan.count("hashpartitioning(") == 2
        for r in got.collect():
            best = [y for g in range(30) for y in sorted((x for x in rows if x[0] == g), key=lambda x: (-round((1 - r.weight) * x[2] + r.weight * x[3], 9), x[1]))[:k]]
            assert r.n == len(best) and abs(r.relevance - sum(x[2] for x in best) / len(best)) < 1e-6 and abs(r.revenue - sum(x[3] for x in best) / len(best)) < 1e-6


def test_a_single_depth_is_not_judged(spark, monkeypatch):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    def judged(*_):
        raise AssertionError("nothing to choose from")

    monkeypatch.setattr(BinaryClassificationEvaluator, "evaluate", judged)
    df = spark.createDataFrame([(i, float(i % 5), int(i % 5 > 2)) for i in range(60)], "k long, x double, label int")
    model = ranking.fit_ranker(df.where("k % 2 = 0"), df.where("k % 2 = 1"), ["x"], ["k"], depths=(2,))
    assert {(r.label, r.prediction) for r in model.transform(df).collect()} == {(0, 0.0), (1, 1.0)}


def test_metrics_of_all_folds_in_one_pass(spark):
    rows = [(f, 10 * i + g, a, (a * 7 + g) % 5 / 5, int((a + g + i) % 3 == 0)) for i, f in enumerate(("a", "b", "c")) for g in range(4) for a in range(9)]
    df = spark.createDataFrame(rows, "fold string, customer_id long, article_id long, score double, label int")
    for metric in (lambda x, **more: ranking.ndcg_at_k(x, ["customer_id"], 3, **more), lambda x, **more: ranking.ece(x, **more)):
        each = {f: tuple(metric(df.where(F.col("fold") == f)).first()) for f in ("a", "b", "c")}
        assert {r[0]: tuple(r[1:]) for r in metric(df, within=("fold",)).collect()} == each
