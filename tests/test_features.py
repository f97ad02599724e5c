import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallgrass.operators import features as f
from tallgrass.operators import model

EPOCH = "2018-09-20"


def tx(spark, rows):
    base = dt.date(2018, 9, 20)
    data = [(base + dt.timedelta(d), c, a, p, 1) for c, a, d, p in rows]
    return spark.createDataFrame(data, "t_dat date, customer_id string, article_id string, price double, sales_channel_id int").withColumn("price", F.col("price").cast("decimal(12,2)"))


def rolled(spark, rows, **kw):
    daily = f.daily_agg(tx(spark, rows), ["customer_id"], epoch=EPOCH)
    return {(r.customer_id, r.day_index): r.f_n_txn_7d for r in f.rolling_features(daily, ["customer_id"], ["n_txn"], (7,), **kw).collect()}


def test_window_excludes_same_day(spark):
    assert rolled(spark, [("a", "x", 10, 1.0), ("a", "x", 11, 1.0)]) == {("a", 10): 0, ("a", 11): 1}


def test_range_not_rows(spark):
    rows = [("a", "x", 10, 1.0), ("a", "x", 11, 1.0), ("a", "y", 11, 1.0), ("a", "x", 30, 1.0)]
    assert rolled(spark, rows)[("a", 30)] == 0
    daily = f.daily_agg(tx(spark, rows), ["customer_id"], epoch=EPOCH)
    assert [(r.by_range, r.by_rows) for r in f.gap_rows(daily, ["customer_id"], "n_txn").collect()] == [(0, 3)]


def test_spine_fills_zero_and_keeps_history(spark):
    days = spark.createDataFrame([(12,), (50,)], "day_index int")
    ids = spark.createDataFrame([("a",), ("b",)], "customer_id string")
    got = rolled(spark, [("a", "x", 10, 1.0)], spine_rows=f.spine(ids, days))
    assert got == {("a", 12): 1, ("a", 50): 0, ("b", 12): 0, ("b", 50): 0}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from("xy"), st.integers(0, 60), st.just(1.0)), min_size=1, max_size=12), st.integers(0, 60))
def test_future_does_not_change_the_past(spark, rows, cut):
    full, past = rolled(spark, rows), rolled(spark, [r for r in rows if r[2] <= cut] or rows[:0]) if any(r[2] <= cut for r in rows) else {}
    assert {k: v for k, v in full.items() if k[1] <= cut} == past


def test_backfill_equals_build(spark):
    rows = [(c, a, d, 1.5) for c in "ab" for a in "xy" for d in range(0, 200, 3)]
    full = f.build_features(tx(spark, rows))["customer"].where("day_index BETWEEN 120 AND 150")
    part = f.build_features(tx(spark, rows), start=120, end=150)["customer"]
    assert sorted(map(tuple, full.collect())) == sorted(map(tuple, part.collect()))
    assert f.invalidated_days(5, 9) == (6, 99)


def test_windows_share_one_exchange(spark):
    daily = spark.createDataFrame([("a", 1, 1)], "customer_id string, day_index int, n_txn long")
    plan = f.rolling_features(daily, ["customer_id"], ["n_txn"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_splits_are_disjoint(spark):
    last = dt.date(2020, 9, 22)
    b = f.split_bounds(last)
    assert b["train"] == (None, dt.date(2020, 8, 11)) and b["holdout"] == (dt.date(2020, 9, 16), last)
    assert sum((e - s).days + 1 for s, e in b.values() if s) == 42


def test_fact_grain_and_checks(spark):
    t = tx(spark, [("a", "x", 1, 1.0), ("a", "x", 1, 2.0), ("b", "y", 2, 5.0)])
    fact = {r.customer_id: (r.qty, r.revenue, r.price_avg) for r in model.fact_transaction(t).collect()}
    assert fact == {"a": (2, 3.0, 1.5), "b": (1, 5.0, 5.0)}
    assert model.check_unique(model.fact_transaction(t), model.GRAIN).isEmpty()
    assert model.check_relationship(t, spark.createDataFrame([("x",)], "article_id string"), "article_id").collect()[0].n == 1
    assert model.check_units(t, 2).count() == 1
