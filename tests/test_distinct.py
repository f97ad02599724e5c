import datetime as dt

import pytest

from tallgrass.operators.distinct import rolling_distinct


def _brute_distinct(rows, entity, member, wanted, windows):
    seen = {}
    for r in rows:
        seen.setdefault(tuple(r[c] for c in entity), set()).add((r["day"], r[member]))
    return sorted((*e, d, *(len({m for day, m in seen.get(e, ()) if d - w <= day <= d - 1 and m is not None}) for w in windows)) for *e, d in {(*x,) for x in wanted} for e in [tuple(e)])


@pytest.mark.parametrize("entity", [["customer_id"], ["customer_id", "kind"]])
def test_rolling_distinct_equals_sets(spark, entity):
    import random

    rng = random.Random(7)
    rows = [{"customer_id": rng.choice("abc"), "kind": rng.choice("xy"), "article_id": rng.choice([1, 2, 3, 4, None]), "day": rng.choice([0, 1, 2, 3, 9, 10, 30, 31, 37, 38, 60, 100])} for _ in range(150)]
    rows += [{"customer_id": "hot", "kind": "x", "article_id": 1, "day": d} for d in range(0, 40)]
    tx = spark.createDataFrame([(r["customer_id"], r["kind"], r["article_id"], dt.date(2020, 1, 1) + dt.timedelta(r["day"])) for r in rows], "customer_id string, kind string, article_id int, t_dat date")
    windows = (1, 7, 30)
    got = rolling_distinct(tx, entity, "article_id", windows, epoch="2020-01-01")
    assert got.columns == [*entity, "day_index", "f_n_articles_1d", "f_n_articles_7d", "f_n_articles_30d"]
    assert sorted(map(tuple, got.collect())) == _brute_distinct(rows, entity, "article_id", {(*(r[c] for c in entity), r["day"]) for r in rows}, windows)


def test_rolling_distinct_on_a_spine(spark):
    rows = [{"customer_id": c, "article_id": a, "day": d} for c, a, d in (("a", 1, 0), ("a", 1, 3), ("a", 2, 3), ("a", 1, 12), ("b", 5, 50))]
    tx = spark.createDataFrame([(r["customer_id"], r["article_id"], dt.date(2020, 1, 1) + dt.timedelta(r["day"])) for r in rows], "customer_id string, article_id int, t_dat date")
    spine = [(c, d) for c in ("a", "b", "new") for d in (-3, 0, 1, 4, 5, 9, 10, 11, 19, 20, 51, 200)]
    got = rolling_distinct(tx, ["customer_id"], "article_id", (7,), spark.createDataFrame(spine, "customer_id string, day_index int"), epoch="2020-01-01")
    assert sorted(map(tuple, got.collect())) == _brute_distinct(rows, ["customer_id"], "article_id", set(spine), (7,))
    assert rolling_distinct(tx.limit(0), ["customer_id"], "article_id").count() == 0


def test_rolling_distinct_shuffles_the_log_once(spark):
    tx = spark.createDataFrame([("a", 1, dt.date(2020, 1, 1))], "customer_id string, article_id int, t_dat date")
    plan = rolling_distinct(tx, ["customer_id"], "article_id")._jdf.queryExecution().sparkPlan().toString()
    physical = rolling_distinct(tx, ["customer_id"], "article_id")._jdf.queryExecution().executedPlan().toString()
    assert physical.split("== Initial Plan ==")[-1].count("Exchange") == 1 and "Union" not in plan
