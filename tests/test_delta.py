"""Tables kept up to date by changes against clean rebuilds, and a stream's totals against the batch."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallgrass.operators import merge
from tallgrass.operators.features import daily_agg, rolling_features
from tallgrass.sources.snapshots import ConcurrentCommit, SnapshotTable
from tallgrass.streaming import delta, totals

KINDS = "t_dat date, customer_id string, article_id string, price decimal(12,2)"
EPOCH, WINDOWS = "2020-01-01", (7, 30)


def rows(spark, data):
    found = spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(d), c, a, f"{p:.2f}") for d, c, a, p in data], "t_dat date, customer_id string, article_id string, p string")
    return found.select("t_dat", "customer_id", "article_id", F.col("p").cast("decimal(12,2)").alias("price"))


def clean(spark, data, entity):
    daily = daily_agg(rows(spark, data), entity, epoch=EPOCH)
    features = rolling_features(daily, entity, ["n_txn", "spend"], WINDOWS, prefix="c")
    return daily.select(*entity, "day_index", "n_txn", F.col("spend").cast(delta.SUM).alias("spend")), delta._typed(features, entity, WINDOWS, "c")


@pytest.fixture
def tables(spark, tmp_path):
    def make(data, entity):
        daily, features = (SnapshotTable(spark, str(tmp_path / n)) for n in ("daily", "features"))
        delta.load_daily(daily, rows(spark, data), entity, EPOCH)
        delta.load_features(features, daily, entity, WINDOWS, "c")
        return daily, features

    return make


@pytest.mark.parametrize("entity", [["customer_id"], ["customer_id", "article_id"]])
def test_any_changes_equal_a_rebuild(spark, tables, entity):
    rng = random.Random(5)
    one = lambda lo=0, hi=120: (rng.randrange(lo, hi), rng.choice(["a", "b", None, "d"]), rng.choice("xy"), rng.randrange(1, 500) / 100)
    data = [one() for _ in range(150)]
    daily, features = tables(data, entity)
    for turn in range(3):
        came = [one(40, 60) for _ in range(6)] + [(50 + turn, f"new{turn}", "x", 1.0)]
        went = [data.pop(rng.randrange(len(data))) for _ in range(8)]
        day = [r for r in data if r[0] == went[0][0]]  # a whole day goes
        for r in day:
            data.remove(r)
        changes = delta.signed(rows(spark, came), rows(spark, went + day))
        data += came
        for _ in range(2):  # and once more, which changes nothing
            delta.apply_changes(changes, f"batch-{turn}", daily, features, entity, WINDOWS, "c", EPOCH)
        want = clean(spark, data, entity)
        merge.assert_identical(daily.read(), want[0])
        merge.assert_identical(features.read(), want[1])


def test_only_days_in_reach_are_written(spark, tables):
    data = [(d, c, "x", 1.0) for d in range(0, 100, 5) for c in "ab"]
    daily, features = tables(data, ["customer_id"])
    before = daily.manifest()["parts"], features.manifest()["parts"]
    opened, read = [], features.read
    features.read = lambda *a, **kw: opened.append(read(*a, **kw)) or opened[-1]
    written = delta.apply_changes(delta.signed(rows(spark, [(40, "a", "x", 2.0)])), "late", daily, features, ["customer_id"], WINDOWS, "c", EPOCH)
    assert written == {40, 45, 50, 55, 60, 65, 70}
    after = daily.manifest()["parts"], features.manifest()["parts"]
    assert {d for d in before[0] if before[0][d] != after[0][d]} == {"40"}
    assert {int(d) for d in before[1] if before[1][d] != after[1][d]} == written
    days = {int(f.split("part=")[1].split("/")[0]) for f in opened[0].inputFiles()}
    assert days == written


def test_a_job_that_died_between_the_tables_is_mended(spark, tables):
    data = [(d, "a", "x", 1.0) for d in range(10)]
    daily, features = tables(data, ["customer_id"])
    changes = delta.signed(rows(spark, [(3, "a", "x", 4.0)]))
    delta.fold_daily(daily, delta.daily_changes(changes, ["customer_id"], EPOCH), ["customer_id"], "late")
    delta.apply_changes(changes, "late", daily, features, ["customer_id"], WINDOWS, "c", EPOCH)
    want = clean(spark, data + [(3, "a", "x", 4.0)], ["customer_id"])
    merge.assert_identical(daily.read(), want[0])
    merge.assert_identical(features.read(), want[1])


def test_deleting_what_never_came_and_two_folds_at_once(spark, tables):
    daily, features = tables([(0, "a", "x", 1.0)], ["customer_id"])
    gone = delta.daily_changes(delta.signed(None, rows(spark, [(0, "a", "x", 1.0), (0, "a", "x", 1.0)])), ["customer_id"], EPOCH)
    with pytest.raises(ValueError):
        delta.fold_daily(daily, gone, ["customer_id"], "bad")
    assert daily.read().count() == 1
    came = delta.daily_changes(delta.signed(rows(spark, [(0, "a", "x", 1.0)])), ["customer_id"], EPOCH)
    other, write = SnapshotTable(spark, daily.path), daily._write

    def slow(*args):
        daily._write = write
        delta.fold_daily(other, came, ["customer_id"], "first")
        return write(*args)

    daily._write = slow
    with pytest.raises(ConcurrentCommit):
        delta.fold_daily(daily, came, ["customer_id"], "second")
    assert other.read().first()["n_txn"] == 2
    assert delta.apply_changes(delta.signed(rows(spark, [])), "none", daily, features, ["customer_id"], WINDOWS, "c", EPOCH) == set()


def test_stream_totals_are_corrected_and_state_is_bounded(spark, tmp_path):
    at = lambda day, hour=1: dt.datetime(2024, 1, 1, hour) + dt.timedelta(day)
    batches = [[(at(d), k, 1.0) for d in range(3) for k in "ab"], [(at(2), "a", 5.0), (at(20), "a", 1.0)], [(at(21), "b", 1.0), (at(15), None, 2.0)], [(at(0), "a", 100.0), (at(40), "a", 1.0)]]
    files, table = str(tmp_path / "in"), SnapshotTable(spark, str(tmp_path / "totals"))
    kinds = "ts timestamp, k string, v double"
    for data in batches:
        spark.createDataFrame(data, kinds).coalesce(1).write.mode("append").parquet(files)
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(files)
    run = totals.daily_totals(stream, "k", "v").writeStream.outputMode("update").foreachBatch(totals.totals_sink(table, "k")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = {(str(r.day), r.k): (r.n, r.total) for r in table.read().collect()}
    # day 0 came again 21 days later, after the watermark: it belongs into a late batch
    late = batches[3][0]
    want = {}
    for ts, k, v in (r for data in batches for r in data if r is not late):
        n, t = want.get((str(ts.date()), k), (0, 0.0))
        want[str(ts.date()), k] = n + 1, t + v
    assert got == want
    states = [p["stateOperators"][0] for p in run.recentProgress if p["stateOperators"]]
    assert states[-1]["numRowsTotal"] < len(want) and sum(s["numRowsDroppedByWatermark"] for s in states) == 1
    write = totals.totals_sink(table, "k")
    replay = table.read().where("day = DATE '2024-01-01'").withColumn("n", F.lit(99).cast("long"))
    write(replay, 0)
    assert {(str(r.day), r.k): (r.n, r.total) for r in table.read().collect()} == want
