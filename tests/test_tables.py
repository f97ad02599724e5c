import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallgrass import settings
from tallgrass.operators import merge
from tallgrass.sources import csv
from tallgrass.sources.snapshots import ConcurrentCommit, SnapshotTable
from tallgrass.sources.warehouse import Warehouse
from tallgrass.operators.features import build_features
from tallgrass.streaming.late import apply_late_batch, sink

HEADER = "t_dat,customer_id,article_id,price,sales_channel_id\n"


@pytest.fixture
def warehouse(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "transactions_train.csv").write_text(HEADER + "2019-06-01,a,0001,0.5,1\n2019-06-01,a,0001,0.5,1\n2019-06-02,b,0002,oops,2\n2019-06-03,c,0003,0.1,2\n")
    (raw / "customers.csv").write_text("customer_id,FN,Active,club_member_status,fashion_news_frequency,age,postal_code\na,1.0,,ACTIVE,NONE,30,x\nb,,,,,,y\n")
    w = Warehouse(spark, str(tmp_path / "wh"), str(raw))
    w.create_tables()
    w.create_tables()
    return w


def test_settings_from_environment():
    s = settings.load({"TALLGRASS_WAREHOUSE": "/w"})
    assert s.warehouse == "/w" and s.data_raw.endswith("data/raw") and s.catalog == "local"


def test_bounds_are_inclusive_and_ids_keep_zeros(spark, warehouse):
    rows = csv.read_transactions(spark, dt.date(2019, 6, 2), dt.date(2019, 6, 3), warehouse.data_raw).collect()
    assert [(r.article_id, r.price) for r in rows] == [("0002", None), ("0003", 0.1)]


def test_reordered_header_is_refused(spark, tmp_path):
    (tmp_path / "x.csv").write_text("b,a\n1,2\n")
    with pytest.raises(ValueError):
        csv.read_csv(spark, str(tmp_path / "x.csv"), "a int, b int")


def test_reload_is_idempotent_and_whole_row_diff_is_not(spark, warehouse):
    t = warehouse.table("transactions")
    day = dt.date(2019, 6, 1)
    one, two = warehouse.load_transactions(day, day), warehouse.load_transactions(day, day)
    a, b = t.read(one), t.read(two)
    merge.assert_identical(a, b)
    with pytest.raises(AssertionError):
        merge.assert_identical(a, b, ignore_cols=())
    assert [r.snapshot_id for r in t.snapshots().collect()] == t.snapshot_ids()


def test_overwrite_replaces_present_days_only(spark, warehouse):
    t = warehouse.table("transactions")
    warehouse.load_transactions()
    batch = spark.createDataFrame([(dt.date(2019, 6, 1), "z", "9", 1.0, 1)], "t_dat date, customer_id string, article_id string, price double, sales_channel_id int")
    t.overwrite_partitions(batch, fill_missing=True)
    assert {(str(r.t_dat), r.customer_id) for r in t.read().collect()} == {("2019-06-01", "z"), ("2019-06-02", "b"), ("2019-06-03", "c")}
    assert t.overwrite_partitions(batch.limit(0), fill_missing=True) is None
    assert t.read(start=dt.date(2019, 6, 2), end=dt.date(2019, 6, 2)).count() == 1
    with pytest.raises(ValueError):
        t.append(batch)


def test_evolution_is_metadata_only(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"))
    assert t.create("id int, name string") and not t.create("id int")
    t.append(spark.createDataFrame([(1, "x")], "id int, name string"))
    first = t.snapshot_ids()[-1]
    t.add_column("promo_flag", T.BooleanType())
    t.append(spark.createDataFrame([(2, "y", True)], "id int, name string, promo_flag boolean"))
    t.rename_column("name", "label")
    t.drop_column("id")
    t.add_column("id", T.IntegerType())
    t.reorder_columns(["id", "promo_flag", "label"])
    assert sorted(map(tuple, t.read().collect()), key=str) == [(None, None, "x"), (None, True, "y")]
    assert t.read(first).columns == ["id", "name"] and t.read(first).count() == 1


def _interleaved(t, during):
    """``t`` with another commit made between its reading of the manifest and its own commit."""
    write = t._write

    def slow(*args):
        t._write = write
        made = write(*args)
        during()
        return made

    t._write = slow
    return t


@pytest.mark.parametrize("change", ["append", "overwrite_partitions", "replace", "merge", "append_once", "evolve"])
def test_two_writers_lose_nothing(spark, tmp_path, change):
    path = str(tmp_path / "t")
    t, other = SnapshotTable(spark, path), SnapshotTable(spark, path)
    t.create("id int, _source_file string", None)
    row = lambda k: spark.createDataFrame([(k, f"f{k}")], "id int, _source_file string")
    t.append(row(0))
    _interleaved(t, lambda: other.append(row(2)))
    if change == "append":
        t.append(row(1))
        assert sorted(r.id for r in t.read().collect()) == [0, 1, 2]
        return
    if change == "append_once":
        _interleaved(t, lambda: other.append_once(row(1).drop("_source_file"), "late"))
        assert t.append_once(row(1).drop("_source_file"), "late") is None
        assert t.read().where("_source_file = 'late'").count() == 1
        return
    if change == "evolve":
        m = t.manifest()
        other.append(row(2))
        t.manifest = lambda *a: m
        with pytest.raises(ConcurrentCommit):
            t.add_column("x", T.IntegerType())
    else:
        with pytest.raises(ConcurrentCommit):
            t.merge(row(1), "id") if change == "merge" else getattr(t, change)(row(1))
    assert sorted(r.id for r in other.read().collect()) == [0, 2] and other.snapshot_ids() == [1, 2, 3]


def test_upsert_semantics(spark, warehouse):
    dim = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    src = spark.createDataFrame([("a", 9), ("c", 3), (None, 4)], "k string, v int")
    assert sorted(map(tuple, merge.upsert(dim, src, "k").collect()), key=str) == [("a", 9), ("b", 2), ("c", 3), (None, 4)]
    with pytest.raises(merge.CardinalityError):
        merge.upsert(dim, spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int"), "k")
    assert merge.upsert(dim, spark.createDataFrame([("z", 1), ("z", 2)], "k string, v int"), "k").count() == 4
    warehouse.load_dimension("customers")
    warehouse.load_dimension("customers")
    assert warehouse.table("customers").read().count() == 2


def test_late_batch_once_and_survives_reload(spark, warehouse):
    warehouse.load_transactions()
    t = warehouse.table("transactions")
    late = spark.createDataFrame([(dt.date(2019, 6, 1), "q", "0001", 0.7, 1)], "t_dat date, customer_id string, article_id string, price double, sales_channel_id int")
    done = apply_late_batch(t, late, "fix-1")
    assert done["range"][1] - done["range"][0] == 89 and done["fact"].count() == 4
    again = apply_late_batch(t, late, "fix-1")
    assert done["landed"] and not again["landed"] and again["range"] == done["range"] and again["fact"].count() == 4
    merge.assert_identical(t.read().where("customer_id = 'q'").select("t_dat", "article_id"), late.select("t_dat", "article_id"))
    warehouse.load_transactions(corrections={"fix-1": late})
    assert t.read().where("customer_id = 'q'").count() == 1
    write = sink(t)
    write(late, 7)
    write(late, 7)
    assert t.read().where(F.col("_source_file") == "stream-7").count() == 1


def test_partition_bounds_compare_as_the_column_does(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"))
    t.create("day int, x int", "day")
    t.append(spark.createDataFrame([(d, d) for d in (-5, 95, 950, 1000, 1005, 2000)] + [(None, 0)], "day int, x int"))
    days = lambda **kw: sorted(r.day for r in t.read(**kw).collect())
    assert days(start=900, end=1005) == [950, 1000, 1005]
    assert days(end=95) == [-5, 95] and days(start=-10, end=0) == [-5] and days(start=3000) == []
    assert days(only={95, 2000}) == [95, 2000] and days(only=set()) == []
    assert len(t.read(start=900, end=1005).inputFiles()) == 3


def test_a_manifest_is_there_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "t")
    t = SnapshotTable(spark, path)
    t.create("id int")
    t.append(spark.createDataFrame([(1,)], "id int"))
    (tmp_path / "t" / "_log" / "_dead-writer.tmp").write_text("")
    assert t.snapshot_ids() == [1, 2] and t.read().count() == 1
    seen, publish = [], t._publish

    def look(aside, final):
        seen.append((SnapshotTable(spark, path).snapshot_ids(), SnapshotTable(spark, path).read().count()))
        publish(aside, final)

    t._publish = look
    t.append(spark.createDataFrame([(2,)], "id int"))
    assert seen == [([1, 2], 1)] and t.snapshot_ids() == [1, 2, 3] and t.read().count() == 2

    def die(aside, final):
        raise KeyboardInterrupt

    t._publish = die
    with pytest.raises(KeyboardInterrupt):
        t.append(spark.createDataFrame([(3,)], "id int"))
    assert SnapshotTable(spark, path).read().count() == 2
    assert not [f for f in (tmp_path / "t" / "_log").iterdir() if f.name.endswith(".tmp") and "dead" not in f.name]


def test_a_new_batch_is_known_by_the_manifest(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"))
    t.create("id int, _source_file string")
    t.append(spark.createDataFrame([(0,)], "id int"), fill_missing=True)
    reads, read = [], t.read
    t.read = lambda *a, **kw: reads.append(1) or read(*a, **kw)
    row = spark.createDataFrame([(1,)], "id int")
    assert t.append_once(row, "a") and t.append_once(row, "b") and not reads
    assert t.append_once(row, "a") is None and reads
    t.replace(spark.createDataFrame([(0,)], "id int"), fill_missing=True)
    assert t.append_once(row, "a") is not None and read().count() == 2


def test_late_batch_is_mended_by_its_replay(spark, tmp_path):
    """The job died after the append: the replay builds and writes all three grains."""
    log = SnapshotTable(spark, str(tmp_path / "log"))
    kinds = "t_dat date, customer_id string, article_id string, price decimal(12,2), sales_channel_id int, _ingested_at timestamp, _source_file string"
    log.create(kinds, "t_dat")
    rows = lambda day, n: spark.createDataFrame([(dt.date(2019, 6, day), f"c{k % 2}", f"a{k}", 1, 1) for k in range(n)], "t_dat date, customer_id string, article_id string, price int, sales_channel_id int").withColumn("price", F.col("price").cast("decimal(12,2)"))
    log.append(rows(1, 4).unionByName(rows(5, 4)), fill_missing=True)
    types = spark.createDataFrame([(f"a{k}", f"t{k % 2}") for k in range(4)], "article_id string, product_type string")
    late = rows(3, 3)
    log.append_once(late.withColumn("_ingested_at", F.current_timestamp()), "late")
    sinks = {g: SnapshotTable(spark, str(tmp_path / g)) for g in ("customer", "article", "cross")}
    done = apply_late_batch(log, late, "late", article_type=types, sinks=sinks)
    assert not done["landed"] and sorted(done["features"]) == ["article", "cross", "customer"]
    clean = build_features(log.read(), types)
    for grain, sink_table in sinks.items():
        lo, hi = done["range"]
        merge.assert_identical(sink_table.read(), clean[grain].where(F.col("day_index").between(lo, hi)))
    assert sinks["cross"].read().where("day_index = 258").count() == 2
