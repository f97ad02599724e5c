"""Snapshot tables, raw loads, marts and late data, each over tables written to the shared folder."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallgrass.operators import features as f
from tallgrass.operators import merge as g
from tallgrass.operators import model as m
from tallgrass.plans.common import ART, EPOCH, EV, EVENT_EPOCH, TX, day
from tallgrass.plans.model_queries import _DIM, _SRC, _changed, _dim
from tallgrass.sources import adapter as a
from tallgrass.sources import csv, marts, schemas
from tallgrass.sources.scratch import shared_dir
from tallgrass.sources.snapshots import SnapshotTable
from tallgrass.sources.warehouse import Warehouse
from tallgrass.streaming import delta, late, totals

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def _path(spark) -> str:
    return f"{shared_dir(spark)}/warehouse/{uuid.uuid4().hex}"


def _event_log(spark, d) -> tuple[SnapshotTable, object]:
    """An empty table of event transactions by day, and the rows to load."""
    tx = a.event_transactions(spark, d).withColumn("_source_file", F.lit("base"))
    table = SnapshotTable(spark, _path(spark))
    table.create(tx.schema, "t_dat")
    return table, tx


_BY_DAY = "SELECT t_dat, count(*) AS n, CAST(sum(price) AS DOUBLE) AS revenue FROM tx"


def _by_day(df):
    return df.groupBy("t_dat").agg(F.count("*").alias("n"), m.money(F.sum("price")).alias("revenue"))


@query("snapshot_time_travel", f"WITH {EV} {_BY_DAY} WHERE t_dat < DATE '2024-01-10' GROUP BY t_dat")
def snapshot_time_travel(spark, d):
    """The table as it was before its second half came and a day was replaced."""
    table, tx = _event_log(spark, d)
    first = table.append(tx.where("t_dat < DATE '2024-01-10'"))
    table.append(tx.where("t_dat >= DATE '2024-01-10'"))
    table.overwrite_partitions(tx.where("t_dat = DATE '2024-01-05'").limit(1))
    return _by_day(table.read(first))


@query("snapshot_day_overwrite", f"WITH {EV}, b AS (SELECT * FROM tx WHERE t_dat IN (DATE '2024-01-05', DATE '2024-01-06') AND article_id = 'click') SELECT t_dat, article_id, count(*) AS n FROM (SELECT * FROM tx WHERE t_dat NOT IN (SELECT t_dat FROM b) UNION ALL SELECT * FROM b) GROUP BY ALL")
def snapshot_day_overwrite(spark, d):
    table, tx = _event_log(spark, d)
    table.append(tx)
    table.overwrite_partitions(tx.where("t_dat IN (DATE '2024-01-05', DATE '2024-01-06') AND article_id = 'click'"))
    return table.read().groupBy("t_dat", "article_id").agg(F.count("*").alias("n"))


@query("snapshot_partition_bounds", f"WITH {EV} {_BY_DAY} WHERE t_dat BETWEEN DATE '2024-01-08' AND DATE '2024-01-11' GROUP BY t_dat")
def snapshot_partition_bounds(spark, d):
    """Bounds choose files by the manifest; days outside are not opened."""
    table, tx = _event_log(spark, d)
    table.append(tx)
    return _by_day(table.read(start=dt.date(2024, 1, 8), end=dt.date(2024, 1, 11)))


@query("snapshot_merge", f"WITH t AS ({_DIM}), s AS ({_SRC}) SELECT id, segment, CAST(balance AS DOUBLE) AS balance FROM t WHERE id NOT IN (SELECT id FROM s) UNION ALL SELECT id, segment, CAST(balance AS DOUBLE) FROM s")
def snapshot_merge(spark, d):
    dim = _dim(spark, d)
    table = SnapshotTable(spark, _path(spark))
    table.create(dim.schema)
    table.replace(dim)
    table.merge(_changed(dim), "id")
    return table.read().withColumn("balance", F.col("balance").cast("double"))


@query("snapshot_evolution", f"WITH t AS ({_DIM}) SELECT CAST(NULL AS BOOLEAN) AS promo_flag, id, segment AS market FROM t UNION ALL SELECT true, id + 1000000, lower(segment) FROM t WHERE id % 10 = 0")
def snapshot_evolution(spark, d):
    """Columns added, renamed, dropped and reordered between two loads; files are not touched."""
    dim = _dim(spark, d)
    table = SnapshotTable(spark, _path(spark))
    table.create(dim.schema)
    table.append(dim)
    table.add_column("promo_flag", T.BooleanType())
    table.rename_column("segment", "market")
    table.drop_column("balance")
    table.append(dim.where("id % 10 = 0").select((F.col("id") + 1_000_000).alias("id"), F.lower("segment").alias("market"), F.lit(True).alias("promo_flag")))
    table.reorder_columns(["promo_flag", "id", "market"])
    return table.read()


@query("snapshot_log", "SELECT * FROM (VALUES (1::BIGINT, 'create', NULL::BIGINT), (2, 'append', 1), (3, 'add column', 2), (4, 'overwrite partitions', 3), (5, 'replace', 4)) t(snapshot_id, operation, parent)")
def snapshot_log(spark, d):
    table, tx = _event_log(spark, d)
    table.append(tx)
    table.add_column("note", T.StringType())
    table.overwrite_partitions(tx.where("t_dat = DATE '2024-01-05'"), fill_missing=True)
    table.replace(tx.where("t_dat = DATE '2024-01-06'"), fill_missing=True)
    return table.snapshots().select("snapshot_id", "operation", "parent")


@query("snapshot_sizes", f"""WITH {EV}, d AS (SELECT t_dat, count(*) AS n, sum(price) AS s FROM tx GROUP BY 1), b AS (SELECT t_dat, count(*) AS n, sum(price) AS s FROM tx WHERE article_id = 'click' AND t_dat IN (DATE '2024-01-05', DATE '2024-01-06') GROUP BY 1),
st AS (SELECT 1 AS id, 'create' AS operation, 0 AS n, 0 AS s UNION ALL SELECT 2, 'append', sum(n), sum(s) FROM d WHERE t_dat < DATE '2024-01-10' UNION ALL SELECT 3, 'append', sum(n), sum(s) FROM d
UNION ALL SELECT 4, 'overwrite partitions', (SELECT sum(n) FROM d WHERE t_dat NOT IN (SELECT t_dat FROM b)) + coalesce((SELECT sum(n) FROM b), 0), (SELECT sum(s) FROM d WHERE t_dat NOT IN (SELECT t_dat FROM b)) + coalesce((SELECT sum(s) FROM b), 0))
SELECT CAST(id AS BIGINT) AS snapshot_id, operation, CAST(n AS BIGINT) AS n, CAST(s AS DOUBLE) AS revenue FROM st""")
def snapshot_sizes(spark, d):
    """Every snapshot of a table's history, with the rows and the revenue that a reader of it sees."""
    table, tx = _event_log(spark, d)
    table.append(tx.where("t_dat < DATE '2024-01-10'"))
    table.append(tx.where("t_dat >= DATE '2024-01-10'"))
    table.overwrite_partitions(tx.where("t_dat IN (DATE '2024-01-05', DATE '2024-01-06') AND article_id = 'click'"))
    seen = None
    for k in table.snapshot_ids():
        row = table.read(k).agg(F.count("*").alias("n"), F.coalesce(m.money(F.sum("price")), F.lit(0.0)).alias("revenue")).withColumn("snapshot_id", F.lit(k).cast("long"))
        seen = row if seen is None else seen.unionByName(row)
    return table.snapshots().select("snapshot_id", "operation").join(seen, "snapshot_id")


@query("snapshot_describe", "SELECT * FROM (VALUES (0, 'id', 'bigint'), (1, 'segment', 'string'), (2, 'balance', 'decimal(12,2)')) t(pos, name, kind)")
def snapshot_describe(spark, d):
    table = SnapshotTable(spark, _path(spark))
    table.create(_dim(spark, d).schema)
    return spark.createDataFrame([(k, c.name, c.dataType.simpleString()) for k, c in enumerate(table.schema())], "pos int, name string, kind string")


_LATE = "t_dat = DATE '2024-01-12' AND customer_id % 2 = 0"


@query("snapshot_guarded_append", f"WITH {EV} SELECT CASE WHEN {_LATE} THEN 'late' ELSE 'base' END AS source, count(*) AS n, CAST(sum(price) AS DOUBLE) AS revenue FROM tx GROUP BY 1")
def snapshot_guarded_append(spark, d):
    """A correction batch offered twice lands once."""
    table, tx = _event_log(spark, d)
    table.append(tx.where(f"NOT ({_LATE})"))
    for _ in range(2):
        table.append_once(tx.where(_LATE).drop("_source_file"), "late")
    return table.read().groupBy(F.col("_source_file").alias("source")).agg(F.count("*").alias("n"), m.money(F.sum("price")).alias("revenue"))


def _windows(keys: str, measure: str, widths, prefix: str) -> str:
    return ", ".join(f"CAST(coalesce(sum({measure}) OVER (PARTITION BY {keys} ORDER BY day_index RANGE BETWEEN {w} PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS {prefix}_{measure}_{w}d" for w in widths)


@query("late_batch_features", f"WITH {EV}, x AS (SELECT customer_id, {day(EVENT_EPOCH)} AS day_index, count(*) AS n_txn FROM tx GROUP BY ALL), r AS (SELECT customer_id, day_index, {_windows('customer_id', 'n_txn', (7, 30), 'cust')} FROM x) SELECT * FROM r WHERE day_index BETWEEN 12 AND 101")
def late_batch_features(spark, d):
    """Half a day arrives late: the days that it made stale are built again from the whole log."""
    table, tx = _event_log(spark, d)
    table.add_column("_ingested_at", T.TimestampType())
    table.append(tx.where(f"NOT ({_LATE})"), fill_missing=True)
    done = late.apply_late_batch(table, tx.where(_LATE).drop("_source_file"), "late", EVENT_EPOCH)
    return done["features"]["customer"].select("customer_id", "day_index", "cust_n_txn_7d", "cust_n_txn_30d")


@query("late_batch_fact", f"WITH {EV} SELECT customer_id, article_id, t_dat, sales_channel_id, count(*) AS qty, CAST(sum(price) AS DOUBLE) AS revenue FROM tx GROUP BY ALL")
def late_batch_fact(spark, d):
    table, tx = _event_log(spark, d)
    table.add_column("_ingested_at", T.TimestampType())
    table.append(tx.where(f"NOT ({_LATE})"), fill_missing=True)
    batch = tx.where(_LATE).drop("_source_file")
    fact = late.apply_late_batch(table, batch, "late", EVENT_EPOCH)["fact"]
    late.apply_late_batch(table, batch, "late", EVENT_EPOCH)
    return fact.select("customer_id", "article_id", "t_dat", "sales_channel_id", "qty", "revenue")


@query("late_batch_cross", f"WITH {TX}, {ART}, x AS (SELECT customer_id, product_type, {day(EPOCH)} AS day_index, count(*) AS n_txn FROM tx JOIN art USING (article_id) GROUP BY ALL), r AS (SELECT customer_id, product_type, day_index, {_windows('customer_id, product_type', 'n_txn', (30, 90), 'cros')} FROM x) SELECT * FROM r WHERE day_index BETWEEN 2002 AND 2091")
def late_batch_cross(spark, d):
    """A third of a day arrives late, twice; the cross features of the days it made stale are read from their table."""
    tx = a.transactions(spark, d).withColumn("_source_file", F.lit(None).cast("string"))
    table = SnapshotTable(spark, _path(spark))
    table.create(tx.schema)
    table.add_column("_ingested_at", T.TimestampType())
    late_rows = (f.day_index(F.col("t_dat"), EPOCH) == 2001) & (F.col("customer_id") % 3 == 0)
    table.append(tx.where(~late_rows).drop("_source_file"), fill_missing=True)
    sinks = {"cross": SnapshotTable(spark, _path(spark))}
    for _ in range(2):
        late.apply_late_batch(table, tx.where(late_rows).drop("_source_file"), "late", EPOCH, a.articles(spark, d).select("article_id", "product_type"), sinks)
    return sinks["cross"].read(start=2002, end=2091).select("customer_id", "product_type", "day_index", "cros_n_txn_30d", "cros_n_txn_90d")


@query("reload_with_corrections", f"WITH {EV} SELECT t_dat, CASE WHEN {_LATE} THEN 'fix-1' ELSE 'base' END AS source, count(*) AS n FROM tx WHERE t_dat BETWEEN DATE '2024-01-11' AND DATE '2024-01-13' GROUP BY ALL")
def reload_with_corrections(spark, d):
    """Days loaded again from their whole source: the base rows and every correction of those days."""
    table, tx = _event_log(spark, d)
    base, fix = tx.where(f"NOT ({_LATE})").drop("_source_file"), tx.where(_LATE).drop("_source_file")
    table.append(csv.day_source(base, {}))
    table.append_once(fix, "fix-1")
    days = dt.date(2024, 1, 11), dt.date(2024, 1, 13)
    table.overwrite_partitions(csv.day_source(csv.between(base, "t_dat", *days), {"fix-1": csv.between(fix, "t_dat", *days)}))
    return table.read(start=days[0], end=days[1]).groupBy("t_dat", F.col("_source_file").alias("source")).agg(F.count("*").alias("n"))


@query("stream_sink_replay", f"WITH {EV} {_BY_DAY} GROUP BY t_dat")
def stream_sink_replay(spark, d):
    """The event file as a stream, twice from its beginning into one sink: each micro-batch lands once."""
    table, tx = _event_log(spark, d)
    source = a.table(spark, d, "events")
    for _ in range(2):
        rows = spark.readStream.schema(source.schema).parquet(f"{d}/events*.parquet").select(*(F.col(c) for c in source.columns))
        rows = rows.select(F.to_date("ts").alias("t_dat"), F.col("user_id").alias("customer_id"), F.col("event_type").alias("article_id"), F.col("value").cast(a.MONEY).alias("price"), F.lit(1).alias("sales_channel_id"))
        run = rows.writeStream.foreachBatch(late.sink(table, "events")).option("checkpointLocation", _path(spark)).trigger(availableNow=True).start()
        run.awaitTermination()
    return _by_day(table.read())


#: What the log comes to: late rows, a day of prices corrected, and rows taken back.
_FIXED = "customer_id % 10 = 3 AND t_dat = DATE '2024-01-09'"
_GONE = "customer_id % 10 = 4 AND t_dat = DATE '2024-01-15'"
_FINAL = f"{EV}, fin AS (SELECT t_dat, customer_id, article_id, CASE WHEN {_FIXED} THEN price + 1 ELSE price END AS price FROM tx WHERE NOT ({_GONE}))"


def _maintained(spark, d):
    """Daily aggregates and features of a first load, then brought up to date by two batches of changes, the second one replayed."""
    tx = a.event_transactions(spark, d)
    daily, features = (SnapshotTable(spark, _path(spark)) for _ in range(2))
    delta.load_daily(daily, tx.where(f"NOT ({_LATE})"), ["customer_id"], EVENT_EPOCH)
    delta.load_features(features, daily, ["customer_id"], (7, 30), "cust")
    fixed = tx.where(_FIXED)
    late_rows, corrected = delta.signed(tx.where(_LATE), tx.where(_GONE)), delta.signed(fixed.withColumn("price", (F.col("price") + 1).cast(a.MONEY)), fixed)
    for batch_id, changes in (("late", late_rows), ("fix", corrected), ("fix", corrected)):
        delta.apply_changes(changes, batch_id, daily, features, ["customer_id"], (7, 30), "cust", EVENT_EPOCH)
    return daily, features


@query("delta_daily", f"WITH {_FINAL} SELECT customer_id, {day(EVENT_EPOCH)} AS day_index, count(*) AS n_txn, CAST(sum(price) AS DOUBLE) AS spend FROM fin GROUP BY ALL")
def delta_daily(spark, d):
    """Daily aggregates after late rows, corrections and deletions, folded in as signed changes."""
    return _maintained(spark, d)[0].read().withColumn("spend", F.col("spend").cast("double"))


@query("delta_features", f"""WITH {_FINAL}, x AS (SELECT customer_id, {day(EVENT_EPOCH)} AS day_index, count(*) AS n_txn, sum(price) AS spend FROM fin GROUP BY ALL)
SELECT customer_id, day_index, {_windows('customer_id', 'n_txn', (7, 30), 'cust')}, {", ".join(f"CAST(coalesce(sum(spend) OVER (PARTITION BY customer_id ORDER BY day_index RANGE BETWEEN {w} PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS cust_spend_{w}d" for w in (7, 30))} FROM x""")
def delta_features(spark, d):
    """Rolling features after the same changes: only the days in reach are written again."""
    rows = _maintained(spark, d)[1].read()
    return rows.withColumns({c: F.col(c).cast("double") for c in rows.columns if "spend" in c})


@query("stream_daily_totals", "SELECT CAST(ts AS DATE) AS t_dat, event_type AS article_id, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS revenue FROM events GROUP BY ALL")
def stream_daily_totals(spark, d):
    """The events as they arrive, up to three days late, in six micro-batches: totals kept in event time."""
    e = a.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.col("value").cast(a.MONEY).alias("value"), "event_id")
    arrival = F.datediff(F.to_date("ts"), F.lit(EVENT_EPOCH).cast("date")) + F.pmod(F.xxhash64("event_id"), F.lit(4))
    files, table = _path(spark), SnapshotTable(spark, _path(spark))
    e = e.withColumn("turn", F.least(F.floor(arrival / 6), F.lit(5)))
    for turn in range(6):
        e.where(F.col("turn") == turn).drop("turn").coalesce(1).write.mode("append").parquet(files)
    rows = spark.readStream.schema(e.drop("turn").schema).option("maxFilesPerTrigger", 1).parquet(files)
    run = totals.daily_totals(rows, "event_type", "value").writeStream.outputMode("update").foreachBatch(totals.totals_sink(table, "event_type")).option("checkpointLocation", _path(spark)).trigger(availableNow=True).start()
    run.awaitTermination()
    return table.read().select(F.col("day").alias("t_dat"), F.col("event_type").alias("article_id"), "n", m.money(F.col("total")).alias("revenue"))


@query("feature_sink", f"WITH {TX}, x AS (SELECT customer_id, {day(EPOCH)} AS day_index, count(*) AS n_txn FROM tx GROUP BY ALL), r AS (SELECT customer_id, day_index, {_windows('customer_id', 'n_txn', (7, 90), 'cust')} FROM x) SELECT * FROM r WHERE day_index BETWEEN 2000 AND 2030")
def feature_sink(spark, d):
    """A month of features written by day, ten of its days written again, read back."""
    table = SnapshotTable(spark, _path(spark))
    for days in ((2000, 2030), (2010, 2019)):
        built = f.build_features(a.transactions(spark, d), start=days[0], end=days[1], epoch=EPOCH, windows=(7, 90))["customer"]
        f.write_features(table, built)
    return table.read().select("customer_id", "day_index", "cust_n_txn_7d", "cust_n_txn_90d")


@query("feature_sink_bounds", f"WITH {TX}, x AS (SELECT customer_id, {day(EPOCH)} AS day_index, count(*) AS n_txn FROM tx GROUP BY ALL), r AS (SELECT customer_id, day_index, {_windows('customer_id', 'n_txn', (7, 90), 'cust')} FROM x) SELECT * FROM r WHERE day_index BETWEEN 990 AND 1005")
def feature_sink_bounds(spark, d):
    """Days of three and four digits from a table by day number: bounds compare as numbers."""
    table = SnapshotTable(spark, _path(spark))
    f.write_features(table, f.build_features(a.transactions(spark, d), start=980, end=1020, epoch=EPOCH, windows=(7, 90))["customer"])
    return table.read(start=990, end=1005).select("customer_id", "day_index", "cust_n_txn_7d", "cust_n_txn_90d")


@query("backfill_article", f"WITH {TX}, x AS (SELECT article_id, {day(EPOCH)} AS day_index, count(*) AS n_txn FROM tx GROUP BY ALL), r AS (SELECT article_id, day_index, {_windows('article_id', 'n_txn', (30,), 'arti')} FROM x) SELECT * FROM r WHERE day_index BETWEEN 2000 AND 2030")
def backfill_article(spark, d):
    return f.build_features(a.transactions(spark, d), start=2000, end=2030, epoch=EPOCH, windows=(30,))["article"].select("article_id", "day_index", "arti_n_txn_30d")


@query("backfill_cross", f"WITH {TX}, {ART}, x AS (SELECT customer_id, product_type, {day(EPOCH)} AS day_index, count(*) AS n_txn FROM tx JOIN art USING (article_id) GROUP BY ALL), r AS (SELECT customer_id, product_type, day_index, {_windows('customer_id, product_type', 'n_txn', (90,), 'cros')} FROM x) SELECT * FROM r WHERE day_index BETWEEN 2000 AND 2030")
def backfill_cross(spark, d):
    types = a.articles(spark, d).select("article_id", "product_type")
    return f.build_features(a.transactions(spark, d), types, start=2000, end=2030, epoch=EPOCH, windows=(90,))["cross"].select("customer_id", "product_type", "day_index", "cros_n_txn_90d")


def _raw_files(spark, d) -> str:
    """The driver's tables written as the raw files, in their declared columns."""
    path = _path(spark)
    ident = lambda c: F.lpad(F.col(c).cast("string"), 10, "0")
    known = {
        "transactions": a.transactions(spark, d).withColumns({"customer_id": ident("customer_id"), "article_id": ident("article_id")}),
        "customers": a.table(spark, d, "customer").select(ident("c_custkey").alias("customer_id"), F.when(F.col("c_custkey") % 2 == 1, 1.0).alias("FN"), F.col("c_mktsegment").alias("club_member_status"), (20 + F.col("c_custkey") % 60).alias("age"), F.col("c_nationkey").alias("postal_code")),
        "articles": a.table(spark, d, "part").select(ident("p_partkey").alias("article_id"), F.col("p_name").alias("prod_name"), F.col("p_size").alias("product_type_no"), F.col("p_type").alias("product_type_name"), F.col("p_brand").alias("section_name")),
    }
    for name, df in known.items():
        declared = T.StructType.fromDDL(schemas.DECLARED[name])
        full = df.select(*((F.col(c.name) if c.name in df.columns else F.lit(None)).cast(c.dataType).alias(c.name) for c in declared))
        full.write.option("header", True).csv(f"{path}/{schemas.FILES[name]}")
    return path


def _warehouse(spark, d, dimensions=("customers", "articles"), transactions: bool = True) -> Warehouse:
    """A warehouse with the tables that one query needs: raw files read by their declared schemas; a month and the dimensions loaded a second time."""
    w = Warehouse(spark, _path(spark), _raw_files(spark, d))
    w.create_tables()
    if transactions:
        w.load_transactions()
        w.create_tables()
        w.load_transactions(dt.date(2000, 1, 1), dt.date(2000, 1, 31))
    for name in dimensions * 2:
        w.load_dimension(name)
    return w


@query("mart_fact", f"WITH {TX} SELECT lpad(CAST(customer_id AS VARCHAR), 10, '0') AS customer_id, lpad(CAST(article_id AS VARCHAR), 10, '0') AS article_id, t_dat, CAST(sales_channel_id AS INTEGER) AS sales_channel_id, count(*) AS qty, CAST(sum(price) AS DOUBLE) AS revenue FROM tx GROUP BY ALL")
def mart_fact(spark, d):
    """Raw files, raw tables, staging views, fact: a month loaded twice, there once."""
    fact = marts.build_marts(_warehouse(spark, d, ()), ("fact_transaction",))["fact_transaction"].read()
    return fact.select("customer_id", "article_id", "t_dat", "sales_channel_id", "qty", m.money(F.col("revenue")).alias("revenue"))


@query("mart_dims", "SELECT 'article' AS dim, lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS id, p_name AS label, p_type AS detail FROM part UNION ALL SELECT 'customer', lpad(CAST(c_custkey AS VARCHAR), 10, '0'), c_mktsegment, CAST(20 + c_custkey % 60 AS VARCHAR) FROM customer")
def mart_dims(spark, d):
    built = marts.build_marts(_warehouse(spark, d, transactions=False), ("dim_article", "dim_customer"))
    articles = built["dim_article"].read().select(F.lit("article").alias("dim"), F.col("article_id").alias("id"), F.col("prod_name").alias("label"), F.col("product_type").alias("detail"))
    customers = built["dim_customer"].read().select(F.lit("customer"), "customer_id", "club_member_status", F.col("age").cast("string"))
    return articles.union(customers)


@query("staging_view_sql", f"WITH {TX} SELECT sales_channel_id, count(DISTINCT customer_id) AS n_customers, count(*) AS n FROM (SELECT CAST(sales_channel_id AS INTEGER) AS sales_channel_id, customer_id FROM tx) GROUP BY 1")
def staging_view_sql(spark, d):
    """SQL text over the registered staging view."""
    marts.staging(_warehouse(spark, d, ()))
    return spark.sql("SELECT sales_channel_id, count(DISTINCT customer_id) AS n_customers, count(*) AS n FROM stg_transactions GROUP BY sales_channel_id")


@query("row_set_diff", f"WITH {EV}, p AS (SELECT DISTINCT customer_id, article_id, t_dat FROM tx), q AS (SELECT DISTINCT customer_id, article_id, t_dat FROM tx WHERE customer_id % 7 <> 0) SELECT 'a' AS side, * FROM (SELECT * FROM p EXCEPT SELECT * FROM q) UNION ALL SELECT 'b', * FROM (SELECT * FROM q EXCEPT SELECT * FROM p)")
def row_set_diff(spark, d):
    """Key existence alone, on the business columns of a log with metadata."""
    tx = a.event_transactions(spark, d).withColumn("_ingested_at", F.current_timestamp())
    keys = [c for c in g.business_columns(tx) if c not in ("price", "sales_channel_id")]
    return g.row_set_diff(tx, tx.where("customer_id % 7 <> 0"), keys).select("side", "customer_id", "article_id", "t_dat")
