"""Daily aggregates and leakage-free rolling features."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallgrass.functions.scalars import day_index, safe_ratio
from tallgrass.operators.joins import small_side
from tallgrass.operators.model import money

WINDOWS = (7, 30, 90)


def daily_agg(tx: DataFrame, entity: list[str], distinct: str | None = None, epoch: str = "2018-09-20") -> DataFrame:
    """(entity, feature_date, day_index, n_txn, spend, avg_price[, distinct count]): one shuffle."""
    extra = [F.countDistinct(distinct).alias("n_" + distinct.removesuffix("_id") + "s")] if distinct else []
    out = tx.groupBy(*entity, F.col("t_dat").alias("feature_date")).agg(F.count("*").alias("n_txn"), *extra, F.sum("price").alias("spend"), (money(F.sum("price")) / F.count("price")).alias("avg_price"))
    return out.withColumn("day_index", day_index(F.col("feature_date"), epoch))


def spine(entities: DataFrame, days: DataFrame) -> DataFrame:
    """Every (entity, day) that needs features: entities times the days listed, which go to all tasks.

    The result is as large as that product by definition; list the days to serve, not a history.
    """
    return entities.distinct().crossJoin(F.broadcast(days.distinct()))


def rolling_features(daily: DataFrame, partition_cols: list[str], measures: list[str], windows=WINDOWS, spine_rows: DataFrame | None = None, prefix: str = "f") -> DataFrame:
    """Sums over the days [d - w, d - 1] by value, so gaps count and the day itself does not.

    With a spine, days without a row get one (sums zero) and history off the spine still
    counts: outer join first, window, then the spine's rows. All windows share one
    exchange and one sort.
    """
    keys = [*partition_cols, "day_index"]
    rows = daily.select(*keys, *measures)
    if spine_rows is not None:
        rows = rows.join(spine_rows.select(*keys).distinct().withColumn("__wanted", F.lit(True)), keys, "full")
    order = Window.partitionBy(*partition_cols).orderBy("day_index")
    sums = {f"{prefix}_{m}_{w}d": F.coalesce(F.sum(m).over(order.rangeBetween(-w, -1)), F.lit(0)) for m in measures for w in windows}
    out = rows.withColumns(sums)
    if spine_rows is not None:
        out = out.where("__wanted")
    return out.select(*keys, *sums)


def gap_rows(daily: DataFrame, partition_cols: list[str], measure: str, width: int = 7) -> DataFrame:
    """Sums by value range and by row count side by side where they differ; the second is wrong with gaps."""
    order = Window.partitionBy(*partition_cols).orderBy("day_index")
    by_range = F.coalesce(F.sum(measure).over(order.rangeBetween(-width, -1)), F.lit(0))
    by_rows = F.coalesce(F.sum(measure).over(order.rowsBetween(-width, -1)), F.lit(0))
    return daily.select(*partition_cols, "day_index", by_range.alias("by_range"), by_rows.alias("by_rows")).where("by_range <> by_rows")


def split_bounds(max_day: dt.date) -> dict[str, tuple[dt.date | None, dt.date]]:
    """Six disjoint slices by distance from the last day; train is open to the left."""
    # Last-day offsets of the slices.
    offsets = {"train": (None, 42), "val_tune": (41, 28), "val_calib": (27, 21), "ope_env": (20, 14), "test": (13, 7), "holdout": (6, 0)}
    back = lambda n: None if n is None else max_day - dt.timedelta(n)
    return {k: (back(a), back(b)) for k, (a, b) in offsets.items()}


def slice_of(day: "F.Column", max_day: dt.date) -> "F.Column":
    out = F.lit(None).cast("string")
    for name, (start, end) in split_bounds(max_day).items():
        inside = day <= F.lit(end)
        out = F.when(inside if start is None else inside & (day >= F.lit(start)), name).otherwise(out)
    return out


def invalidated_days(a: int, b: int, max_window: int = 90) -> tuple[int, int]:
    """Feature days to build again after data of days [a, b] changed."""
    return a + 1, b + max_window


def build_features(tx: DataFrame, article_type: DataFrame | None = None, start: int | None = None, end: int | None = None, epoch: str = "2018-09-20", windows=WINDOWS) -> dict[str, DataFrame]:
    """Customer, article and cross features of feature days [start, end]; build and backfill alike.

    Reads [start - max(windows), end] and returns [start, end]: windows are never cut off.
    """
    day = day_index(F.col("t_dat"), epoch)
    if start is not None:
        tx = tx.where(day >= start - max(windows))
    if end is not None:
        tx = tx.where(day <= end)
    grains = {"customer": (["customer_id"], tx), "article": (["article_id"], tx)}
    if article_type is not None:
        grains["cross"] = (["customer_id", "product_type"], tx.join(article_type, "article_id"))
    out = {}
    for name, (entity, rows) in grains.items():
        f = rolling_features(daily_agg(rows, entity, epoch=epoch), entity, ["n_txn", "spend"], windows, prefix=name[:4])
        if start is not None:
            f = f.where(F.col("day_index") >= start)
        out[name] = f if end is None else f.where(F.col("day_index") <= end)
    return out


def write_features(table, features: DataFrame, day: str = "day_index") -> int | None:
    """Features into a table by day: every day that the frame has rows for is replaced whole, so a backfill can run again."""
    table.create(features.schema, day)
    return table.overwrite_partitions(features)


def relative_price(tx: DataFrame, days: int = 90, epoch: str = "2018-09-20") -> DataFrame:
    """Each transaction's price over the customer's average price in the ``days`` days before; null without such a day."""
    past = rolling_features(daily_agg(tx, ["customer_id"], epoch=epoch), ["customer_id"], ["n_txn", "spend"], (days,), prefix="past")
    past = past.select("customer_id", "day_index", (money(F.col(f"past_spend_{days}d")) / F.nullif(F.col(f"past_n_txn_{days}d"), F.lit(0))).alias("past_price"))
    return tx.withColumn("day_index", day_index(F.col("t_dat"), epoch)).join(past, ["customer_id", "day_index"]).withColumn("relative_price", safe_ratio(money(F.col("price")), F.col("past_price")))


def candidate_features(cands: DataFrame, article_type: DataFrame, customer: DataFrame, article: DataFrame, cross: DataFrame) -> DataFrame:
    """Candidates (customer, article, day_index) with the features of their own day: plain equi joins, zeros where there is no history.

    Correctness lies in the features' frames, which end the day before; the article side is
    sent to all tasks if it is small enough.
    """
    out = cands.join(small_side(article_type.select("article_id", "product_type")), "article_id")
    for keys, features in ((["customer_id", "day_index"], customer), (["article_id", "day_index"], small_side(article)), (["customer_id", "product_type", "day_index"], cross)):
        measures = [c for c in features.columns if c not in keys]
        out = out.join(features, keys, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in measures})
    return out


def coverage(cohort: DataFrame, features: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Share of a cohort's rows that find a feature."""
    return cohort.join(features.select(*keys, column), keys, "left").agg(F.count("*").alias("n"), F.round(F.avg(F.col(column).isNotNull().cast("double")), 8).alias("coverage"))
