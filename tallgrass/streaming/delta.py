"""Daily aggregates and rolling features kept up to date by signed changes, equal to a clean rebuild.

A change is a row with ``sign`` +1 (it came) or -1 (it went); a correction is one of each. Sums are
exact decimals, so adding the changes gives what counting everything again would. Only days
that a change reaches are read and written: its own in the aggregates, and those up to the
longest window later in the features. A commit names the batch, so that a batch folds once,
and starts from the snapshot it read, so that of two folds at once the second fails.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.functions.scalars import EPOCH, day_index
from tallgrass.operators.features import WINDOWS, rolling_features
from tallgrass.operators.joins import small_side
from tallgrass.sources.snapshots import SnapshotTable

#: Exact sums of a day, an entity and a window.
SUM = "decimal(30,2)"


def signed(inserted: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """Rows that came and rows that went as changes."""
    parts = [df.withColumn("sign", F.lit(s)) for df, s in ((inserted, 1), (deleted, -1)) if df is not None]
    return reduce(DataFrame.unionByName, parts)


def daily_changes(changes: DataFrame, entity: list[str], epoch: str = EPOCH) -> DataFrame:
    """(entity..., day_index, n_txn, spend): what the changes add to each day; days that they leave as they were are left out."""
    rows = changes.groupBy(*entity, day_index(F.col("t_dat"), epoch).alias("day_index")).agg(F.sum("sign").cast("long").alias("n_txn"), F.coalesce(F.sum(F.col("sign") * F.col("price")), F.lit(0)).cast(SUM).alias("spend"))
    return rows.where("day_index IS NOT NULL AND (n_txn <> 0 OR spend <> 0)")


def load_daily(table: SnapshotTable, tx: DataFrame, entity: list[str], epoch: str = EPOCH) -> int | None:
    """A first load of the daily aggregates into a table by day."""
    rows = daily_changes(tx.withColumn("sign", F.lit(1)), entity, epoch)
    table.create(rows.schema, "day_index")
    return table.overwrite_partitions(rows)


def _days(df: DataFrame, column: str = "day_index") -> set[int]:
    """The days that a frame has rows for: as many as the calendar has, not as the data."""
    return {r[0] for r in df.select(column).distinct().collect()}


def fold_daily(table: SnapshotTable, delta: DataFrame, entity: list[str], batch_id: str) -> bool:
    """Adds a batch's daily changes to the aggregates, once; False if it was there. Reads and writes the changed days alone.

    A day of an entity that comes to no rows is left out; one that comes to fewer than none means
    that something was deleted which had not come, and fails before anything is written.
    """
    m = table.manifest()
    if table.has_batch(batch_id, m):
        return False
    days = _days(delta)
    keys = [*entity, "day_index"]
    old = table.read(m["snapshot_id"], only=days)
    new = old.unionByName(delta).groupBy(*keys).agg(F.sum("n_txn").alias("n_txn"), F.sum("spend").cast(SUM).alias("spend"))
    if not new.where("n_txn < 0").isEmpty():
        raise ValueError(f"batch {batch_id} deletes rows that are not there")
    table.overwrite_partitions(new.where("n_txn > 0"), emptied=days, base=m, batch_id=batch_id)
    return True


def load_features(table: SnapshotTable, daily: SnapshotTable, entity: list[str], windows=WINDOWS, prefix: str = "f") -> int | None:
    """A first build of the rolling features into a table by day."""
    rows = _typed(rolling_features(daily.read(), entity, ["n_txn", "spend"], windows, prefix=prefix), entity, windows, prefix)
    table.create(rows.schema, "day_index")
    return table.overwrite_partitions(rows)


def _names(windows, prefix: str) -> list[tuple[str, str, int]]:
    return [(f"{prefix}_{m}_{w}d", m, w) for m in ("n_txn", "spend") for w in windows]


def _typed(df: DataFrame, entity: list[str], windows, prefix: str) -> DataFrame:
    return df.select(*entity, "day_index", *(F.col(c).cast("long" if m == "n_txn" else SUM).alias(c) for c, m, _ in _names(windows, prefix)))


def _window_sums(rows: DataFrame, daily: DataFrame, entity: list[str], windows, prefix: str) -> DataFrame:
    """(entity..., day_index, sums) of ``daily`` over the windows before each of ``rows``: an equi join on the entity with a range of days."""
    a, b = rows.select(*entity, "day_index").alias("a"), daily.alias("b")
    gap = F.col("a.day_index") - F.col("b.day_index")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in entity]
    met = a.join(b, [*same, gap.between(1, max(windows))], "left")
    sums = [F.coalesce(F.sum(F.when(gap <= w, F.col(f"b.{m}"))), F.lit(0)).alias(c) for c, m, w in _names(windows, prefix)]
    found = met.groupBy(*(F.col(f"a.{k}").alias(k) for k in entity), F.col("a.day_index").alias("day_index")).agg(*sums)
    return _typed(found, entity, windows, prefix)


def fold_features(table: SnapshotTable, daily: SnapshotTable, delta: DataFrame, entity: list[str], batch_id: str, windows=WINDOWS, prefix: str = "f") -> set[int]:
    """Brings the features of the days that a batch reached up to date, once; the days that were written.

    ``daily`` has the batch already and ``delta`` is what it added. A row that was there gets the
    sums of the changes in its windows added; a row of a day on which the entity is new
    is summed from its own days; a row of a day that went is left out.
    """
    m = table.manifest()
    changed = _days(delta)
    if table.has_batch(batch_id, m) or not changed:
        return set()
    first, last = min(changed), max(changed)
    keys = [*entity, "day_index"]
    names = [c for c, _, _ in _names(windows, prefix)]
    delta = small_side(delta)
    old = table.read(m["snapshot_id"], start=first, end=last + max(windows))
    # what is in reach: rows of the changed entities within a window after a change, and those of the changed days
    gap = F.col("o.day_index") - F.col("d.day_index")
    entity_same = [F.col(f"o.{k}").eqNullSafe(F.col(f"d.{k}")) for k in entity]
    reached = _days(old.select(*keys).alias("o").join(delta.alias("d"), [*entity_same, gap.between(1, max(windows))], "left_semi")) | changed
    old = old.where(F.col("day_index").isin(*sorted(reached)))
    present = daily.read(only=changed).select(*keys)
    on_changed = F.col("day_index").isin(*sorted(changed))
    stays = old.where(~on_changed).unionByName(old.where(on_changed).alias("s").join(present.alias("p"), [F.col(f"s.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys], "left_semi"))
    added = _window_sums(stays, delta, entity, windows, "__add")
    moved = stays.alias("s").join(added.alias("t"), [F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]).select(*(F.col(f"s.{k}").alias(k) for k in keys), *((F.col(c) + F.col(c.replace(prefix, "__add", 1))).alias(c) for c in names))
    fresh = present.alias("p").join(old.alias("s"), [F.col(f"s.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys], "left_anti")
    history = daily.read(start=first - max(windows), end=last)
    made = _window_sums(fresh, history, entity, windows, prefix)
    table.overwrite_partitions(_typed(moved, entity, windows, prefix).unionByName(made), emptied=reached, base=m, batch_id=batch_id)
    return reached


def apply_changes(changes: DataFrame, batch_id: str, daily: SnapshotTable, features: SnapshotTable, entity: list[str], windows=WINDOWS, prefix: str = "f", epoch: str = EPOCH) -> set[int]:
    """Folds a batch of changes into both tables; a job that died in between is mended by running it again."""
    delta = daily_changes(changes, entity, epoch)
    fold_daily(daily, delta, entity, batch_id)
    return fold_features(features, daily, delta, entity, batch_id, windows, prefix)
