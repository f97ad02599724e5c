"""Daily totals of a stream in event time, corrected as late rows come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.sources.snapshots import SnapshotTable


def daily_totals(stream: DataFrame, key: str, value: str, ts: str = "ts", delay: str = "10 days") -> DataFrame:
    """(day, key, n, total) of a stream, each again whenever a row changes it; for the update mode.

    Spark keeps a day's totals as state until the watermark, ``delay`` behind the latest row, has
    passed it: so state is bounded by days within the delay times keys, and a row that comes
    later than that is not counted here but belongs into a late batch.
    """
    day = F.window(F.col(ts), "1 day")
    totals = stream.withWatermark(ts, delay).groupBy(day.alias("day"), F.col(key)).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return totals.select(F.to_date("day.start").alias("day"), key, "n", "total")


def totals_sink(table: SnapshotTable, key: str, name: str = "totals") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that replaces the totals that a micro-batch corrects, once however often it is replayed.

    Only the days that the batch holds are read and written.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        table.create(batch.schema, "day")
        m = table.manifest()
        if table.has_batch(f"{name}-{batch_id}", m):
            return
        batch.persist()  # read twice: for its days, and to be written
        try:
            days = {r.day for r in batch.select("day").distinct().collect()}
            same = [F.col("a.day") == F.col("b.day"), F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}"))]
            kept = table.read(m["snapshot_id"], only=days).alias("a").join(batch.select("day", key).alias("b"), same, "left_anti")
            table.overwrite_partitions(kept.unionByName(batch), base=m, batch_id=f"{name}-{batch_id}")
        finally:
            batch.unpersist()

    return write
