"""Late data: corrections join the log and everything derived is built again, never incremented."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.functions.scalars import EPOCH, day_index
from tallgrass.operators.features import build_features, invalidated_days, write_features
from tallgrass.operators.model import fact_transaction
from tallgrass.sources.snapshots import SnapshotTable


def apply_late_batch(table: SnapshotTable, batch: DataFrame, batch_id: str, epoch: str = EPOCH, article_type: DataFrame | None = None, sinks: dict[str, SnapshotTable] | None = None) -> dict:
    """Appends a batch once, builds the fact and the features of the days that it made stale, and writes them to ``sinks``.

    The build is the same on a replay, so a job that died after the append, or between two
    sinks, is mended by running it again: ``landed`` tells whether the batch was new, all
    else does not depend on it. Sinks are named by grain and hold days; cross features
    need the articles' types. An empty batch makes nothing stale.
    """
    landed = table.append_once(batch.withColumn("_ingested_at", F.current_timestamp()), batch_id) is not None
    days = batch.agg(F.min(day_index(F.col("t_dat"), epoch)), F.max(day_index(F.col("t_dat"), epoch))).first()
    tx = table.read()
    if days[0] is None:
        return {"landed": landed, "fact": fact_transaction(tx), "range": None, "features": {}}
    start, end = invalidated_days(*days)
    features = build_features(tx, article_type, start=start, end=end, epoch=epoch)
    for grain, sink_table in (sinks or {}).items():
        write_features(sink_table, features[grain])
    return {"landed": landed, "fact": fact_transaction(tx), "range": (start, end), "features": features}


def sink(table: SnapshotTable, name: str = "stream") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: each micro-batch lands once, however often it is replayed."""

    def write(batch: DataFrame, batch_id: int) -> None:
        table.append_once(batch, f"{name}-{batch_id}")

    return write
