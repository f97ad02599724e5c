"""The raw tables: made if absent, loaded idempotently."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.sources import csv, schemas
from tallgrass.sources.snapshots import SnapshotTable


class Warehouse:
    def __init__(self, spark: SparkSession, path: str, data_raw: str | None = None):
        self.spark, self.path, self.data_raw = spark, path, data_raw

    def table(self, name: str) -> SnapshotTable:
        return SnapshotTable(self.spark, f"{self.path}/raw/{name}")

    def create_tables(self) -> None:
        """Safe to run again."""
        self.table("transactions").create(f"{schemas.TRANSACTIONS}, _ingested_at timestamp, _source_file string", "t_dat")
        self.table("customers").create(schemas.CUSTOMERS)
        self.table("articles").create(schemas.ARTICLES)

    def load_transactions(self, start=None, end=None, corrections: dict[str, DataFrame] | None = None) -> int | None:
        """Replaces whole days by the base file's rows and all corrections of those days."""
        base = csv.read_transactions(self.spark, start, end, self.data_raw)
        fixes = {k: csv.between(v, "t_dat", start, end) for k, v in (corrections or {}).items()}
        return self.table("transactions").overwrite_partitions(csv.day_source(base, fixes).withColumn("_ingested_at", F.current_timestamp()))

    def load_dimension(self, name: str, replace: bool = False) -> int:
        """Upsert on the id, or a full replacement."""
        source, table = csv.read_raw(self.spark, name, self.data_raw), self.table(name)
        return table.replace(source) if replace else table.merge(source, schemas.KEYS[name])
