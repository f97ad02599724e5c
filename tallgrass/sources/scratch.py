"""Intermediate tables in the folder that all executors share; they survive the loss of any executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local one only where the master is local and names none."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    made = spark.sparkContext._jsc.sc().getCheckpointDir()
    if made.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
    return made.get().rstrip("/")


class Table:
    """A written intermediate result."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/tables/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables that a computation needs until its own result is written; dropped at the end of a ``with`` block."""

    def __init__(self):
        self._tables: list[Table] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for t in self._tables:
            t.drop()

    def table(self, df: DataFrame, name: str) -> DataFrame:
        return self.keep(Table(df, name)).df

    def keep(self, table: Table) -> Table:
        self._tables.append(table)
        return table
