"""CSV readers with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallgrass import settings
from tallgrass.sources import schemas


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A headed CSV under ``schema``; refuses a file whose header has other names or another order."""
    declared = StructType.fromDDL(schema).names
    header = [c.strip().strip('"') for c in (spark.read.text(path).limit(1).collect() or [[""]])[0][0].split(",")]
    if header != declared:
        raise ValueError(f"{path}: header {header} is not {declared}")
    return spark.read.schema(schema).option("header", True).csv(path)


def read_raw(spark: SparkSession, table: str, data_raw: str | None = None) -> DataFrame:
    return read_csv(spark, f"{data_raw or settings.load().data_raw}/{schemas.FILES[table]}", schemas.DECLARED[table])


def read_transactions(spark: SparkSession, start=None, end=None, data_raw: str | None = None) -> DataFrame:
    """Transactions between two inclusive, independent day bounds."""
    return between(read_raw(spark, "transactions", data_raw), "t_dat", start, end)


def between(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start))
    return df if end is None else df.where(F.col(column) <= F.lit(end))


def peek(spark: SparkSession, path: str, n: int = 10) -> DataFrame:
    """A quick look at any CSV, types inferred."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path).limit(n)


def day_source(base: DataFrame, corrections: dict[str, DataFrame], base_name: str = "base") -> DataFrame:
    """A day's whole source: the base rows and every correction batch, each row naming its file."""
    out = base.withColumn("_source_file", F.lit(base_name))
    for name, batch in sorted(corrections.items()):
        out = out.unionByName(batch.withColumn("_source_file", F.lit(name)), allowMissingColumns=True)
    return out
