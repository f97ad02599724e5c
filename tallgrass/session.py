"""Session factory."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tallgrass import settings


def get_spark(app_name: str = "tallgrass", driver_memory: str = "8g", master: str = "local[*]", iceberg_package: str | None = None, extra: dict[str, str] | None = None) -> SparkSession:
    """A UTC session with adaptive execution; with ``iceberg_package`` also an Iceberg Hadoop catalog.

    Binds to the loopback address only where the driver runs all tasks itself.
    """
    s = settings.load()
    conf = {"spark.driver.memory": driver_memory, "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.sources.partitionOverwriteMode": "dynamic"}
    if s.spark_tmp:
        conf["spark.local.dir"] = s.spark_tmp
    if iceberg_package:
        catalog = f"spark.sql.catalog.{s.catalog}"
        conf |= {"spark.jars.packages": iceberg_package, "spark.sql.extensions": "org.apache.iceberg.spark.extensions.IcebergSparkSessionExtensions", catalog: "org.apache.iceberg.spark.SparkCatalog", f"{catalog}.type": "hadoop", f"{catalog}.warehouse": s.warehouse}
    if master.startswith("local"):
        conf |= {"spark.driver.bindAddress": "127.0.0.1", "spark.driver.host": "127.0.0.1"}
    return SparkSession.builder.appName(app_name).master(master).config(map=conf | (extra or {})).getOrCreate()
