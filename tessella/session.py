"""Session defaults and table loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Settings that suit a cluster and a laptop alike; sizes are bytes per task, so partition counts follow the data.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def session(name: str = "tessella", **settings: str) -> SparkSession:
    return SparkSession.builder.appName(name).config(map=DEFAULTS | settings).getOrCreate()


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan in at least as many partitions as there are cores: small files of one row group would else keep
    one core busy. Larger scans stay as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


class Tables:
    """Tables of one folder, read lazily: t = Tables(spark, path); t.orders."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")
