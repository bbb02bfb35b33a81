"""Load the driver's parquet tables with only the columns a plan needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]
# Session setting: deal the rows of each table out over this many partitions after the scan.
# Unset by default; for inputs of a few unsplittable files it spreads per-row work over the cores.
SCAN_PARTITIONS = "spark.raterkit.scanPartitions"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; projections after it are pruned down to the parquet scan by Catalyst."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    partitions = spark.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(partitions)) if partitions else df
