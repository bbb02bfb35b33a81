"""Session helpers: local sessions for tests/bench and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "raterkit") -> SparkSession:
    """A local session for tests and the bench. On a cluster, build your own session.

    The UI stays off. A checkpoint folder is set only when the session has none.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("RATERKIT_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder named by the session.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as is; a
    cluster session without it is an error. Only a local-mode session without it (tests)
    gets a fresh folder under the system temp dir.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set: point it at shared storage (HDFS, object store); "
                "lineage cuts and scratch tables are written there"
            )
        conf_dir = tempfile.mkdtemp(prefix="raterkit-ckpt-")  # local mode only (tests)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the session's checkpoint folder (shared storage)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as a parquet table under the session's checkpoint folder and read it back.

    The written table is shared storage (survives executor loss), columnar (each later
    branch reads only its columns) and cuts the lineage like ``checkpoint()``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def cut_bucketed(df: DataFrame, keys: list[str], name: str = "table") -> DataFrame:
    """``cut_lineage`` as a table of buckets by ``keys`` (one file for each, as many as shuffle
    partitions): reading it, aggregates, windows and joins on these keys need no exchange.

    The catalog entry is only the writer's means and is dropped; the files stay.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path, entry = scratch_path(spark, name), f"raterkit_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, *keys).write.format("parquet").option("path", path)
    writer.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(entry)
    out = spark.table(entry)
    spark.sql(f"DROP TABLE {entry}")
    return out
