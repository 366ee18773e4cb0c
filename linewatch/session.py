"""SparkSession construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_session(master: str | None = None, app_name: str = "linewatch", shuffle_partitions: int | None = None, cpus: int = 8) -> SparkSession:
    """Session for the benchmark and other local runs; jobs on a cluster use the session that the submit command sets up.

    On a cluster, build the session with the cluster's own settings and pass it
    to the operators; nothing here is required by them except a UTC session
    zone when inputs are TIMESTAMP_NTZ wall clocks compared with literals.
    """
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LINEWATCH_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and streaming state: the configured folder itself, the same in every application.

    Read from ``spark.checkpoint.dir``; if only the context's checkpoint folder
    was set, the folder above it (Spark adds an id of the application). Only when
    neither is set and the master is local, as in tests, a fresh scratch folder
    is made; on a cluster a machine-local folder would not be shared, so the
    setting is required.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/").rsplit("/", 1)[0]
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster (it holds stream state)")
    scratch = tempfile.mkdtemp(prefix="linewatch-ckpt-")
    spark.conf.set("spark.checkpoint.dir", scratch)
    return scratch


def size_shuffles(spark: SparkSession, shuffle_bytes: int, partition_bytes: int = 128 * 1024 * 1024) -> int:
    """Set the shuffle partition count so each partition holds about ``partition_bytes``.

    ``shuffle_bytes`` is the largest shuffle a run makes: for a report, the
    projected (serial, station, parameter) rows of the time window; for a
    whole-table debounce, the alarm columns. AQE then coalesces small
    partitions and splits skewed ones around the same advisory size, so
    every task fits in executor memory without spilling. Returns the count set.
    """
    parts = max(1, -(-shuffle_bytes // partition_bytes))
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(partition_bytes))
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", str(4 * partition_bytes))
    return parts
