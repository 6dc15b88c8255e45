"""Session construction and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(master: str | None = None, app: str = "labelforge",
                shuffle_partitions: int | None = None) -> SparkSession:
    """A session with AQE on and the UI off.

    On a cluster the master, memory and ``spark.checkpoint.dir`` come from
    the submitting environment; locally we fill in small-machine defaults.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    elif not os.environ.get("SPARK_MASTER") and not os.environ.get("MASTER"):
        b = b.master("local[*]")
    parts = shuffle_partitions or os.environ.get("LABELFORGE_SHUFFLE_PARTITIONS")
    b = (b.config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false")
          .config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true")
          .config("spark.driver.memory", os.environ.get("LABELFORGE_DRIVER_MEMORY", "16g")))
    if parts:  # otherwise the cluster's own setting stands
        b = b.config("spark.sql.shuffle.partitions", str(parts))
    spark = b.getOrCreate()
    if not parts and spark.sparkContext.master.startswith("local"):
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and state tables.

    Read from ``spark.checkpoint.dir``; only when the session has none (a
    local test run) a fresh scratch folder is created and registered.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="labelforge-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, path object): the cluster's own access to ``path``, whatever its store."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    fs, p = file_system(spark, path)
    fs.mkdirs(p)
    return path
