"""Spark session and shared-storage helpers.

The library never creates machine-local scratch space on a cluster: lineage cuts and
intermediate tables go under the folder the cluster names in ``spark.checkpoint.dir``.
Only a local-mode session (tests, bench) gets a private folder when none is set.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "loadscope", driver_memory: str = "16g") -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # 64 MB of lookup data is the most any plan broadcasts without an explicit check.
        "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
        # Keep HMAC / AES keys out of logged settings, and long hex literals out of explained plans.
        "spark.redaction.regex": "(?i)secret|password|token|key_hex",
        "spark.sql.redaction.string.regex": "(?i)(X'|0x)?[0-9A-F]{32,}'?",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        # Local mode: the driver JVM is the only executor.
        conf["spark.driver.memory"] = driver_memory
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_dir(spark: SparkSession) -> str:
    """Folder for lineage cuts and derived tables.

    Reads ``spark.checkpoint.dir`` from the session. Sets a private one only in local
    mode when it is unset (tests); on a cluster an unset value is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current.rstrip("/")
    if not _is_local(spark):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="loadscope-ckpt-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared folder."""
    root = shared_dir(spark)
    sep = "" if root.endswith("/") else "/"
    # Spark writers create the folder themselves (on any file system); nothing is created here.
    return f"{root}{sep}{name}-{uuid.uuid4().hex[:12]}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a derived table that no later step reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver found it, whatever folder the driver
    runs in. (Executors that do not see that folder get the package from spark-submit's --py-files.)"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark
