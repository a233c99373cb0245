"""SparkSession settings and the shared checkpoint folder.

Everything in the library takes an existing session; ``get_spark`` is only a
convenience for tests, the benchmark and local runs.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app: str = "wordloom", extra: dict | None = None) -> SparkSession:
    master = master or os.environ.get("WORDLOOM_MASTER", "local[*]")
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder of the session.

    On a cluster this is the shared folder named by ``spark.checkpoint.dir``;
    it is read from the session and never replaced.  Only a local session
    (tests, single machine) that names none gets a fresh scratch folder; on a
    cluster that would not be shared, so it is an error there.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="wordloom-ckpt-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return sc._jsc.sc().getCheckpointDir().get()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/wordloom-{name}-{uuid.uuid4().hex}"


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(sc._jsc.hadoopConfiguration()).exists(where)


def is_dir(spark: SparkSession, path: str) -> bool:
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(sc._jsc.hadoopConfiguration())
    return fs.exists(where) and fs.getFileStatus(where).isDirectory()


def spread(df: DataFrame) -> DataFrame:
    """Round-robin repartition of a plain file scan that has fewer splits than
    the cluster has cores (e.g. one unsplittable file), before costly row-local
    work.  A no-op on well-split inputs.  Only for scans: counting the
    partitions of a plan with a shuffle would run its stages."""
    if df.isStreaming:
        return df
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df
