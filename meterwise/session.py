"""Spark session settings shared by jobs, tests and the bench.

On a cluster the session is created by the launcher; ``configure`` only sets what
must hold for correct results (UTC, ANSI) and what the plans rely on (AQE), and it
never overrides a checkpoint directory that the cluster already names.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on.  Values are Spark's own knobs, nothing custom.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in REQUIRED_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "meterwise") -> SparkSession:
    """Session for tests and the local bench (``local[N]``, UI off)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("METERWISE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64m")
    )
    for key, value in REQUIRED_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared (HDFS/object store) folder there; it is read from the
    session and used as is.  Only when it is unset -- tests and local runs -- a
    fresh scratch folder is created and registered.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        spark.sparkContext.setCheckpointDir(current)
        return current
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="meterwise-ckpt-")
    try:
        spark.conf.set("spark.checkpoint.dir", path)
    except Exception:  # a core setting may be read-only at runtime; the context call below suffices
        pass
    spark.sparkContext.setCheckpointDir(path)
    return path


def materialize(df):
    """Cut lineage: write ``df`` as parquet under the shared checkpoint folder and read
    it back.

    Used between the passes of the two-level windows, each of which reads its input
    twice; without the cut every pass doubles the plan.  The folder is
    ``spark.checkpoint.dir`` (shared storage on a cluster), so a lost executor does
    not force a recomputation of the earlier passes.  A parquet write computes the
    input once (an RDD checkpoint would compute it a second time to save it).
    """
    spark = df.sparkSession
    base = checkpoint_dir(spark).rstrip("/")
    path = f"{base}/mw-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)
