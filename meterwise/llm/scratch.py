"""Lineage cuts for iterative operators.

State that a loop reads again is checkpointed into ``spark.checkpoint.dir``, which all executors share, so a lost
executor never forces the earlier rounds to run again.  Spark removes the files of a dropped checkpoint itself when
``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
"""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, local_default: str | None = None) -> str:
    """The cluster's ``spark.checkpoint.dir``; ``local_default`` or a fresh folder only where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        path = local_default or tempfile.mkdtemp(prefix="meterwise-llm-")
        spark.sparkContext.setCheckpointDir(path)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, saved in the shared folder and read back from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, for jobs that were started without ``--py-files`` (once a session)."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="meterwise-ship-")) / "meterwise.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, str(f.relative_to(package.parent)))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)
