"""Raw zone (B-33): every feed is kept as it came, by provider and date, and can be replayed.

One folder per sync id, written once: a second write under the same id fails, so nothing
that was received is ever changed.  Corrections come as another sync.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession


def write_raw(feed: DataFrame, root: str, sync_id: str, provider: Column, date: Column) -> str:
    """Write ``feed`` under ``root/sync_id=...``, partitioned by ``raw_provider`` and ``raw_date``; returns the folder."""
    path = f"{root.rstrip('/')}/sync_id={sync_id}"
    rows = feed.withColumns({"raw_provider": provider, "raw_date": date.cast("date")})
    rows.write.partitionBy("raw_provider", "raw_date").mode("errorifexists").parquet(path)
    return path


def replay(spark: SparkSession, root: str) -> DataFrame:
    """All raw rows with their ``sync_id``, ``raw_provider`` and ``raw_date``; filters on these skip whole folders."""
    return spark.read.option("basePath", root).parquet(f"{root.rstrip('/')}/sync_id=*")
