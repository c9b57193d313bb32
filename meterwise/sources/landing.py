"""Landed snapshots as a zone partitioned by time, read no further than the windows of a run (A-S1, A-T2).

The zone is Parquet under ``day=/hour=`` folders.  A run's windows (one row per source, a bounded config list) give one pair
of bounds; as literals they prune folders and reach the Parquet scan, and each source's own window is applied after that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTITIONS = ("day", "hour")


def add_partitions(snapshots: DataFrame, time_col: str = "collected_at") -> DataFrame:
    at = F.col(time_col)
    return snapshots.withColumns({"day": F.to_date(at), "hour": F.hour(at)})


def append_zone(snapshots: DataFrame, path: str, time_col: str = "collected_at") -> None:
    """Adds snapshots to the zone; rows without a time cannot be landed (the caller's quarantine holds them)."""
    rows = add_partitions(snapshots.filter(F.col(time_col).isNotNull()), time_col)
    rows.write.mode("append").partitionBy(*PARTITIONS).parquet(path)


def bounds(windows: DataFrame) -> tuple:
    """(least ``since``, greatest ``until``) of all windows that have work to do, as driver-side literals: one row."""
    return tuple(windows.filter(F.col("since") <= F.col("until")).agg(F.min("since"), F.max("until")).first())


def within(time_col: str, since, until) -> Column:
    """The closed interval, as literals."""
    at = F.col(time_col)
    return (at >= F.lit(since).cast("timestamp_ntz")) & (at <= F.lit(until).cast("timestamp_ntz"))


def read_zone(spark: SparkSession, path: str, windows: DataFrame, time_col: str = "collected_at") -> DataFrame:
    """Snapshots of the zone inside their source's window."""
    zone = spark.read.parquet(path)
    since, until = bounds(windows)
    if since is None:
        return zone.filter(F.lit(False)).drop(*PARTITIONS)
    folders = (F.col("day") >= F.lit(since.date())) & (F.col("day") <= F.lit(until.date()))
    if since.date() == until.date():
        folders = folders & (F.col("hour") >= since.hour) & (F.col("hour") <= until.hour)
    rows = zone.filter(folders & within(time_col, since, until)).drop(*PARTITIONS)
    return in_windows(rows, windows, time_col)


def in_windows(rows: DataFrame, windows: DataFrame, time_col: str = "collected_at") -> DataFrame:
    """Rows inside their source's closed window."""
    w = windows.select("source_id", F.col("since").alias("__since"), F.col("until").alias("__until"))
    at = F.col(time_col)
    return rows.join(w, "source_id").filter((at >= F.col("__since")) & (at <= F.col("__until"))).drop("__since", "__until")
