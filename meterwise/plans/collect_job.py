"""Collect run over pulled sources: window, gate, meter and rate, sync state (A-P3, A-P4, A-T1..A-T3, A-S16).

The gate stands between the scan and metering.  A source with one mismatching snapshot in its window is kept out as a
whole: no bucket, ledger row, checkpoint or quota change comes from it, and its mark stays where it was.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.config import RatingConfig
from meterwise.functions.text import storage_node_id
from meterwise.operators import sync
from meterwise.plans.metering_job import MeterResult, meter_inbound
from meterwise.session import materialize
from meterwise.sources.landing import in_windows


@dataclass
class CollectResult:
    metered: MeterResult
    sources: DataFrame  # source_id, snapshots, mismatches, status, error
    marks: DataFrame  # what advance_watermarks returns
    nodes: DataFrame  # source_id, node_id (the storage node) of what was metered


def collect(snapshots: DataFrame, entries: DataFrame, registry: DataFrame, sync_state: DataFrame, as_of: str,
            profiles: DataFrame | None = None, quota_states: DataFrame | None = None, checkpoints: DataFrame | None = None,
            cfg: RatingConfig = RatingConfig()) -> CollectResult:
    """``snapshots`` and their ``entries`` (inbound rows) both carry ``source_id``."""
    windows = materialize(sync.source_windows(sync_state, registry, as_of))
    scanned = in_windows(snapshots, windows)
    sources = materialize(sync.source_identity(scanned, registry))
    passed = sources.filter(F.col("status") != "error").select("source_id")
    accepted = in_windows(entries, windows).join(passed, "source_id", "left_semi")
    nodes = accepted.select("source_id", storage_node_id(F.col("env"), F.col("node_id")).alias("node_id")).distinct()
    metered = meter_inbound(accepted.drop("source_id"), profiles, quota_states, checkpoints, cfg)
    return CollectResult(metered, sources, sync.advance_watermarks(windows, snapshots, registry), nodes)


def source_report(r: CollectResult, windows: DataFrame) -> DataFrame:
    """What every enabled source left behind: ``source_id, status, error, snapshots, buckets, ledger_rows, total_bytes,
    previous_until, last_completed_until, moved``."""
    rows = r.metered.rated.groupBy("node_id").agg(
        F.count(F.lit(1)).alias("buckets"), F.count("id").alias("ledger_rows"), F.sum("total_bytes").cast("long").alias("total_bytes"))
    per = r.nodes.join(rows, "node_id").groupBy("source_id").agg(
        *[F.sum(c).cast("long").alias(c) for c in ("buckets", "ledger_rows", "total_bytes")])
    j = r.sources.join(per, "source_id", "left").join(windows.select("source_id", "previous_until"), "source_id", "left")
    j = j.join(r.marks.select("source_id", "last_completed_until"), "source_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("buckets", "ledger_rows", "total_bytes")}
    moved = ~F.col("previous_until").eqNullSafe(F.col("last_completed_until"))
    return j.select("source_id", "status", "error", "snapshots", *zero.values(), "previous_until", "last_completed_until", moved.alias("moved"))
