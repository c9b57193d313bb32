"""Pull sources: window, identity check, high-water mark (A-T1..A-T3, A-P3, A-P4, A-J5).

The registry is the configured list of exporter sources -- a bounded config list,
whose side of a join the planner may broadcast by its size.  Snapshots are grouped per
source with partial aggregates (a source may carry a third of all rows), never with
a window partitioned by source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.config import SOURCE_WINDOW_OVERLAP_SECONDS
from meterwise.functions.text import go_trim


def enabled_sources(registry: DataFrame) -> DataFrame:
    """A-P4: sources with ``enabled`` (default true)."""
    return registry.filter(F.coalesce(F.col("enabled"), F.lit(True)))


def source_windows(sync_state: DataFrame, registry: DataFrame, as_of: str) -> DataFrame:
    """A-T1: ``until`` = start of the previous full minute; ``since`` = last completed (or
    ``until``) minus the overlap; ``since > until`` means nothing to do."""
    now = F.lit(as_of).cast("timestamp_ntz")
    until = (F.date_trunc("minute", now).cast("timestamp_ntz") - F.expr("INTERVAL 1 MINUTE")).cast("timestamp_ntz")
    overlap = F.expr(f"INTERVAL {SOURCE_WINDOW_OVERLAP_SECONDS} SECONDS")
    j = enabled_sources(registry).select("source_id").join(sync_state, on="source_id", how="left")
    since = (F.coalesce(F.col("last_completed_until"), until) - overlap).cast("timestamp_ntz")
    return j.select(
        "source_id",
        F.col("last_completed_until").alias("previous_until"),
        since.alias("since"),
        until.alias("until"),
        (since > until).alias("noop"),
    )


def identity_mismatch(snapshots: DataFrame, registry: DataFrame) -> DataFrame:
    """A-P3 + A-J5: snapshots of enabled sources with a ``mismatch`` message (null when the
    node id / env match what the source expects; blank expectations match anything)."""
    reg = enabled_sources(registry).select("source_id", "expected_node_id", "expected_env")
    j = snapshots.join(reg, on="source_id", how="inner")
    node, env = go_trim(F.col("node_id")), go_trim(F.col("env"))
    exp_node, exp_env = F.coalesce(F.col("expected_node_id"), F.lit("")), F.coalesce(F.col("expected_env"), F.lit(""))
    msg = F.when(
        (exp_node != "") & (node != exp_node),
        F.format_string('source %s expected node_id "%s", got "%s"', F.col("source_id"), exp_node, node),
    ).when(
        (exp_env != "") & (env != exp_env),
        F.format_string('source %s expected env "%s", got "%s"', F.col("source_id"), exp_env, env),
    )
    return j.withColumn("mismatch", msg)


def source_identity(snapshots: DataFrame, registry: DataFrame) -> DataFrame:
    """Per enabled source: ``snapshots, mismatches, status, error``."""
    return _per_source(snapshots, registry).drop("last_processed")


def _per_source(snapshots: DataFrame, registry: DataFrame) -> DataFrame:
    """Per enabled source: snapshot count, mismatches and the first error (D9: a source
    with any mismatch is rejected as a whole)."""
    flagged = identity_mismatch(snapshots, registry)
    per = flagged.groupBy("source_id").agg(
        F.count("*").alias("snapshots"),
        F.count("mismatch").alias("mismatches"),
        F.min_by("mismatch", F.when(F.col("mismatch").isNotNull(), F.struct("collected_at", "mismatch"))).alias("error"),
        F.max("collected_at").alias("last_processed"),
    )
    reg = enabled_sources(registry).select("source_id")
    out = reg.join(per, on="source_id", how="left")
    return out.select(
        "source_id",
        F.coalesce(F.col("snapshots"), F.lit(0)).cast("long").alias("snapshots"),
        F.coalesce(F.col("mismatches"), F.lit(0)).cast("long").alias("mismatches"),
        F.when(F.col("mismatches") > 0, F.lit("error")).otherwise(F.lit("ok")).alias("status"),
        "error",
        "last_processed",
    )


def accepted_snapshots(snapshots: DataFrame, registry: DataFrame) -> DataFrame:
    """Snapshots of enabled sources whose run had no identity mismatch."""
    failed = source_identity(snapshots, registry).filter(F.col("status") == "error").select("source_id")
    reg = enabled_sources(registry).select("source_id").join(failed, on="source_id", how="left_anti")
    return snapshots.join(reg, on="source_id", how="left_semi")


def advance_watermarks(windows: DataFrame, snapshots: DataFrame, registry: DataFrame) -> DataFrame:
    """A-T2 + A-T3: new ``last_completed_until`` per source after one collect run.

    Completed sources move to the last processed snapshot time in their window (or
    ``until`` when nothing was processed, or for a no-op window); failed sources keep
    their previous mark and record the error.  The mark never moves back (D5).
    """
    in_window = snapshots.join(windows.select("source_id", "since", "until"), on="source_id", how="inner").filter(
        F.col("collected_at").between(F.col("since"), F.col("until"))
    )
    per = _per_source(in_window, registry).select("source_id", "status", "error", "last_processed")
    j = windows.join(per, on="source_id", how="left")
    failed = F.col("status") == "error"
    moved = F.when(F.col("noop"), F.col("until")).otherwise(F.least(F.col("until"), F.coalesce(F.col("last_processed"), F.col("until"))))
    new_mark = F.when(failed, F.col("previous_until")).otherwise(F.greatest(F.col("previous_until"), moved))
    return j.select(
        "source_id",
        new_mark.alias("last_completed_until"),
        F.when(failed, F.col("error")).otherwise(F.lit("")).alias("last_error"),
        F.coalesce(failed, F.lit(False)).alias("failed"),
    )


def sync_state_rows(state: DataFrame, marks: DataFrame, attempted_at: str) -> DataFrame:
    """A-S16: the whole stored row of every source after a run, as the keyed overwrite leaves it.

    ``state``: the stored rows; ``marks``: what ``advance_watermarks`` returned.  An attempted source gets the
    time of the attempt, its mark and its error; the time of the last success moves only without an error.
    A source that was not attempted keeps its row.
    """
    now = F.lit(attempted_at).cast("timestamp_ntz")
    stored = state.select(
        "source_id", *[F.col(c).alias(f"o_{c}") for c in ("last_completed_until", "last_attempted_at", "last_succeeded_at", "last_error")]
    )
    new = marks.select("source_id", "last_completed_until", "last_error", "failed", F.lit(True).alias("attempted"))
    j = stored.join(new, on="source_id", how="full")
    tried, failed = F.col("attempted").isNotNull(), F.col("failed")
    return j.select(
        "source_id",
        F.when(tried, F.col("last_completed_until")).otherwise(F.col("o_last_completed_until")).alias("last_completed_until"),
        F.when(tried, now).otherwise(F.col("o_last_attempted_at")).alias("last_attempted_at"),
        F.when(tried & ~failed, now).otherwise(F.col("o_last_succeeded_at")).alias("last_succeeded_at"),
        F.when(tried, F.col("last_error")).otherwise(F.col("o_last_error")).alias("last_error"),
    )
