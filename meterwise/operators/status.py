"""Job status roll-ups (A-A5, A-A6).

Messages are per source (bounded by the registry); invalid samples are counted,
never concatenated, so no unbounded list is built in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Status severity, worst last.
SEVERITY = {"ok": 0, "disabled": 1, "partial": 2, "error": 3}


def pull_job_status(source_results: DataFrame, invalid_samples: DataFrame, counters: DataFrame) -> DataFrame:
    """A-A5: one row -- ``ok``, ``partial`` (some source failed or a sample was invalid
    but something was done) or ``error`` (no enabled source, or a failure and nothing
    processed/written/replayed)."""
    s = source_results.agg(
        F.count("*").cast("long").alias("sources_enabled"),
        F.sum(F.when(F.col("status") == "error", 1).otherwise(0)).cast("long").alias("sources_failed"),
        F.concat_ws("; ", F.array_sort(F.collect_list(F.when(F.col("status") == "error", F.struct("source_id", "error"))))["error"]).alias("source_errors"),
    )
    inv = invalid_samples.agg(F.count("*").cast("long").alias("invalid_samples"))
    c = counters.select("processed_samples", "written_minutes", "replayed_minutes")
    u = s.unionByName(inv, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)
    one = u.agg(*[F.max(x).alias(x) for x in u.columns])
    base = F.when(F.col("invalid_samples") > 0, F.lit("partial")).otherwise(F.lit("ok"))
    nothing = (F.col("processed_samples") == 0) & (F.col("written_minutes") == 0) & (F.col("replayed_minutes") == 0)
    status = (
        F.when(F.col("sources_enabled") == 0, F.lit("error"))
        .when((F.col("sources_failed") > 0) & nothing & (base != "partial"), F.lit("error"))
        .when(F.col("sources_failed") > 0, F.lit("partial"))
        .otherwise(base)
    )
    msgs = F.concat_ws(
        "; ",
        F.when(F.col("invalid_samples") > 0, F.format_string("%d invalid sample uuid(s)", F.col("invalid_samples"))),
        F.when(F.col("sources_enabled") == 0, F.lit("no enabled exporter sources configured")),
        F.when(F.col("source_errors") != "", F.col("source_errors")),
    )
    return one.select(
        status.alias("status"), msgs.alias("error"), "sources_enabled", "sources_failed", "invalid_samples",
        "processed_samples", "written_minutes", "replayed_minutes",
    )


def worst_status(results: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """A-A6 (D8): the worst status of a batch (the service reported the last one)."""
    sev = F.create_map(*[x for k, v in SEVERITY.items() for x in (F.lit(k), F.lit(v))])
    g = results.groupBy(*(group_cols or []))
    return g.agg(F.max_by("status", sev[F.col("status")]).alias("status"), F.count("*").alias("results"))


def push_batches(flagged: DataFrame, batch_col: str, snapshot_col: str) -> DataFrame:
    """A-A6 over the entries of pushed snapshots (``refused``: the snapshot's check failed; ``reject_reason``: the entry's).

    A refused snapshot is an ``error``, one with a rejected entry ``partial``.  Per batch: the worst status, how many
    snapshots had each, and the first refused one.  Two aggregates, both combined before their shuffle.
    """
    each = flagged.groupBy(batch_col, snapshot_col).agg(
        F.when(F.max("refused"), F.lit("error")).when(F.count("reject_reason") > 0, F.lit("partial")).otherwise(F.lit("ok")).alias("status"))
    counts = each.groupBy(batch_col).agg(
        *[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("ok", "partial", "error")],
        F.min(F.when(F.col("status") == "error", F.col(snapshot_col))).alias("first_error"))
    return worst_status(each, [batch_col]).join(counts, batch_col)
