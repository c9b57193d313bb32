"""Metering: cumulative counter snapshots -> per-minute usage.

Input frames
------------
*inbound*: one row per (snapshot, inbound entry) -- ``collected_at, node_id, env,
pos, uuid, email, inbound_tag, uplink_bytes_total, downlink_bytes_total`` where
``pos`` is the entry's index in the snapshot's ``samples`` array.

*samples*: one row per (snapshot, account) after :func:`aggregate_inbounds` --
``storage_node_id, account_uuid, collected_at, uplink_total, downlink_total``.

*checkpoints*: last known totals per (storage node, account) --
``node_id, account_uuid, last_uplink_total, last_downlink_total, last_seen_at,
reset_epoch`` (``node_id`` is the storage node id, as stored by the service).

Semantics kept from the metered service, plus the documented decisions:
* counters are cumulative since the node last restarted; delta = current - previous
  per (storage node, account), the first sample ever bills its full value (D12,
  ``first_sample="baseline"`` bills 0 instead);
* if either direction goes down the sample is a reset: nothing is billed, the
  baseline becomes the current value and the reset epoch grows by one;
* copies of a snapshot are billed once (D1); a sample before the checkpoint's
  ``last_seen_at``, or at that instant with no higher totals, is *late* and is
  reported, not billed (D3); unequal totals at one instant are differenced in order;
* several snapshots in one minute add their deltas (D2, ``minute_policy="sum"``) or
  keep the later one (``"last"``, the service's overwrite).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.config import RATING_STATUS_RATED, RatingConfig
from meterwise.functions.ids import canonical_uuid
from meterwise.functions.prefix import chunked_window
from meterwise.functions.text import go_trim, storage_node_id
from meterwise.functions.time import minute_start

DELTA_KEYS = ("storage_node_id", "account_uuid")

# Rejection reasons.
REASON_UUID_REQUIRED = "sample uuid is required"
REASON_UUID_INVALID = "sample uuid is not a valid UUID"
REASON_COLLECTED_AT = "snapshot collected_at is required"
REASON_NODE_ID = "snapshot node_id is required"
REASON_ENV = "snapshot env is required"


def chunk_of(ts: Column, grain: str | None) -> Column | None:
    return None if grain is None else F.date_trunc(grain, ts).cast("timestamp_ntz")


def flag_samples(inbound: DataFrame) -> DataFrame:
    """A-P1: add ``account_uuid`` (canonical lower-case UUID) and ``reject_reason``."""
    # One-element ``explode``: a value is computed once, not again in every filter and column that uses it.
    x = inbound.withColumn("__uuid", F.explode(F.array(go_trim(F.col("uuid")))))
    x = x.withColumn("account_uuid", F.explode(F.array(canonical_uuid(F.col("__uuid")))))
    reason = F.when(F.coalesce(F.col("__uuid"), F.lit("")) == "", F.lit(REASON_UUID_REQUIRED)).when(
        F.col("account_uuid").isNull(), F.lit(REASON_UUID_INVALID)
    )
    return x.withColumn("reject_reason", reason).drop("__uuid")


def validate_samples(inbound: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split inbound entries into (good, quarantine); the quarantine keeps the reason, that of the
    snapshot (A-P2) before that of the entry (A-P1)."""
    flagged = flag_samples(inbound).withColumn(
        "reject_reason", F.coalesce(snapshot_reject_reason(), F.col("reject_reason"))
    )
    good = flagged.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    bad = flagged.filter(F.col("reject_reason").isNotNull())
    return good, bad


def snapshot_reject_reason() -> Column:
    """A-P2: the first failing snapshot check, or null when the snapshot is accepted."""
    return (
        F.when(F.col("collected_at").isNull(), F.lit(REASON_COLLECTED_AT))
        .when(F.coalesce(go_trim(F.col("node_id")), F.lit("")) == "", F.lit(REASON_NODE_ID))
        .when(F.coalesce(go_trim(F.col("env")), F.lit("")) == "", F.lit(REASON_ENV))
    )


def aggregate_inbounds(good: DataFrame) -> DataFrame:
    """A-A1: one sample per (snapshot, account).

    Sums both counters over the account's inbound entries, keeps the first non-blank
    e-mail in array order and drops the inbound tag.  Readings of one entry (same node,
    env, time, position, account and inbound tag) count once, with the higher counters:
    they are cumulative.  Other accounts or tags at the same position are entries of
    their own, as when one instant arrives in several snapshots.
    """
    snap = ["collected_at", "node_id", "env"]
    entries = good.groupBy(*snap, "pos", "account_uuid", "inbound_tag").agg(
        F.max("uplink_bytes_total").alias("uplink_bytes_total"),
        F.max("downlink_bytes_total").alias("downlink_bytes_total"),
        F.max(go_trim(F.col("email"))).alias("email"),
    )
    return entries.groupBy(*snap, "account_uuid").agg(
        F.sum("uplink_bytes_total").cast("long").alias("uplink_total"),
        F.sum("downlink_bytes_total").cast("long").alias("downlink_total"),
        F.expr("min_by(email, pos) FILTER (WHERE email <> '')").alias("email"),
    ).withColumn("storage_node_id", storage_node_id(F.col("env"), F.col("node_id")))


def counter_deltas(
    samples: DataFrame,
    checkpoints: DataFrame | None = None,
    cfg: RatingConfig = RatingConfig(),
) -> DataFrame:
    """A-W1..A-W3 with A-J1: per-sample deltas, reset flag and reset epoch.

    Returns every input sample with ``delta_up, delta_down, is_first, is_reset,
    is_duplicate, is_late, reset_epoch, billable``.  Checkpoint rows enter the same
    ordered stream as seed rows (no join); the two-level window splits a hot
    (node, account) pair by day.
    """
    keys = list(DELTA_KEYS)
    carried = [c for c in samples.columns if c not in (*keys, "collected_at", "uplink_total", "downlink_total")]
    rows = samples.select(
        *keys, "collected_at", "uplink_total", "downlink_total",
        F.lit(0).alias("is_seed"), F.lit(0).cast("long").alias("seed_epoch"), *carried,
    )
    if checkpoints is not None:
        seeds = checkpoints.select(
            F.col("node_id").alias("storage_node_id"),
            "account_uuid",
            F.col("last_seen_at").alias("collected_at"),
            F.col("last_uplink_total").alias("uplink_total"),
            F.col("last_downlink_total").alias("downlink_total"),
            F.lit(1).alias("is_seed"),
            F.coalesce(F.col("reset_epoch"), F.lit(0)).cast("long").alias("seed_epoch"),
            *[F.lit(None).cast(samples.schema[c].dataType).alias(c) for c in carried],
        )
        rows = rows.unionByName(seeds)

    # a seed sorts after lower totals of its instant and before an equal or higher one; ascending keys only (used in
    # max_by too)
    order = ["collected_at", "uplink_total", "downlink_total", (F.lit(1) - F.col("is_seed")).alias("seed_last")]
    place = F.struct("collected_at", "uplink_total", "downlink_total")
    chunk = chunk_of(F.col("collected_at"), cfg.chunk)
    step1 = chunked_window(
        rows, keys, order, chunk,
        lags=["collected_at", "uplink_total", "downlink_total", "is_seed"],
        runs={"seed_place": (F.when(F.col("is_seed") == 1, place), "max", "all")} if checkpoints is not None else {},
    )
    if checkpoints is None:  # nothing can be late
        step1 = step1.withColumn("seed_place", F.lit(None).cast(step1.select(place).schema[0].dataType))
    is_late = F.col("seed_place").isNotNull() & (place <= F.col("seed_place")) & (F.col("is_seed") == 0)
    is_dup = (F.col("prev_is_seed") == 0) & ~F.coalesce(is_late, F.lit(False))
    for c in ("collected_at", "uplink_total", "downlink_total"):
        is_dup = is_dup & (F.col(f"prev_{c}") == F.col(c))
    first = F.col("prev_uplink_total").isNull()
    base_up = F.coalesce(F.col("prev_uplink_total"), F.lit(0))
    base_down = F.coalesce(F.col("prev_downlink_total"), F.lit(0))
    step1 = step1.select(
        "*",
        F.coalesce(is_late, F.lit(False)).alias("is_late"),
        F.coalesce(is_dup, F.lit(False)).alias("is_duplicate"),
        first.alias("is_first"),
        (F.col("uplink_total") - base_up).alias("raw_up"),
        (F.col("downlink_total") - base_down).alias("raw_down"),
    )
    reset = (F.col("raw_up") < 0) | (F.col("raw_down") < 0)
    valid = (F.col("is_seed") == 0) & ~F.col("is_late") & ~F.col("is_duplicate")
    step1 = step1.withColumn("is_reset", valid & reset)
    contrib = F.when(F.col("is_seed") == 1, F.col("seed_epoch")).when(F.col("is_reset"), F.lit(1)).otherwise(F.lit(0))
    step2 = chunked_window(
        step1, keys, order, chunk, runs={"reset_epoch": (contrib.cast("long"), "sum", "incl")}
    )
    zero_first = F.col("is_first") & F.lit(cfg.first_sample == "baseline")
    out = step2.filter(F.col("is_seed") == 0).select(
        *keys, "collected_at", "uplink_total", "downlink_total", *carried,
        F.when(zero_first, F.lit(0).cast("long")).otherwise(F.col("raw_up")).alias("delta_up"),
        F.when(zero_first, F.lit(0).cast("long")).otherwise(F.col("raw_down")).alias("delta_down"),
        "is_first", "is_reset", "is_duplicate", "is_late", "reset_epoch",
    )
    return out.withColumn("billable", ~F.col("is_reset") & ~F.col("is_duplicate") & ~F.col("is_late"))


def minute_buckets(deltas: DataFrame, cfg: RatingConfig = RatingConfig(), grain: str = "minute") -> DataFrame:
    """A-P6 + A-W9: billable deltas rolled up to the minute bucket key
    ``(bucket_start, node_id, account_uuid, region, line_code)``.

    ``node_id`` is the storage node id.  The aggregated sample has no inbound tag, so
    ``line_code`` is blank; ``region`` is the configured default.  Pricing columns
    (multiplier, revision) are attached by the rating step.
    """
    b = deltas.filter("billable").select(
        (minute_start(F.col("collected_at")) if grain == "minute" else F.date_trunc(grain, "collected_at").cast("timestamp_ntz")).alias("bucket_start"),
        F.col("storage_node_id").alias("node_id"),
        "account_uuid",
        F.lit(cfg.default_region).alias("region"),
        F.lit("").alias("line_code"),
        "collected_at",
        "delta_up",
        "delta_down",
    )
    key = ["bucket_start", "node_id", "account_uuid", "region", "line_code"]
    if cfg.minute_policy == "last":
        agg = [
            F.max_by("delta_up", "collected_at").alias("uplink_bytes"),
            F.max_by("delta_down", "collected_at").alias("downlink_bytes"),
        ]
    else:
        agg = [F.sum("delta_up").cast("long").alias("uplink_bytes"), F.sum("delta_down").cast("long").alias("downlink_bytes")]
    return b.groupBy(*key).agg(
        *agg,
        F.min("collected_at").alias("first_collected_at"),
        F.max("collected_at").alias("last_collected_at"),
        F.count("*").alias("snapshots"),
    ).withColumn("total_bytes", F.col("uplink_bytes") + F.col("downlink_bytes")).withColumn(
        "rating_status", F.lit(RATING_STATUS_RATED)
    )


def latest_checkpoints(deltas: DataFrame, revision: str = "") -> DataFrame:
    """A-W8 / A-S6: checkpoint rows after the run -- the last non-late, non-copy sample
    of each (storage node, account), with its epoch.  A partial aggregate per key."""
    last = (
        deltas.filter(~F.col("is_late") & ~F.col("is_duplicate"))
        .groupBy(*DELTA_KEYS)
        .agg(
            F.max_by(
                F.struct("uplink_total", "downlink_total", "collected_at", "reset_epoch"),
                F.struct("collected_at", "uplink_total", "downlink_total"),
            ).alias("c")
        )
    )
    return last.select(
        F.col("storage_node_id").alias("node_id"),
        "account_uuid",
        F.col("c.uplink_total").alias("last_uplink_total"),
        F.col("c.downlink_total").alias("last_downlink_total"),
        F.col("c.collected_at").alias("last_seen_at"),
        F.lit(revision).alias("xray_revision"),
        F.col("c.reset_epoch").alias("reset_epoch"),
    )
