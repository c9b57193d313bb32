"""Rating: minute buckets -> ledger rows, balance and quota state.

The service rates one sample at a time: it takes the stored quota row (or a fresh one
with the effective included quota and the initial balance), applies the included
quota first, charges the rest at ``price x multiplier`` and carries the balance.
Each step is a closed window form here, per account, ordered by
``(bucket_start, node_id, region, line_code)`` (D4):

* waterfall (A-W4): ``remaining = max(Q - bytes before, 0)``, ``applied =
  min(remaining, bytes)``, ``chargeable = bytes - applied``;
* amount (A-P9): ``-chargeable * price * multiplier`` (``+ 0.0`` drops ``-0.0``);
* balance (A-W5): seed balance + running sum of amounts, computed as
  ``seed - max(bytes so far - Q, 0) * price * multiplier`` (charges only);
* arrears (A-W6): start of the current negative run of the balance (or the stored
  ``arrears_since`` when the run reaches back to the seed), null when not negative;
* throttle flag (A-P10): ``throttled`` iff balance < 0.

A stored negative remaining quota is floored at 0 (D11).  All running values use the
two-level window (:mod:`meterwise.functions.prefix`), so one busy account is split by
day instead of landing in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.config import (
    ENTRY_TYPE_TRAFFIC,
    SUSPEND_ACTIVE,
    THROTTLE_NORMAL,
    THROTTLE_THROTTLED,
    RatingConfig,
)
from meterwise.functions.ids import uuid5_oid
from meterwise.functions.prefix import chunked_window
from meterwise.functions.time import rfc3339_seconds
from meterwise.operators.metering import chunk_of
from meterwise.operators.pricing import attach_pricing

RATE_ORDER = ("bucket_start", "node_id", "region", "line_code")
BUCKET_KEY = ("bucket_start", "node_id", "account_uuid", "region", "line_code")


def ledger_id():
    """A-P7: UUIDv5(OID, ``start|node|account|region|line``), start as RFC 3339 seconds."""
    key = F.concat_ws(
        "|", rfc3339_seconds(F.col("bucket_start")), "node_id", "account_uuid", "region", "line_code"
    )
    return uuid5_oid(key)


def seed_quota(rows: DataFrame, quota_states: DataFrame | None, cfg: RatingConfig) -> DataFrame:
    """A-J3: attach the stored quota row, default-initialised when missing."""
    if quota_states is None:
        q = None
    else:
        q = quota_states.select(
            "account_uuid",
            F.col("remaining_included_quota").alias("q_remaining"),
            F.col("current_balance").alias("q_balance"),
            F.col("arrears_since").alias("q_arrears_since"),
            F.col("suspend_state").alias("q_suspend_state"),
            F.lit(True).alias("q_exists"),
        )
    j = rows if q is None else rows.join(q, on="account_uuid", how="left")
    col = (lambda c: F.col(c)) if q is not None else (lambda c: F.lit(None))
    return j.select(
        *rows.columns,
        F.greatest(F.coalesce(col("q_remaining"), F.col("included_quota_bytes")), F.lit(0)).cast("long").alias("seed_remaining"),
        F.coalesce(col("q_balance").cast("double"), F.lit(float(cfg.initial_balance))).alias("seed_balance"),
        col("q_arrears_since").cast("timestamp_ntz").alias("seed_arrears_since"),
        F.coalesce(col("q_suspend_state").cast("string"), F.lit(SUSPEND_ACTIVE)).alias("suspend_state"),
        F.coalesce(col("q_exists").cast("boolean"), F.lit(False)).alias("had_quota_row"),
    )


def rate_buckets(
    buckets: DataFrame,
    profiles: DataFrame | None,
    quota_states: DataFrame | None,
    cfg: RatingConfig = RatingConfig(),
) -> DataFrame:
    """Rated minute buckets: one row per bucket with the ledger and quota columns."""
    priced = attach_pricing(buckets, profiles, cfg)
    seeded = seed_quota(priced, quota_states, cfg)
    keys = ["account_uuid"]
    chunk = chunk_of(F.col("bucket_start"), cfg.chunk)
    order = list(RATE_ORDER)

    a = chunked_window(
        seeded, keys, order, chunk,
        runs={
            "bytes_before": (F.col("total_bytes"), "sum", "excl"),
            "rows_before": (F.lit(1).cast("long"), "sum", "excl"),
        },
    )
    q = F.col("seed_remaining")
    remaining = F.greatest(q - F.col("bytes_before"), F.lit(0)).cast("long")
    a = a.withColumn("remaining_before", remaining)
    a = a.withColumn("included_applied", F.least(F.col("remaining_before"), F.col("total_bytes")))
    a = a.withColumn("rated_bytes", F.col("total_bytes") - F.col("included_applied"))
    a = a.withColumn(
        "amount_delta",
        (-F.col("rated_bytes").cast("double")) * F.col("price_per_byte") * F.col("multiplier") + F.lit(0.0),
    )
    # Charges only: the balance is the seed minus everything charged so far, and the
    # bytes charged so far are max(bytes so far - Q, 0).  One running byte total gives
    # both balances, so no second running pass over the amounts is needed.
    charged_before = F.greatest(F.col("bytes_before") - q, F.lit(0)).cast("double")
    charged_through = F.greatest(F.col("bytes_before") + F.col("total_bytes") - q, F.lit(0)).cast("double")
    a = a.withColumn("balance_before", F.col("seed_balance") + (-charged_before) * F.col("price_per_byte") * F.col("multiplier") + F.lit(0.0))
    a = a.withColumn("balance_after", F.col("seed_balance") + (-charged_through) * F.col("price_per_byte") * F.col("multiplier") + F.lit(0.0))

    neg = F.col("balance_after") < 0
    c = arrears_runs(a, order, chunk)

    return c.select(
        *BUCKET_KEY,
        "uplink_bytes",
        "downlink_bytes",
        "total_bytes",
        "multiplier",
        "rating_status",
        F.col("pricing_rule_version").alias("source_revision"),
        ledger_id().alias("id"),
        (F.col("bucket_start") + F.expr("INTERVAL 1 MINUTE")).cast("timestamp_ntz").alias("bucket_end"),
        F.lit(ENTRY_TYPE_TRAFFIC).alias("entry_type"),
        "included_applied",
        "rated_bytes",
        "amount_delta",
        "balance_after",
        (F.col("remaining_before") - F.col("included_applied")).alias("remaining_after"),
        neg.alias("arrears"),
        F.when(neg, F.col("arrears_run.at")).alias("arrears_since"),
        F.when(neg, F.lit(THROTTLE_THROTTLED)).otherwise(F.lit(THROTTLE_NORMAL)).alias("throttle_state"),
        "suspend_state",
        "pricing_rule_version",
        "price_per_byte",
        "first_collected_at",
        "last_collected_at",
    )


def arrears_runs(a: DataFrame, order: list[str], chunk) -> DataFrame:
    """A-W6: ``arrears_run.at``, the start of the latest negative run of ``balance_after`` up to a row.

    A run starts where the balance before was not negative, or at the account's first row,
    which goes on from the stored ``arrears_since``.
    """
    is_first = F.col("rows_before") == 0
    start_at = F.when(is_first, F.coalesce(F.col("seed_arrears_since"), F.col("last_collected_at"))).otherwise(
        F.col("last_collected_at")
    )
    starts = (F.col("balance_after") < 0) & (is_first | (F.col("balance_before") >= 0))
    marker = F.when(starts, F.struct(*order, start_at.alias("at")))
    return chunked_window(a, ["account_uuid"], order, chunk, runs={"arrears_run": (marker, "max", "incl")})


ENTRY_ORDER = ("entry_at", "entry_rank", "id")


def run_balances(entries: DataFrame, quota_states: DataFrame | None, cfg: RatingConfig = RatingConfig()) -> DataFrame:
    """A-W5 + A-W6 over ledger entries of any type: charges, credits, refunds.

    ``entries``: ``id, account_uuid, entry_at, entry_rank, entry_type, amount_delta, last_collected_at``;
    an account's entries count in the order of (entry_at, entry_rank, id).  The balance is the stored one (or
    the initial one) plus the running sum of the amounts, so a credit can end an arrears episode and
    a later charge can start the next.
    """
    seeded = seed_quota(entries.withColumn("included_quota_bytes", F.lit(0).cast("long")), quota_states, cfg)
    order, chunk = list(ENTRY_ORDER), chunk_of(F.col("entry_at"), cfg.chunk)
    a = chunked_window(
        seeded, ["account_uuid"], order, chunk,
        runs={
            "sum_before": (F.col("amount_delta"), "sum", "excl"),
            "rows_before": (F.lit(1).cast("long"), "sum", "excl"),
        },
    )
    a = a.withColumn("balance_before", F.col("seed_balance") + F.col("sum_before"))
    a = a.withColumn("balance_after", F.col("balance_before") + F.col("amount_delta"))
    neg = F.col("balance_after") < 0
    return arrears_runs(a, order, chunk).select(
        *entries.columns,
        "balance_after",
        neg.alias("arrears"),
        F.when(neg, F.col("arrears_run.at")).alias("arrears_since"),
        F.when(neg, F.lit(THROTTLE_THROTTLED)).otherwise(F.lit(THROTTLE_NORMAL)).alias("throttle_state"),
    )


def ledger_rows(rated: DataFrame) -> DataFrame:
    """A-S9 row shape of the ledger."""
    return rated.select(
        "id", "account_uuid", "bucket_start", "bucket_end", "entry_type",
        "rated_bytes", "amount_delta", "balance_after", "pricing_rule_version",
    )


def bucket_rows(rated: DataFrame) -> DataFrame:
    """A-S7 row shape of the minute-bucket table."""
    return rated.select(
        *BUCKET_KEY, "uplink_bytes", "downlink_bytes", "total_bytes", "multiplier", "rating_status", "source_revision",
    )


def final_quota_states(rated: DataFrame) -> DataFrame:
    """A-W7 + A-P10: the quota row of every rated account after the run (last row wins,
    a partial aggregate per account)."""
    last = rated.groupBy("account_uuid").agg(
        F.max_by(
            F.struct(
                "remaining_after", "balance_after", "arrears", "arrears_since", "throttle_state",
                "suspend_state", "bucket_start", "last_collected_at",
            ),
            F.struct(*RATE_ORDER),
        ).alias("s")
    )
    return last.select(
        "account_uuid",
        F.col("s.remaining_after").alias("remaining_included_quota"),
        F.col("s.balance_after").alias("current_balance"),
        F.col("s.arrears").alias("arrears"),
        F.col("s.arrears_since").alias("arrears_since"),
        F.col("s.throttle_state").alias("throttle_state"),
        F.col("s.suspend_state").alias("suspend_state"),
        F.col("s.bucket_start").alias("last_rated_bucket_at"),
        F.col("s.last_collected_at").alias("effective_at"),
    )
