"""Tier A metering / rating queries over the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterwise.config import RatingConfig
from meterwise.operators import rating
from meterwise.plans.catalog import register
from meterwise.plans.metering_job import meter_inbound
from meterwise.plans.oracle import with_views
from meterwise.sources import fixtures as fx

# Defaults of the fixture runs (FIXTURES.md).
FIXTURE_CFG = RatingConfig(
    price_per_byte=1 / 2048, included_quota_bytes=50000, initial_balance=64.0, source_revision="rev-1"
)


def metered(spark, sf, cfg=FIXTURE_CFG, quota=True):
    return meter_inbound(
        fx.inbound(spark, sf), fx.profiles(spark, sf), fx.quota_states(spark, sf) if quota else None, None, cfg
    )


BUCKET_COLS = (
    "bucket_start, node_id, account_uuid, region, line_code, uplink_bytes, downlink_bytes, total_bytes, "
    "first_collected_at, last_collected_at, snapshots, rating_status"
)


@register("minute_buckets", with_views(["m_buckets"], f"SELECT {BUCKET_COLS} FROM m_buckets"))
def minute_buckets(spark, sf):
    return metered(spark, sf).buckets.select(*[c.strip() for c in BUCKET_COLS.split(",")])


RATED_COLS = (
    "bucket_start, node_id, account_uuid, region, line_code, uplink_bytes, downlink_bytes, total_bytes, multiplier, "
    "rating_status, source_revision, id, bucket_end, entry_type, included_applied, rated_bytes, amount_delta, "
    "balance_after, remaining_after, arrears, arrears_since, throttle_state, suspend_state, pricing_rule_version, "
    "price_per_byte, first_collected_at, last_collected_at"
)


@register("rated_minutes", with_views(["m_rated"], f"SELECT {RATED_COLS} FROM m_rated"))
def rated_minutes(spark, sf):
    return metered(spark, sf).rated.select(*[c.strip() for c in RATED_COLS.split(",")])
