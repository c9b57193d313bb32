"""Tier A queries: the metered service's own operators, each over the whole fixture
views, with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterwise.config import RatingConfig
from meterwise.operators import costs, lifecycle, metering, rating, status, sync, upsert
from meterwise.operators.pricing import attach_pricing
from meterwise.plans.catalog import register
from meterwise.plans.metering_job import meter_samples, meter_stored
from meterwise.plans.oracle import DEFAULT_QUOTA, PREFIX_CUT, canonical, t, with_views
from meterwise.plans.queries_metering import FIXTURE_CFG, metered
from meterwise.session import materialize
from meterwise.sources import fixtures as fx
from meterwise.sources import landing

# Parameters of the fixture runs (FIXTURES.md).
CHECKPOINT_CUT = "2024-01-11 00:00:00"
SWEEP_AS_OF = "2024-01-25 00:00:00"
COST_AS_OF = "1998-01-10 00:00:00"
WINDOW_AS_OF = "2024-01-15 06:00:30"
SYNC_CUT = "2024-01-15 00:00:00"


def cols(spec: str) -> list[str]:
    return [c.strip() for c in spec.split(",")]


# ---------------------------------------------------------------- A-P1, A-A1
SV = "event_id, pos, uuid, account_uuid, reject_reason"


@register("sample_validation", with_views(["m_flagged"], f"SELECT {SV} FROM m_flagged"))
def q_sample_validation(spark, sf):
    return metering.flag_samples(fx.inbound(spark, sf)).select(*cols(SV))


AI = "collected_at, node_id, env, storage_node_id, account_uuid, uplink_total, downlink_total, email"


@register("aggregate_inbounds", with_views(["m_samples"], f"SELECT {AI} FROM m_samples"))
def q_aggregate_inbounds(spark, sf):
    good, _ = metering.validate_samples(fx.inbound(spark, sf))
    return metering.aggregate_inbounds(good).select(*cols(AI))


@register("split_snapshots", with_views(["m_flagged"], f"""
WITH readings AS (
  SELECT date_trunc('day', collected_at) AS day, node_id, env, pos, inbound_tag, account_uuid,
         max(uplink_bytes_total) AS up, max(downlink_bytes_total) AS down
  FROM m_flagged WHERE reject_reason IS NULL GROUP BY ALL)
SELECT CAST(day AS TIMESTAMP) AS collected_at, node_id, env, account_uuid,
       CAST(sum(up) AS BIGINT) AS uplink_total, CAST(sum(down) AS BIGINT) AS downlink_total
FROM readings GROUP BY 1, 2, 3, 4"""))
def q_split_snapshots(spark, sf):
    """One instant of a node arrives in many snapshots: every account's entries share their positions (times cut to the day)."""
    good, _ = metering.validate_samples(fx.inbound(spark, sf))
    daily = good.withColumn("collected_at", F.date_trunc("day", "collected_at").cast("timestamp_ntz"))
    return metering.aggregate_inbounds(daily).select(
        "collected_at", "node_id", "env", "account_uuid", "uplink_total", "downlink_total")


# ---------------------------------------------------------------- A-W1..A-W3, A-J1, A-S5, A-S6, A-W8
CD = ("event_id, storage_node_id, account_uuid, collected_at, uplink_total, downlink_total, delta_up, delta_down, "
      "is_first, is_reset, is_duplicate, reset_epoch, billable")


@register("counter_delta", with_views(["s_deltas"], f"SELECT {CD} FROM s_deltas"))
def q_counter_delta(spark, sf):
    return metering.counter_deltas(fx.samples(spark, sf), None, FIXTURE_CFG).select(*cols(CD))


ES = "storage_node_id, account_uuid, collected_at, uplink_total, downlink_total, delta_up, delta_down, is_reset, is_duplicate, billable"


@register("equal_time_samples", with_views(["e_deltas"], f"SELECT {ES} FROM e_deltas"))
def q_equal_time_samples(spark, sf):
    """Second readings of an instant: every seventh sample again with higher totals, every fifth again as it is."""
    s = fx.replayed_samples(spark, sf)
    more = s.filter(F.col("event_id") % 7 == 0).withColumns(
        {"uplink_total": F.col("uplink_total") + 60, "downlink_total": F.col("downlink_total") + 5})
    return metering.counter_deltas(s.unionByName(more), None, FIXTURE_CFG).select(*cols(ES))


@register("reset_epochs", with_views(["s_deltas"], """
SELECT storage_node_id, account_uuid, count(*) AS samples,
       CAST(sum(CASE WHEN is_reset THEN 1 ELSE 0 END) AS BIGINT) AS resets, max(reset_epoch) AS reset_epoch
FROM s_deltas GROUP BY 1, 2"""))
def q_reset_epochs(spark, sf):
    d = metering.counter_deltas(fx.samples(spark, sf), None, FIXTURE_CFG)
    return d.groupBy("storage_node_id", "account_uuid").agg(
        F.count("*").alias("samples"),
        F.sum(F.col("is_reset").cast("int")).cast("long").alias("resets"),
        F.max("reset_epoch").alias("reset_epoch"),
    )


@register("delta_with_checkpoint", with_views(["s_deltas"], f"""
SELECT {CD.replace('is_first, ', '')} FROM s_deltas WHERE collected_at >= TIMESTAMP '{CHECKPOINT_CUT}'"""))
def q_delta_with_checkpoint(spark, sf):
    """Incremental run seeded from the checkpoint table of an earlier run == one full run."""
    s = fx.samples(spark, sf)
    cut = F.lit(CHECKPOINT_CUT).cast("timestamp_ntz")
    before = metering.counter_deltas(s.filter(F.col("collected_at") < cut), None, FIXTURE_CFG)
    ck = metering.latest_checkpoints(before)
    d = metering.counter_deltas(s.filter(F.col("collected_at") >= cut), ck, FIXTURE_CFG)
    return d.select(*[c for c in cols(CD) if c != "is_first"])


CK = "node_id, account_uuid, last_uplink_total, last_downlink_total, last_seen_at, xray_revision, reset_epoch"


@register("checkpoint_latest", with_views(["s_deltas"], """
SELECT storage_node_id AS node_id, account_uuid,
       arg_max(uplink_total, collected_at) AS last_uplink_total, arg_max(downlink_total, collected_at) AS last_downlink_total,
       max(collected_at) AS last_seen_at, 'rev-1' AS xray_revision, arg_max(reset_epoch, collected_at) AS reset_epoch
FROM s_deltas GROUP BY 1, 2"""))
def q_checkpoint_latest(spark, sf):
    d = metering.counter_deltas(fx.samples(spark, sf), None, FIXTURE_CFG)
    return metering.latest_checkpoints(d, revision="rev-1").select(*cols(CK))


# ---------------------------------------------------------------- A-W9 (policy "last", day grain), A-P7
@register("minute_buckets_last", with_views(["s_deltas"], """
SELECT CAST(date_trunc('day', collected_at) AS TIMESTAMP) AS bucket_start, storage_node_id AS node_id, account_uuid,
       CAST(arg_max(delta_up, collected_at) AS BIGINT) AS uplink_bytes,
       CAST(arg_max(delta_down, collected_at) AS BIGINT) AS downlink_bytes,
       CAST(arg_max(delta_up, collected_at) + arg_max(delta_down, collected_at) AS BIGINT) AS total_bytes,
       count(*) AS snapshots
FROM s_deltas WHERE billable GROUP BY 1, 2, 3"""))
def q_minute_buckets_last(spark, sf):
    """The service's overwrite policy: the later snapshot's delta replaces the bucket value
    (contrasted at day grain, where several snapshots share a bucket)."""
    cfg = RatingConfig(**{**FIXTURE_CFG.__dict__, "minute_policy": "last"})
    d = metering.counter_deltas(fx.samples(spark, sf), None, cfg)
    b = metering.minute_buckets(d, cfg, grain="day")
    return b.select("bucket_start", "node_id", "account_uuid", "uplink_bytes", "downlink_bytes", "total_bytes", "snapshots")


LI = "bucket_start, node_id, account_uuid, region, line_code, id"


@register("ledger_ids", with_views(["s_rated"], f"SELECT {LI} FROM s_rated"))
def q_ledger_ids(spark, sf):
    d = metering.counter_deltas(fx.samples(spark, sf), None, FIXTURE_CFG)
    b = metering.minute_buckets(d, FIXTURE_CFG)
    return b.select(*rating.BUCKET_KEY, rating.ledger_id().alias("id"))


# ---------------------------------------------------------------- A-P8, A-J2, A-J3, A-S11, A-S14
EP = "account_uuid, included_quota_bytes, price_per_byte, multiplier, pricing_rule_version"


@register("effective_pricing", with_views(["v_samples", "m_pricing"], f"""
SELECT a.account_uuid,
       coalesce(p.included_quota_bytes, {DEFAULT_QUOTA}) AS included_quota_bytes,
       coalesce(p.price_per_byte, 1.0 / 2048) AS price_per_byte, coalesce(p.multiplier, 1.0) AS multiplier,
       coalesce(p.pricing_rule_version, 'rev-1') AS pricing_rule_version
FROM (SELECT DISTINCT account_uuid FROM v_samples) a LEFT JOIN m_pricing p USING (account_uuid)"""))
def q_effective_pricing(spark, sf):
    accounts = fx.samples(spark, sf).select("account_uuid").distinct()
    return attach_pricing(accounts, fx.profiles(spark, sf), FIXTURE_CFG).select(*cols(EP))


QS = "account_uuid, included_quota_bytes, seed_remaining, seed_balance, seed_arrears_since, suspend_state, had_quota_row"


@register("quota_seeded_rating", with_views(["v_samples", "m_pricing", "v_quota_states"], f"""
SELECT a.account_uuid, coalesce(p.included_quota_bytes, {DEFAULT_QUOTA}) AS included_quota_bytes,
       CAST(greatest(coalesce(q.remaining_included_quota, p.included_quota_bytes, {DEFAULT_QUOTA}), 0) AS BIGINT) AS seed_remaining,
       coalesce(q.current_balance, 64.0) AS seed_balance, q.arrears_since AS seed_arrears_since,
       coalesce(q.suspend_state, 'active') AS suspend_state, q.account_uuid IS NOT NULL AS had_quota_row
FROM (SELECT DISTINCT account_uuid FROM v_samples) a LEFT JOIN m_pricing p USING (account_uuid)
LEFT JOIN v_quota_states q USING (account_uuid)"""))
def q_quota_seeded_rating(spark, sf):
    accounts = fx.samples(spark, sf).select("account_uuid").distinct()
    priced = attach_pricing(accounts, fx.profiles(spark, sf), FIXTURE_CFG)
    return rating.seed_quota(priced, fx.quota_states(spark, sf), FIXTURE_CFG).select(*cols(QS))


# ---------------------------------------------------------------- A-W6, A-W7, A-P10, A-S12, A-U1
AE = "account_uuid, bucket_start, node_id, balance_after, arrears, arrears_since, throttle_state"


@register("arrears_episodes", with_views(["m_rated"], f"SELECT {AE} FROM m_rated"))
def q_arrears_episodes(spark, sf):
    return metered(spark, sf).rated.select(*cols(AE))


QF = ("account_uuid, remaining_included_quota, current_balance, arrears, arrears_since, throttle_state, suspend_state, "
      "last_rated_bucket_at, effective_at")


@register("quota_state_final", with_views(["m_rated", "v_quota_states"], """
WITH last AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account_uuid
                 ORDER BY bucket_start DESC, node_id DESC, region DESC, line_code DESC) AS rn FROM m_rated) WHERE rn = 1)
SELECT coalesce(l.account_uuid, q.account_uuid) AS account_uuid,
       CASE WHEN l.account_uuid IS NOT NULL THEN l.remaining_after ELSE q.remaining_included_quota END AS remaining_included_quota,
       CASE WHEN l.account_uuid IS NOT NULL THEN l.balance_after ELSE q.current_balance END AS current_balance,
       CASE WHEN l.account_uuid IS NOT NULL THEN l.arrears ELSE q.arrears END AS arrears,
       CASE WHEN l.account_uuid IS NOT NULL THEN l.arrears_since ELSE q.arrears_since END AS arrears_since,
       CASE WHEN l.account_uuid IS NOT NULL THEN l.throttle_state ELSE q.throttle_state END AS throttle_state,
       CASE WHEN l.account_uuid IS NOT NULL THEN l.suspend_state ELSE q.suspend_state END AS suspend_state,
       l.bucket_start AS last_rated_bucket_at, l.last_collected_at AS effective_at
FROM v_quota_states q FULL OUTER JOIN last l USING (account_uuid)"""))
def q_quota_state_final(spark, sf):
    base = fx.quota_states(spark, sf).select(
        "*",
        F.lit(None).cast("timestamp_ntz").alias("last_rated_bucket_at"),
        F.lit(None).cast("timestamp_ntz").alias("effective_at"),
    )
    final = metered(spark, sf).quota_states
    return upsert.keyed_upsert(base, final, ["account_uuid"]).select(*cols(QF))


# ---------------------------------------------------------------- A-S7..A-S10, A-U1..A-U3, A-J4
def prefix_and_full(spark, sf):
    """An earlier run (snapshots before PREFIX_CUT) and a later run over everything.  The time is part of a sample's
    key, so both runs read the same written samples."""
    inbound = fx.inbound(spark, sf)
    before = F.col("collected_at") < F.lit(PREFIX_CUT).cast("timestamp_ntz")
    prof, quota = fx.profiles(spark, sf), fx.quota_states(spark, sf)
    good, bad = metering.validate_samples(inbound)
    samples = materialize(metering.aggregate_inbounds(good))
    early = meter_stored(samples.filter(before), prof, quota, None, FIXTURE_CFG, bad.filter(before))
    full = meter_stored(samples, prof, quota, None, FIXTURE_CFG, bad)
    return early, full


LEDGER = "id, account_uuid, bucket_start, bucket_end, entry_type, rated_bytes, amount_delta, balance_after, pricing_rule_version"


@register("ledger_insert_only", with_views(["p_rated", "m_rated"], f"""
SELECT {LEDGER} FROM p_rated
UNION ALL
SELECT {LEDGER} FROM m_rated WHERE id NOT IN (SELECT id FROM p_rated)"""))
def q_ledger_insert_only(spark, sf):
    early, full = prefix_and_full(spark, sf)
    return upsert.insert_if_absent(early.ledger, full.ledger, ["id"]).select(*cols(LEDGER))


BU = ("bucket_start, node_id, account_uuid, region, line_code, uplink_bytes, downlink_bytes, total_bytes, multiplier, "
      "rating_status, source_revision")
BK = "bucket_start, node_id, account_uuid, region, line_code"


@register("bucket_upsert", with_views(["p_rated", "m_rated"], f"""
SELECT {', '.join('coalesce(n.%s, o.%s) AS %s' % (c, c, c) for c in cols(BK))},
       {', '.join('CASE WHEN n.bucket_start IS NOT NULL THEN n.%s ELSE o.%s END AS %s' % (c, c, c) for c in cols(BU) if c not in cols(BK))}
FROM (SELECT {BU} FROM p_rated) o FULL OUTER JOIN (SELECT {BU} FROM m_rated) n
  ON o.bucket_start = n.bucket_start AND o.node_id = n.node_id AND o.account_uuid = n.account_uuid
 AND o.region = n.region AND o.line_code = n.line_code"""))
def q_bucket_upsert(spark, sf):
    early, full = prefix_and_full(spark, sf)
    base = rating.bucket_rows(early.rated)
    return upsert.keyed_upsert(base, rating.bucket_rows(full.rated), list(rating.BUCKET_KEY)).select(*cols(BU))


@register("bucket_replayed", with_views(["p_rated", "m_rated"], f"""
SELECT {BK}, EXISTS (SELECT 1 FROM p_rated p WHERE p.bucket_start = m.bucket_start AND p.node_id = m.node_id
                     AND p.account_uuid = m.account_uuid AND p.region = m.region AND p.line_code = m.line_code) AS existed
FROM m_rated m"""))
def q_bucket_replayed(spark, sf):
    early, full = prefix_and_full(spark, sf)
    return upsert.with_existed(full.rated.select(*rating.BUCKET_KEY), early.rated, list(rating.BUCKET_KEY)).select(
        *cols(BK), "existed"
    )


@register("job_counters", with_views(["p_rated", "m_rated", "m_deltas"], """
SELECT (SELECT count(*) FROM m_deltas WHERE billable) AS processed_samples,
       (SELECT count(*) FROM m_rated WHERE id NOT IN (SELECT id FROM p_rated)) AS written_minutes,
       (SELECT 2 * count(*) FROM m_rated WHERE id IN (SELECT id FROM p_rated)) AS replayed_minutes"""))
def q_job_counters(spark, sf):
    early, full = prefix_and_full(spark, sf)
    keys = list(rating.BUCKET_KEY)
    bflags = upsert.with_existed(full.rated.select(*keys), early.rated, keys)
    lflags = upsert.with_existed(full.ledger.select("id"), early.ledger, ["id"])
    return upsert.replay_counters(bflags, lflags, full.deltas.filter("billable"))


# ---------------------------------------------------------------- A-S13, A-T7
QCOLS = "account_uuid, remaining_included_quota, current_balance, arrears, arrears_since, throttle_state, suspend_state"


@register("arrears_accounts", with_views(["v_quota_states"], f"""
SELECT {QCOLS} FROM v_quota_states WHERE arrears AND suspend_state <> 'suspended'"""))
def q_arrears_accounts(spark, sf):
    return lifecycle.arrears_accounts(fx.quota_states(spark, sf)).select(*cols(QCOLS))


@register("suspension_sweep", with_views(["v_quota_states"], f"""
WITH s AS (
  SELECT *, coalesce(arrears AND suspend_state <> 'suspended' AND arrears_since IS NOT NULL
                     AND arrears_since <= TIMESTAMP '{SWEEP_AS_OF}' - INTERVAL 14 DAYS, false) AS suspended_now
  FROM v_quota_states)
SELECT account_uuid, remaining_included_quota, current_balance, arrears, arrears_since, throttle_state,
       CASE WHEN suspended_now THEN 'suspended' ELSE suspend_state END AS suspend_state, suspended_now
FROM s"""))
def q_suspension_sweep(spark, sf):
    return lifecycle.suspension_sweep(fx.quota_states(spark, sf), SWEEP_AS_OF, 14).select(*cols(QCOLS), "suspended_now")


# ---------------------------------------------------------------- A-P2, A-P5
def raw_snapshots(spark, sf):
    """Snapshot headers as pushed, with some blank / missing fields (derived from events)."""
    s = fx.samples(spark, sf)
    e = F.col("event_id")
    return s.select(
        "event_id",
        F.when(e % 61 == 0, F.lit(None).cast("timestamp_ntz")).otherwise(F.col("collected_at")).alias("collected_at"),
        F.when(e % 53 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("node_id"), F.lit(" "))).alias("node_id"),
        F.when(e % 59 == 0, F.lit("")).when(e % 7 == 0, F.lit(" ")).otherwise(F.col("env")).alias("env"),
    )


RAW_SNAP_SQL = """
SELECT event_id, CASE WHEN event_id % 61 = 0 THEN NULL ELSE collected_at END AS collected_at,
       CASE WHEN event_id % 53 = 0 THEN '  ' ELSE ' ' || node_id || ' ' END AS node_id,
       CASE WHEN event_id % 59 = 0 THEN '' WHEN event_id % 7 = 0 THEN ' ' ELSE env END AS env
FROM v_samples"""


@register("snapshot_validation", with_views(["v_samples"], f"""
WITH r AS ({RAW_SNAP_SQL})
SELECT event_id, CASE WHEN collected_at IS NULL THEN 'snapshot collected_at is required'
                      WHEN coalesce({t('node_id')}, '') = '' THEN 'snapshot node_id is required'
                      WHEN coalesce({t('env')}, '') = '' THEN 'snapshot env is required' END AS reject_reason
FROM r"""))
def q_snapshot_validation(spark, sf):
    return raw_snapshots(spark, sf).select("event_id", metering.snapshot_reject_reason().alias("reject_reason"))


@register("node_identity", with_views(["v_samples"], f"""
WITH r AS ({RAW_SNAP_SQL})
SELECT event_id, CASE WHEN coalesce({t('env')}, '') = '' THEN {t('node_id')} ELSE {t('env')} || ':' || {t('node_id')} END
       AS storage_node_id
FROM r"""))
def q_node_identity(spark, sf):
    from meterwise.functions.text import storage_node_id

    return raw_snapshots(spark, sf).select("event_id", storage_node_id(F.col("env"), F.col("node_id")).alias("storage_node_id"))


# ---------------------------------------------------------------- A-S1, A-P3, A-P4, A-J5, A-T1..A-T3, A-S15, A-S16
def sourced(spark, sf, since=None, until=None):
    """Snapshots with the source they were pulled from (source ``sN`` serves ``node-N``)."""
    return fx.samples(spark, sf, since, until).withColumn("source_id", F.concat(F.lit("s"), F.substring("node_id", 6, 10)))


SOURCED_SQL = "SELECT *, 's' || substr(node_id, 6) AS source_id FROM v_samples"
IDENT_SQL = f"""
flagged AS (
  SELECT s.*, CASE WHEN r.expected_node_id <> '' AND {t('s.node_id')} <> r.expected_node_id
                   THEN 'source ' || s.source_id || ' expected node_id "' || r.expected_node_id || '", got "' || {t('s.node_id')} || '"'
                   WHEN r.expected_env <> '' AND {t('s.env')} <> r.expected_env
                   THEN 'source ' || s.source_id || ' expected env "' || r.expected_env || '", got "' || {t('s.env')} || '"' END AS mismatch
  FROM SRC s JOIN v_registry r ON s.source_id = r.source_id AND coalesce(r.enabled, true)),
ident AS (
  SELECT r.source_id, CAST(coalesce(count(f.source_id), 0) AS BIGINT) AS snapshots,
         CAST(count(f.mismatch) AS BIGINT) AS mismatches,
         CASE WHEN count(f.mismatch) > 0 THEN 'error' ELSE 'ok' END AS status,
         arg_min(f.mismatch, f.collected_at) FILTER (WHERE f.mismatch IS NOT NULL) AS error
  FROM v_registry r LEFT JOIN flagged f ON f.source_id = r.source_id
  WHERE coalesce(r.enabled, true) GROUP BY r.source_id)"""


@register("source_identity_check", with_views(["v_samples", "v_registry"], f"""
WITH src AS ({SOURCED_SQL}), {IDENT_SQL.replace('SRC', 'src')}
SELECT source_id, snapshots, mismatches, status, error FROM ident"""))
def q_source_identity_check(spark, sf):
    return sync.source_identity(sourced(spark, sf), fx.registry(spark))


def sync_state(spark, sf):
    """Source sync rows as an earlier run left them: completed up to its last snapshot
    before SYNC_CUT."""
    s = sourced(spark, sf).filter(F.col("collected_at") < F.lit(SYNC_CUT).cast("timestamp_ntz"))
    return s.groupBy("source_id").agg(F.max("collected_at").alias("last_completed_until"))


WINDOW_SQL = f"""
state AS (SELECT source_id, max(collected_at) AS last_completed_until FROM src
          WHERE collected_at < TIMESTAMP '{SYNC_CUT}' GROUP BY 1),
win AS (
  SELECT r.source_id, st.last_completed_until AS previous_until,
         coalesce(st.last_completed_until, date_trunc('minute', TIMESTAMP '{WINDOW_AS_OF}') - INTERVAL 1 MINUTE) - INTERVAL 120 SECONDS AS since,
         CAST(date_trunc('minute', TIMESTAMP '{WINDOW_AS_OF}') - INTERVAL 1 MINUTE AS TIMESTAMP) AS until
  FROM v_registry r LEFT JOIN state st USING (source_id) WHERE coalesce(r.enabled, true))"""


@register("source_window", with_views(["v_samples", "v_registry"], f"""
WITH src AS ({SOURCED_SQL}), {WINDOW_SQL}
SELECT source_id, previous_until, CAST(since AS TIMESTAMP) AS since, until, since > until AS noop FROM win"""))
def q_source_window(spark, sf):
    return sync.source_windows(sync_state(spark, sf), fx.registry(spark), WINDOW_AS_OF)


@register("window_scan", with_views(["v_samples", "v_registry"], f"""
WITH src AS ({SOURCED_SQL}), {WINDOW_SQL}
SELECT s.event_id, s.source_id, s.collected_at FROM src s JOIN win w ON s.source_id = w.source_id
WHERE s.collected_at BETWEEN w.since AND w.until"""))
def q_window_scan(spark, sf):
    """A-S1: the bounds of all windows are folded into literals, so the scan reads no week outside of them."""
    w = materialize(sync.source_windows(sync_state(spark, sf), fx.registry(spark), WINDOW_AS_OF))
    return landing.in_windows(sourced(spark, sf, *landing.bounds(w)), w).select("event_id", "source_id", "collected_at")


@register("source_watermark", with_views(["v_samples", "v_registry"], f"""
WITH src AS ({SOURCED_SQL}), {WINDOW_SQL},
inwin AS (SELECT s.* FROM src s JOIN win w ON s.source_id = w.source_id WHERE s.collected_at BETWEEN w.since AND w.until),
{IDENT_SQL.replace('SRC', 'inwin')},
last AS (SELECT source_id, max(collected_at) AS last_processed FROM inwin GROUP BY 1)
SELECT w.source_id,
       CASE WHEN i.status = 'error' THEN w.previous_until
            ELSE greatest(w.previous_until, CASE WHEN w.since > w.until THEN w.until
                                                 ELSE least(w.until, coalesce(l.last_processed, w.until)) END) END AS last_completed_until,
       CASE WHEN i.status = 'error' THEN i.error ELSE '' END AS last_error,
       coalesce(i.status = 'error', false) AS failed
FROM win w LEFT JOIN last l USING (source_id) LEFT JOIN ident i USING (source_id)"""))
def q_source_watermark(spark, sf):
    reg = fx.registry(spark)
    w = materialize(sync.source_windows(sync_state(spark, sf), reg, WINDOW_AS_OF))
    return sync.advance_watermarks(w, sourced(spark, sf, *landing.bounds(w)), reg)


# ---------------------------------------------------------------- A-A5
@register("job_status", with_views(["v_samples", "v_registry", "m_flagged", "m_deltas", "m_buckets"], f"""
WITH src AS ({SOURCED_SQL}), {IDENT_SQL.replace('SRC', 'src')},
agg AS (
  SELECT (SELECT count(*) FROM ident) AS sources_enabled,
         (SELECT count(*) FROM ident WHERE status = 'error') AS sources_failed,
         (SELECT string_agg(error, '; ' ORDER BY source_id) FROM ident WHERE status = 'error') AS source_errors,
         (SELECT count(*) FROM m_flagged WHERE reject_reason IS NOT NULL) AS invalid_samples,
         (SELECT count(*) FROM m_deltas WHERE billable) AS processed_samples,
         (SELECT count(*) FROM m_buckets) AS written_minutes,
         CAST(0 AS BIGINT) AS replayed_minutes)
SELECT CASE WHEN sources_enabled = 0 THEN 'error'
            WHEN sources_failed > 0 AND processed_samples = 0 AND written_minutes = 0 AND replayed_minutes = 0
                 AND invalid_samples = 0 THEN 'error'
            WHEN sources_failed > 0 THEN 'partial'
            WHEN invalid_samples > 0 THEN 'partial' ELSE 'ok' END AS status,
       concat_ws('; ', CASE WHEN invalid_samples > 0 THEN printf('%d invalid sample uuid(s)', invalid_samples) END,
                 CASE WHEN sources_enabled = 0 THEN 'no enabled exporter sources configured' END,
                 CASE WHEN source_errors <> '' THEN source_errors END) AS error,
       sources_enabled, sources_failed, invalid_samples, processed_samples, written_minutes, replayed_minutes
FROM agg"""))
def q_job_status(spark, sf):
    r = metered(spark, sf)
    counters = (
        r.deltas.filter("billable").select(F.lit("p").alias("k"))
        .unionByName(r.buckets.select(F.lit("w").alias("k")))
        .agg(
            F.sum(F.when(F.col("k") == "p", 1).otherwise(0)).cast("long").alias("processed_samples"),
            F.sum(F.when(F.col("k") == "w", 1).otherwise(0)).cast("long").alias("written_minutes"),
            F.lit(0).cast("long").alias("replayed_minutes"),
        )
    )
    src = sync.source_identity(sourced(spark, sf), fx.registry(spark))
    return status.pull_job_status(src, r.quarantine, counters)


# ---------------------------------------------------------------- A-T4, A-T8
@register("replay_convergence", with_views(["s_rated"], f"SELECT {LEDGER} FROM s_rated"))
def q_replay_convergence(spark, sf):
    """Every fifth snapshot delivered twice: the ledger equals the clean run's."""
    r = meter_samples(fx.replayed_samples(spark, sf), fx.profiles(spark, sf), fx.quota_states(spark, sf), None, FIXTURE_CFG)
    return r.ledger.select(*cols(LEDGER))


# ---------------------------------------------------------------- A-S3
@register("reject_excerpt", f"""
SELECT doc_id, CASE WHEN length({t('text')}) > 120 THEN substr({t('text')}, 1, 120) || '...' ELSE {t('text')} END AS excerpt,
       length(text) AS body_chars
FROM documents""")
def q_reject_excerpt(spark, sf):
    """Bodies that do not decode as snapshots (document texts) -> bounded excerpt."""
    from meterwise.functions.text import excerpt
    from meterwise.sources.tables import table

    d = table(spark, sf, "documents")
    return d.select("doc_id", excerpt(F.col("text"), 120).alias("excerpt"), F.length("text").alias("body_chars"))


# ---------------------------------------------------------------- A-C1..A-C5, A-A2..A-A4, A-P11..A-P13
COSTS = "provider, account_id, service_name, region, usage_start_time, usage_end_time, cost_amount, currency"


def cost_sql(provider: str, as_of: str | None) -> str:
    win = ""
    if as_of:
        start = f"date_trunc('day', TIMESTAMP '{as_of}') - INTERVAL 2 DAYS"
        end = f"date_trunc('day', TIMESTAMP '{as_of}') - INTERVAL 1 DAY"
        win = (f"AND usage_start_time >= {start} AND usage_start_time < {end}" if provider != "azure"
               else f"AND usage_start_time >= {start} AND usage_start_time + INTERVAL 1 DAY <= {end}")
    day = "CAST(date_trunc('day', usage_start_time) AS TIMESTAMP)"
    tail = f"{day} + INTERVAL 1 DAY AS usage_end_time"
    if provider == "aws":
        return f"""
SELECT 'aws' AS provider, account_id, service_name, region, {day} AS usage_start_time, {tail},
       CAST(sum(TRY_CAST(amount AS DECIMAL(38,12))) AS DECIMAL(38,12)) AS cost_amount, currency
FROM v_cost_lines WHERE provider = 'aws' {win}
GROUP BY 2, 3, 4, 5, 6, 8 HAVING sum(TRY_CAST(amount AS DECIMAL(38,12))) <> 0"""
    if provider == "gcp":
        return f"""
SELECT 'gcp' AS provider, account_id, service_name, CASE WHEN coalesce(region, '') = '' THEN 'global' ELSE region END AS region,
       {day} AS usage_start_time, {tail}, CAST(sum(amount) AS DECIMAL(38,12)) AS cost_amount, currency
FROM v_cost_lines WHERE provider = 'gcp' {win}
GROUP BY 2, 3, 4, 5, 6, 8 HAVING sum(amount) <> 0"""
    return f"""
SELECT 'azure' AS provider, account_id, coalesce(service_name, 'Unknown') AS service_name,
       coalesce(region, 'Unknown') AS region, {day} AS usage_start_time, {tail},
       CAST(sum(amount) AS DECIMAL(38,12)) AS cost_amount, currency
FROM v_cost_lines WHERE provider = 'azure' AND amount IS NOT NULL AND amount <> 0 {win}
GROUP BY 2, 3, 4, 5, 6, 8"""


@register("cost_aws", with_views(["v_cost_lines"], cost_sql("aws", COST_AS_OF)))
def q_cost_aws(spark, sf):
    return costs.normalize_aws(fx.cost_lines(spark, sf), COST_AS_OF).select(*cols(COSTS))


@register("cost_gcp", with_views(["v_cost_lines"], cost_sql("gcp", COST_AS_OF)))
def q_cost_gcp(spark, sf):
    return costs.normalize_gcp(fx.cost_lines(spark, sf), COST_AS_OF).select(*cols(COSTS))


@register("cost_azure", with_views(["v_cost_lines"], cost_sql("azure", COST_AS_OF)))
def q_cost_azure(spark, sf):
    return costs.normalize_azure(fx.cost_lines(spark, sf), COST_AS_OF).select(*cols(COSTS))


# The vendors' own row shapes, built from the cost lines: nested BigQuery export rows, and Azure usage
# details whose amount and category sit in other fields for legacy and modern rows (and in neither for a
# third kind, which carries no cost).
AZURE_KIND = "CASE WHEN resource_id % 13 = 0 THEN 'other' ELSE kind END"
AZURE_SHAPES_SQL = cost_sql("azure", None).replace("amount IS NOT NULL", f"{AZURE_KIND} <> 'other' AND amount IS NOT NULL")


def azure_usage(spark, sf):
    """Usage details: the fields of the other kind are filled with values that must not be read."""
    l = fx.cost_lines(spark, sf).filter(F.col("provider") == "azure").withColumn("kind", F.expr(AZURE_KIND))
    legacy, modern = F.col("kind") == "legacy", F.col("kind") == "modern"
    wrong = F.lit(-1).cast("decimal(18,2)")
    return l.select(
        "kind", F.col("account_id").alias("subscription_id"), "usage_start_time",
        F.struct(
            F.when(legacy, F.col("amount")).otherwise(wrong).alias("cost"),
            F.when(modern, F.col("amount")).otherwise(wrong).alias("costInBillingCurrency"),
            F.when(legacy, F.struct(F.col("service_name").alias("meterCategory"))).alias("meterDetails"),
            F.when(modern, F.col("service_name")).otherwise(F.lit("wrong")).alias("meterCategory"),
            F.when(legacy, F.col("currency")).alias("billingCurrency"),
            F.when(modern, F.col("currency")).alias("billingCurrencyCode"),
            F.col("region").alias("resourceLocation"),
        ).alias("properties"),
    )


@register("cost_azure_shapes", with_views(["v_cost_lines"], AZURE_SHAPES_SQL))
def q_cost_azure_shapes(spark, sf):
    """A-A4: legacy and modern usage details give the same rows as the flat feed; other kinds cost nothing."""
    return costs.normalize_azure(costs.flatten_azure(azure_usage(spark, sf))).select(*cols(COSTS))


@register("cost_azure_usd", with_views(["v_cost_lines"], AZURE_SHAPES_SQL.replace(
    "AS cost_amount, currency", "AS cost_amount, 'USD' AS currency").replace("GROUP BY 2, 3, 4, 5, 6, 8", "GROUP BY 2, 3, 4, 5, 6")))
def q_cost_azure_usd(spark, sf):
    """A-A4 with the importer's literal currency: every row is labelled USD, whatever it was billed in."""
    return costs.normalize_azure(costs.flatten_azure(azure_usage(spark, sf)), azure_force_usd=True).select(*cols(COSTS))


@register("cost_gcp_nested", with_views(["v_cost_lines"], cost_sql("gcp", None)))
def q_cost_gcp_nested(spark, sf):
    """A-A3: billing-export rows with nested service and location."""
    l = fx.cost_lines(spark, sf).filter(F.col("provider") == "gcp")
    export = l.select(
        F.col("account_id").alias("billing_account_id"), "usage_start_time", "currency", F.col("amount").alias("cost"),
        F.struct(F.col("service_name").alias("description")).alias("service"),
        F.struct("region").alias("location"),
    )
    return costs.normalize_gcp(costs.flatten_gcp(export)).select(*cols(COSTS))


UNIFIED_SQL = " UNION ALL ".join(f"({cost_sql(p, None)})" for p in ("aws", "gcp", "azure"))


@register("cost_unified", with_views(["v_cost_lines"], UNIFIED_SQL))
def q_cost_unified(spark, sf):
    return costs.unified_costs(fx.cost_lines(spark, sf)).select(*cols(COSTS))


# cost_upsert: the stored table is an earlier load of the legacy-shaped lines before
# 1998-01-01 (created 2024-01-01); the new batch is every line from 1997-07-01 on.
OLD_LOAD_END = "1998-01-01 00:00:00"
NEW_LOAD_START = "1997-07-01 00:00:00"
CU = "id, provider, account_id, service_name, region, usage_start_time, usage_end_time, cost_amount, currency, created_at, updated_at"


def _cost_upsert_sql() -> str:
    from meterwise.plans.oracle import uuid5

    old_lines = f"(SELECT * FROM v_cost_lines WHERE kind = 'legacy' AND usage_start_time < TIMESTAMP '{OLD_LOAD_END}')"
    new_lines = f"(SELECT * FROM v_cost_lines WHERE usage_start_time >= TIMESTAMP '{NEW_LOAD_START}')"

    def unified(src: str) -> str:
        return " UNION ALL ".join(f"({cost_sql(p, None).replace('FROM v_cost_lines', 'FROM ' + src + ' l')})" for p in ("aws", "gcp", "azure"))

    key = ("provider || '|' || account_id || '|' || service_name || '|' || region || '|' || "
           "strftime(usage_start_time, '%Y-%m-%dT%H:%M:%SZ') || '|' || currency")
    keys = ["provider", "account_id", "service_name", "region", "usage_start_time", "currency"]
    on = " AND ".join(f"o.{k} = n.{k}" for k in keys)
    return f"""
WITH o AS (SELECT {uuid5(key)} AS id, *, TIMESTAMP '2024-01-01 00:00:00' AS created_at,
                  TIMESTAMP '2024-01-01 00:00:00' AS updated_at FROM ({unified(old_lines)})),
     n AS (SELECT {uuid5(key)} AS id, * FROM ({unified(new_lines)}))
SELECT coalesce(o.id, n.id) AS id, {', '.join(f'coalesce(n.{k}, o.{k}) AS {k}' for k in keys)},
       CASE WHEN n.id IS NOT NULL THEN n.usage_end_time ELSE o.usage_end_time END AS usage_end_time,
       CASE WHEN n.id IS NOT NULL THEN n.cost_amount ELSE o.cost_amount END AS cost_amount,
       coalesce(o.created_at, TIMESTAMP '2024-02-01 00:00:00') AS created_at,
       CASE WHEN n.id IS NOT NULL THEN TIMESTAMP '2024-02-01 00:00:00' ELSE o.updated_at END AS updated_at
FROM o FULL OUTER JOIN n ON {on}"""


@register("cost_upsert", with_views(["v_cost_lines"], _cost_upsert_sql()))
def q_cost_upsert(spark, sf):
    lines = fx.cost_lines(spark, sf)
    old = costs.unified_costs(
        lines.filter((F.col("kind") == "legacy") & (F.col("usage_start_time") < F.lit(OLD_LOAD_END).cast("timestamp_ntz")))
    )
    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    base = old.select(costs.cost_id().alias("id"), "*", stamp.alias("created_at"), stamp.alias("updated_at"))
    new = costs.unified_costs(lines.filter(F.col("usage_start_time") >= F.lit(NEW_LOAD_START).cast("timestamp_ntz")))
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    batch = new.select(costs.cost_id().alias("id"), "*", now.alias("created_at"))
    out = upsert.keyed_upsert(
        base, batch, list(costs.COST_KEY), keep=["id", "created_at"], touched_col="updated_at", touched_at=now
    )
    return out.select(*cols(CU))


# ---------------------------------------------------------------- A-S2 (round trip through pushed bodies)
SD = "event_id, collected_at, node_id, env, pos, uuid, email, inbound_tag, uplink_bytes_total, downlink_bytes_total"


@register("snapshot_decode", with_views(["v_inbound"], f"SELECT {SD} FROM v_inbound"))
def q_snapshot_decode(spark, sf):
    """Every fixture snapshot is pushed as a JSON body (a bare object, or a one-element
    array for every third event), decoded whole and flattened back to inbound rows."""
    from meterwise.sources.snapshots import decode_bodies, flatten

    ib = fx.inbound(spark, sf)
    sample = F.struct("uuid", "email", "inbound_tag", "uplink_bytes_total", "downlink_bytes_total")
    snaps = ib.groupBy("event_id", "collected_at", "node_id", "env").agg(
        F.array_sort(F.collect_list(F.struct("pos", sample.alias("s")))).alias("entries")  # two entries per snapshot
    )
    obj = F.to_json(F.struct(
        F.date_format("collected_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("collected_at"),
        "node_id", "env", F.col("entries.s").alias("samples"),
    ))
    body = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("["), obj, F.lit("]"))).otherwise(obj)
    good, _ = decode_bodies(snaps.select(F.col("event_id").alias("body_id"), body.alias("body")))
    flat = flatten(good.withColumnRenamed("body_id", "event_id"), keep=("event_id",))
    return flat.select(*cols(SD))
