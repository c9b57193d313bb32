"""Cases transcribed from the metered service's own tests (FIXTURES.md section 2)."""

import pytest
from pyspark.sql import functions as F

from helpers import A, B, checkpoints, inbound
from meterwise.config import RatingConfig
from meterwise.plans.metering_job import meter_inbound

# the service tests' defaults: price 0.5, quota 0, balance 0, revision rating-rev-1
CFG = RatingConfig(price_per_byte=0.5, included_quota_bytes=0, initial_balance=0.0, source_revision="rating-rev-1")
PROFILE = ("account_uuid string, included_quota_bytes bigint, base_price_per_byte double, region_multiplier double, "
           "line_multiplier double, pricing_rule_version string")


@pytest.fixture(params=["day", None], ids=["two-level", "plain"])
def cfg(request):
    return RatingConfig(**{**CFG.__dict__, "chunk": request.param})


def run(spark, rows, cfg, profiles=None, ck=None, quota=None):
    return meter_inbound(inbound(spark, rows), profiles, quota, ck, cfg)


def test_f1_first_sample_bills_full_value(spark, cfg):
    r = run(spark, [("2026-07-13 10:30:15", "jp-node", "prod", [(A, "", "xhttp", 100, 50)])], cfg)
    rows = r.rated.collect()
    assert len(rows) == 1 and rows[0].total_bytes == 150 and rows[0].balance_after == -75.0
    assert rows[0].node_id == "prod:jp-node" and rows[0].bucket_start.minute == 30


def test_f2_profile_quota_and_multipliers(spark, cfg):
    prof = spark.createDataFrame([(A, 100, 0.5, 1.2, 2.0, "pricing-v2")], PROFILE)
    r = run(spark, [("2026-07-13 10:30:15", "jp-node", "prod", [(A, "", "xhttp", 100, 50)])], cfg, profiles=prof)
    row = r.rated.collect()[0]
    assert row.remaining_after == 0 and row.rated_bytes == 50
    assert row.multiplier == pytest.approx(2.4) and row.amount_delta == pytest.approx(-60.0)
    assert row.balance_after == pytest.approx(-60.0) and row.pricing_rule_version == "pricing-v2"


def test_f3_replayed_snapshot_changes_nothing(spark, cfg):
    snap = ("2026-07-13 10:30:15", "jp-node", "prod", [(A, "", "xhttp", 100, 50)])
    r = run(spark, [snap, snap], cfg)
    assert r.ledger.count() == 1
    row = r.rated.collect()[0]
    assert row.total_bytes == 150 and row.amount_delta == -75.0


def test_f4_counter_reset_with_checkpoint(spark, cfg):
    ck = checkpoints(spark, [("prod:jp-node", A, 200, 200, "2026-07-13 10:29:00", 0)])
    r = run(spark, [("2026-07-13 10:30:15", "jp-node", "prod", [(A, "", "xhttp", 10, 20)])], cfg, ck=ck)
    assert r.buckets.count() == 0 and r.ledger.count() == 0
    c = r.checkpoints.collect()[0]
    assert (c.last_uplink_total, c.last_downlink_total, c.reset_epoch) == (10, 20, 1)


def test_f5_delta_against_checkpoint(spark, cfg):
    ck = checkpoints(spark, [("prod:jp-node", A, 100, 100, "2026-07-13 10:29:00", 0)])
    r = run(spark, [("2026-07-13 10:30:15", "jp-node", "prod", [(A, "", "xhttp", 130, 140)])], cfg, ck=ck)
    assert r.buckets.collect()[0].total_bytes == 70


def test_f6_same_node_two_envs(spark, cfg):
    rows = [("2026-07-13 10:30:15", "jp-node", "prod", [(A, "", "xhttp", 100, 50)]),
            ("2026-07-13 10:30:15", "jp-node", "preview", [(A, "", "xhttp", 100, 50)])]
    r = run(spark, rows, cfg)
    assert r.buckets.count() == 2
    q = r.quota_states.collect()
    assert len(q) == 1 and q[0].current_balance == -150.0


def test_f9_multi_inbound_rollup(spark):
    from meterwise.operators import metering

    df = inbound(spark, [("2026-07-13 10:30:15", "jp-node", "prod",
                          [(A, "a@example.com", "xhttp", 100, 50), (A, "", "tcp", 30, 20), (B, "", "xhttp", 5, 5)])])
    good, bad = metering.validate_samples(df)
    s = {r.account_uuid: r for r in metering.aggregate_inbounds(good).collect()}
    assert (s[A].uplink_total, s[A].downlink_total, s[A].email) == (130, 70, "a@example.com")
    assert (s[B].uplink_total, s[B].downlink_total) == (5, 5) and bad.count() == 0


def test_f10_invalid_uuid_is_quarantined(spark, cfg):
    rows = [("2026-07-13 10:30:15", "jp-node", "prod", [("not-a-uuid", "", "xhttp", 100, 50), (A, "", "tcp", 30, 0)])]
    r = run(spark, rows, cfg)
    q = r.quarantine.collect()
    assert len(q) == 1 and q[0].reject_reason == "sample uuid is not a valid UUID"
    assert [x.account_uuid for x in r.buckets.collect()] == [A]


def test_uuid_forms_canonicalised(spark):
    from meterwise.functions.ids import canonical_uuid

    forms = [A.upper(), "{" + A + "}", "urn:uuid:" + A, A.replace("-", ""), "x" * 36, ""]
    df = spark.createDataFrame([(f,) for f in forms], "u string")
    got = [r.c for r in df.select(canonical_uuid(F.col("u")).alias("c")).collect()]
    assert got == [A, A, A, A, None, None]


def test_f13_two_minutes(spark, cfg):
    rows = [("2026-07-13 10:30:10", "jp-node", "prod", [(A, "", "xhttp", 100, 0), (A, "", "tcp", 50, 0)]),
            ("2026-07-13 10:31:10", "jp-node", "prod", [(A, "", "xhttp", 120, 0), (A, "", "tcp", 60, 0)])]
    r = run(spark, rows, cfg)
    got = [x.uplink_bytes for x in r.buckets.orderBy("bucket_start").collect()]
    assert got == [150, 30]
    assert r.checkpoints.collect()[0].reset_epoch == 0


def test_f14_lower_total_is_a_reset(spark, cfg):
    ck = checkpoints(spark, [("prod:jp-node", A, 150, 0, "2026-07-13 10:29:00", 0)])
    r = run(spark, [("2026-07-13 10:30:15", "jp-node", "prod", [(A, "", "xhttp", 120, 0)])], cfg, ck=ck)
    assert r.buckets.count() == 0
    c = r.checkpoints.collect()[0]
    assert (c.last_uplink_total, c.reset_epoch) == (120, 1)


def test_f25_included_quota(spark, cfg):
    c = RatingConfig(**{**cfg.__dict__, "included_quota_bytes": 1000})
    r = run(spark, [("2026-07-13 10:30:15", "jp-node", "prod", [(A, "", "xhttp", 100, 50)])], c)
    row = r.rated.collect()[0]
    assert row.amount_delta == 0.0 and row.remaining_after == 850


def test_quota_across_minutes_and_arrears(spark, cfg):
    c = RatingConfig(**{**cfg.__dict__, "included_quota_bytes": 200, "initial_balance": 30.0})
    rows = [(f"2026-07-13 10:3{i}:00", "jp-node", "prod", [(A, "", "xhttp", 100 * (i + 1), 0)]) for i in range(4)]
    r = run(spark, rows, c).rated.orderBy("bucket_start").collect()
    assert [x.rated_bytes for x in r] == [0, 0, 100, 100]
    assert [x.balance_after for x in r] == [30.0, 30.0, -20.0, -70.0]
    assert [x.arrears for x in r] == [False, False, True, True]
    assert r[2].arrears_since == r[3].arrears_since == r[2].last_collected_at


def test_late_snapshot_is_not_billed(spark, cfg):
    ck = checkpoints(spark, [("prod:jp-node", A, 100, 0, "2026-07-13 10:30:00", 0)])
    rows = [("2026-07-13 10:29:00", "jp-node", "prod", [(A, "", "xhttp", 90, 0)]),
            ("2026-07-13 10:31:00", "jp-node", "prod", [(A, "", "xhttp", 130, 0)])]
    r = run(spark, rows, cfg, ck=ck)
    d = {x.collected_at.minute: x for x in r.deltas.collect()}
    assert d[29].is_late and not d[29].billable
    assert d[31].delta_up == 30 and d[31].reset_epoch == 0


def test_accounts_of_one_instant_in_two_snapshots_all_stay(spark, cfg):
    rows = [("2026-07-13 10:30:15", "jp-node", "prod", [(A, "", "xhttp", 100, 0)]),
            ("2026-07-13 10:30:15", "jp-node", "prod", [(B, "", "xhttp", 70, 0)]),
            ("2026-07-13 10:30:15", "jp-node", "prod", [(A, "", "tcp", 5, 0)])]
    got = {x.account_uuid: x.total_bytes for x in run(spark, rows, cfg).buckets.collect()}
    assert got == {A: 105, B: 70}


def test_unequal_totals_of_one_instant_are_differenced(spark, cfg):
    from meterwise.operators.metering import counter_deltas

    rows = [("2026-07-13 10:30:15", 100), ("2026-07-13 10:30:15", 160), ("2026-07-13 10:30:15", 160), ("2026-07-13 10:31:15", 200)]
    s = spark.createDataFrame([("n", A, t, up, 0) for t, up in rows],
                              "storage_node_id string, account_uuid string, t string, uplink_total bigint, downlink_total bigint")
    s = s.withColumn("collected_at", F.col("t").cast("timestamp_ntz")).drop("t")
    d = counter_deltas(s, None, cfg).filter("billable").collect()
    assert sorted(x.delta_up for x in d) == [40, 60, 100]


def test_second_reading_of_the_checkpoint_instant(spark, cfg):
    ck = checkpoints(spark, [("prod:jp-node", A, 100, 0, "2026-07-13 10:30:00", 0)])
    rows = [("2026-07-13 10:30:00", "jp-node", "prod", [(A, "", "xhttp", 130, 0)]),
            ("2026-07-13 10:31:00", "jp-node", "prod", [(A, "", "xhttp", 150, 0)])]
    assert sorted(x.delta_up for x in run(spark, rows, cfg, ck=ck).deltas.filter("billable").collect()) == [20, 30]
    replay = run(spark, [("2026-07-13 10:30:00", "jp-node", "prod", [(A, "", "xhttp", 100, 0)])], cfg, ck=ck)
    assert [x.is_late for x in replay.deltas.collect()] == [True] and replay.buckets.count() == 0


def test_snapshot_without_time_is_quarantined(spark, cfg):
    df = inbound(spark, [("2026-07-13 10:30:15", "jp-node", "prod", [(A, "", "xhttp", 100, 0)])])
    df = df.unionByName(df.withColumn("collected_at", F.lit(None).cast("timestamp_ntz")))
    r = meter_inbound(df, None, None, None, cfg)
    assert [x.reject_reason for x in r.quarantine.collect()] == ["snapshot collected_at is required"]
    assert r.buckets.count() == 1


def busy_and_quiet(spark):
    """A has 40 samples over ten days with two resets, B two."""
    rows = [(f"2026-07-{1 + i // 4:02d} 0{i % 4}:00:00", "n", "prod", [(A, "", "xhttp", 100 * (i % 17), 7 * (i % 17))]) for i in range(40)]
    return inbound(spark, rows + [(f"2026-07-0{d} 05:00:00", "n", "prod", [(B, "", "xhttp", 50 * d, d)]) for d in (1, 3)])


def test_accounts_that_fit_a_task_are_metered_without_further_copies(spark, monkeypatch):
    def refuse(df):
        raise AssertionError("a two-level window wrote its input")

    monkeypatch.setattr("meterwise.functions.prefix.materialize", refuse)
    r = meter_inbound(busy_and_quiet(spark), cfg=CFG)
    assert r.rated.count() == 40 and r.deltas.filter("billable").count() == 40  # two of 42 samples are resets


def test_hot_accounts_are_split_by_day_beside_plain_windows_for_others(spark, monkeypatch):
    monkeypatch.setattr("meterwise.plans.metering_job.HOT_ROWS", 5)
    quota = spark.createDataFrame([(A, 3000, 10.0, None, "active")], "account_uuid string, remaining_included_quota bigint, "
                                  "current_balance double, arrears_since timestamp_ntz, suspend_state string")
    want, got = (meter_inbound(busy_and_quiet(spark), None, quota, None, RatingConfig(**{**CFG.__dict__, "chunk": c})) for c in (None, "day"))
    assert [r.account_uuid for r in got.hot.collect()] == [A] and want.hot is None
    for part in ("deltas", "buckets", "rated", "ledger", "quota_states", "checkpoints"):
        a, b = (getattr(x, part) for x in (want, got))
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect())), part
