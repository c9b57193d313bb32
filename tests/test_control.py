"""Credits, entitlement sync, raw zone, host split, idle stretches, and how often the cost fact is read."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from helpers import A, ts
from meterwise.config import RatingConfig
from meterwise.operators import analytics, costs, rating, resources
from meterwise.operators.entitlements import failures_since_paid, sync_entitlements
from meterwise.sources import raw_zone

SF = "/root/testdata/sf0.001"
ENTRY = ("id string, account_uuid string, entry_at timestamp_ntz, entry_rank int, entry_type string, amount_delta double, "
         "last_collected_at timestamp_ntz")


@pytest.mark.parametrize("chunk", ["day", None])
def test_arrears_set_cleared_by_a_credit_and_set_again(spark, chunk):
    at = [ts(f"2026-07-0{d} 10:00:00") for d in (1, 2, 3, 4, 5)]
    amounts = [-6.0, -6.0, 20.0, -5.0, -10.0]  # from 10: 4, -2, 18, 13, 3
    rows = [(f"e{i}", A, t, int(x > 0), "credit" if x > 0 else "charge", x, t) for i, (t, x) in enumerate(zip(at, amounts))]
    rows.append(("e5", A, at[4], 0, "charge", -7.0, at[4]))
    rows.append(("e6", A, at[4], 1, "credit", 1.0, at[4]))
    got = rating.run_balances(spark.createDataFrame(rows, ENTRY), None, RatingConfig(initial_balance=10.0, chunk=chunk))
    by = {r.id: r for r in got.collect()}
    assert [by[f"e{i}"].balance_after for i in range(7)] == [4.0, -2.0, 18.0, 13.0, 3.0, -4.0, -3.0]
    assert [by[f"e{i}"].arrears_since for i in range(7)] == [None, at[1], None, None, None, at[4], at[4]]
    assert by["e6"].throttle_state == "throttled" and by["e4"].throttle_state == "normal"


EVENT = "event_id long, account_id long, occurred_at timestamp_ntz, event_type string, plan_id string"


def events(spark):
    e = [
        (1, 1, "2026-01-01 08:00:00", "subscription_updated", "pro"),
        (2, 1, "2026-01-02 08:00:00", "payment_failed", None),
        (3, 1, "2026-01-02 09:00:00", "invoice_paid", None),
        (4, 1, "2026-01-02 10:00:00", "payment_failed", None),
        (5, 2, "2026-01-01 08:00:00", "subscription_updated", "pro"),
        (6, 2, "2026-01-05 08:00:00", "subscription_deleted", None),
        (7, 2, "2026-01-03 08:00:00", "invoice_paid", None),
        *[(10 + i, 3, f"2026-02-0{i + 1} 00:00:00", "payment_failed", None) for i in range(5)],
    ]
    return spark.createDataFrame([(i, a, datetime.fromisoformat(t), k, p) for i, a, t, k, p in e], EVENT)


def test_failures_count_from_the_last_payment_within_its_day(spark):
    got = {r.account_id: (r.failures, r.first_failure_at) for r in failures_since_paid(events(spark)).collect()}
    assert got == {1: (1, ts("2026-01-02 10:00:00")), 2: (0, None), 3: (5, ts("2026-02-01 00:00:00"))}


def test_entitlements_follow_the_events_and_replays_change_nothing(spark):
    plans = spark.createDataFrame([("free", 10, 0.0), ("pro", 100, 0.5)], "plan_id string, plan_quota_bytes long, plan_price_per_byte double")
    states = spark.createDataFrame(
        [(str(i), 7, True, ts("2025-12-01 00:00:00"), "throttled", "active") for i in (1, 2, 3, 4)],
        "account_uuid string, remaining_included_quota long, arrears boolean, arrears_since timestamp_ntz, throttle_state string, suspend_state string",
    )
    uuid = F.col("account_id").cast("string")
    once = sync_entitlements(events(spark), plans, states, uuid).collect()
    twice = sync_entitlements(events(spark).unionByName(events(spark)), plans, states, uuid).collect()
    assert sorted(once) == sorted(twice)
    got = {r.account_uuid: tuple(r)[1:9] for r in once}  # and entitled_at
    assert got["1"] == ("pro", 100, 0.5, 100, True, ts("2026-01-02 10:00:00"), "normal", "active")
    assert got["2"] == ("free", 10, 0.0, 10, False, None, "normal", "active")
    assert got["3"] == (None, None, None, 7, True, ts("2025-12-01 00:00:00"), "throttled", "suspended")
    assert got["4"] == (None, None, None, 7, True, ts("2025-12-01 00:00:00"), "throttled", "active")


def test_a_second_sync_refills_nothing_until_the_next_payment(spark):
    plans = spark.createDataFrame([("free", 10, 0.0), ("pro", 100, 0.5)], "plan_id string, plan_quota_bytes long, plan_price_per_byte double")
    states = spark.createDataFrame([("1", 7, False, None, "normal", "active")], "account_uuid string, remaining_included_quota long, arrears boolean, "
                                   "arrears_since timestamp_ntz, throttle_state string, suspend_state string")
    uuid = F.col("account_id").cast("string")
    stored = ["account_uuid", *states.columns[1:], "entitled_at"]
    first = sync_entitlements(events(spark), plans, states, uuid)
    assert (first.first().remaining_included_quota, first.first().entitled_at) == (100, ts("2026-01-02 09:00:00"))
    used = first.select(*stored).withColumn("remaining_included_quota", F.lit(40).cast("long"))
    again = sync_entitlements(events(spark), plans, used, uuid)
    assert again.select(*stored).collect() == used.collect()
    paid = spark.createDataFrame([(90, 1, ts("2026-03-01 09:00:00"), "invoice_paid", None)], EVENT)
    refilled = sync_entitlements(events(spark).unionByName(paid), plans, used, uuid).first()
    assert (refilled.remaining_included_quota, refilled.arrears, refilled.entitled_at) == (100, False, ts("2026-03-01 09:00:00"))


def test_raw_zone_is_written_once_and_replayed_whole(spark, tmp_path):
    rows = [("aws", ts("2026-01-01 05:00:00"), "x"), ("gcp", ts("2026-01-02 05:00:00"), "y"), (None, None, None)]
    feed = spark.createDataFrame(rows, "provider string, at timestamp_ntz, body string")
    root = str(tmp_path / "raw")
    raw_zone.write_raw(feed, root, "sync-1", F.col("provider"), F.col("at"))
    with pytest.raises(Exception, match="(?i)exists"):
        raw_zone.write_raw(feed, root, "sync-1", F.col("provider"), F.col("at"))
    raw_zone.write_raw(feed.filter("body = 'y'"), root, "sync-2", F.col("provider"), F.col("at"))
    back = raw_zone.replay(spark, root)
    assert back.count() == 4
    assert sorted(map(tuple, back.filter("sync_id = 'sync-1'").select("provider", "at", "body").collect()), key=str) == sorted(rows, key=str)
    assert back.filter("raw_provider = 'gcp'").count() == 2


def test_host_split_keeps_every_cent(spark):
    hosts = spark.createDataFrame([(1, 1001), (2, 50), (3, 7)], "resource_id long, pool_cents long")
    use = spark.createDataFrame(
        [(1, "a", 1, 0, 0, 0), (1, "b", 2, 3, 0, 0), (2, "a", 0, 0, 0, 0), (2, "b", 0, 0, 0, 0)],
        "resource_id long, service string, cpu long, mem long, disk long, net long",
    )
    got = resources.host_split(hosts, use, ["resource_id"], {"cpu": 40, "mem": 30, "disk": 20, "net": 10}, "v").collect()
    cents = {(r.resource_id, r.service): r.allocated_cents for r in got}
    assert cents == {(1, "a"): 190, (1, "b"): 811, (2, "a"): 25, (2, "b"): 25, (3, "unassigned"): 7}


def test_idle_stretch_ends_with_use(spark):
    d = [(1, "2026-01-01", 1, 0), (1, "2026-01-09", 1, 0), (1, "2026-01-10", 1, 4), (1, "2026-01-11", 1, 0), (1, "2026-01-20", 0, 0)]
    daily = spark.createDataFrame([(k, ts(t), c, u) for k, t, c, u in d], "resource_id long, day timestamp_ntz, cost long, used long")
    got = resources.idle_stretches(daily, ["resource_id"], 5).collect()
    assert [(r.idle_from, r.idle_to, r.idle_days, int(r.idle_cost)) for r in got] == [(ts("2026-01-01"), ts("2026-01-09"), 9, 2)]


def test_zero_lines_go_before_the_sum_for_azure_and_zero_sums_after_it_for_the_others(spark):
    day = ts("2026-01-01 00:00:00")
    rows = [(p, "acct", s, r, day, v, "USD") for p, s, r, v in [
        ("aws", "zero", "r", "1.00"), ("aws", "zero", "r", "-1.00"), ("aws", "tiny", "r", "0.004"), ("aws", "tiny", "r", "0.004"),
        ("gcp", "zero", "r", "1.00"), ("gcp", "zero", "r", "-1.00"), ("gcp", "kept", "", "2.00"), ("gcp", "kept", None, "3.00"),
        ("azure", None, None, "1.00"), ("azure", None, None, "-1.00"), ("azure", "none", "r", "0.00"), ("azure", "none", "r", None),
        ("other", "x", "r", "1.00"),
    ]]
    lines = spark.createDataFrame(rows, "provider string, account_id string, service_name string, region string, usage_start_time timestamp_ntz, amount string, currency string")
    got = {(r.provider, r.service_name, r.region): r.cost_amount for r in costs.unified_costs(lines).collect()}
    assert got == {("aws", "tiny", "r"): Decimal("0.008"), ("gcp", "kept", "global"): 5, ("azure", "Unknown", "Unknown"): 0}


def test_sub_cent_costs_are_stored_converted_and_added_up_before_rounding(spark):
    rows = [("aws", "acct", f"s{i}", "r", ts("2026-01-01 00:00:00"), "0.004", "EUR") for i in range(5)]
    lines = spark.createDataFrame(rows, "provider string, account_id string, service_name string, region string, usage_start_time timestamp_ntz, amount string, currency string")
    stored = costs.unified_costs(lines)
    assert {r.cost_amount for r in stored.collect()} == {Decimal("0.004")}
    assert [r.cost for r in analytics.cost_by_period(stored, "month", ["currency"]).collect()] == [Decimal("0.02")]
    rates = spark.createDataFrame([("EUR", ts("2026-01-01 00:00:00"), Decimal("1.5"))], "currency string, month timestamp_ntz, rate_to_usd decimal(18,8)")
    assert {r.amount_usd for r in analytics.convert_currency(stored, rates).collect()} == {Decimal("0.006")}


def test_last_day_is_excluded_from_the_window(spark):
    lines = spark.createDataFrame(
        [("aws", "a", "s", "r", ts(f"2026-01-0{d} 00:00:00"), 1, "USD") for d in (1, 2, 3, 4)],
        "provider string, account_id string, service_name string, region string, usage_start_time timestamp_ntz, amount int, currency string",
    )
    got = costs.unified_costs(lines, "2026-01-04 09:00:00").collect()
    assert [r.usage_start_time for r in got] == [ts("2026-01-02 00:00:00")]


@pytest.mark.parametrize("name,reads", [("cost_unified", 1), ("cost_upsert", 2), ("allocate_proportional", 1), ("cost_daily", 1)])
def test_the_cost_fact_is_read_once(spark, name, reads):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_extendedprice#") and sum("Relation" in x and "l_extendedprice" in x for x in plan.splitlines()) == reads
