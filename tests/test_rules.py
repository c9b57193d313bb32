"""Names over time, allocation rules, mapping rules, price scopes, grains, margins, the source gate and the landing zone."""

import os
import re
from collections import Counter
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from helpers import A, B, INBOUND, ts
from meterwise.config import RatingConfig
from meterwise.operators import allocation, analytics, identity, margin, status
from meterwise.operators.focus import MappingRule, map_lines
from meterwise.plans.collect_job import collect, source_report
from meterwise.operators.sync import source_windows
from meterwise.sources import landing

NAMES = "name string, born timestamp_ntz, died timestamp_ntz, next_name string, next_born timestamp_ntz"


def test_pointer_jumping_follows_long_chains_and_finds_cycles(spark):
    edges = [(f"n{i}", f"n{i + 1}") for i in range(40)] + [("n40", None), ("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("lone", None), ("lost", "nowhere")]
    got = {r.node: r for r in identity.follow(spark.createDataFrame(edges, "node string, next string")).collect()}
    assert all((got[f"n{i}"].root, got[f"n{i}"].hops, got[f"n{i}"].cyclic) == ("n40", 40 - i, False) for i in range(41))
    assert all(got[k].cyclic for k in "abcx")
    assert (got["lone"].root, got["lone"].hops) == ("lone", 0) and got["lost"].root == "nowhere" and not got["lost"].cyclic


def test_three_renames_a_retired_resource_and_a_cycle_conserve_cost(spark):
    t0, t1, t2, t3 = (ts(f"2026-0{m}-01") for m in (1, 2, 3, 4))
    names = [("a", t0, t1, "b", t1), ("b", t1, t2, "c", t2), ("c", t2, t3, "d", t3), ("d", t3, None, None, None),
             ("gone", t0, t2, None, None), ("a", ts("2026-05-01"), None, None, None), ("p", t0, t1, "q", t1), ("q", t1, t2, "p", t0)]
    lines = [("a", t0, "1.005"), ("a", t2, "2.004"), ("c", t2, "0.001"), ("a", ts("2026-06-01"), "5"), ("gone", t1, "7"), ("gone", t2, "8"), ("new", t1, "9"), ("p", t0, "3"), (None, t0, "4")]
    l = spark.createDataFrame([(n, t, Decimal(x)) for n, t, x in lines], "name string, at timestamp_ntz, amount decimal(18,3)")
    got = Counter()
    for r in identity.cost_by_resource(l, spark.createDataFrame(names, NAMES), "name", "at", "amount", []).collect():
        got[(r.resource, r.status)] += r.cost
    assert got == {("d", "active"): Decimal("3.01"), ("a", "active"): 5, ("gone", "active"): 7, ("Unallocated", "after_end"): 8,
                   ("Unallocated", "unmapped"): 13, ("Unallocated", "cyclic"): 3}


RULE = "rule_id string, pool string, method string, priority int, effective_from timestamp_ntz, effective_to timestamp_ntz, state string"
FACT = "month timestamp_ntz, pool string, team string, shared decimal(18,4), direct decimal(18,4), usage long"


def rules(spark, rows):
    return spark.createDataFrame([(a, b, c, d, ts(e), f and ts(f), g) for a, b, c, d, e, f, g in rows], RULE)


def test_priority_then_own_pool_then_later_start_choose_the_rule(spark):
    table = rules(spark, [("r1", "p", "equal", 5, "2026-01-01", None, "active"), ("r2", "*", "usage", 5, "2026-01-01", None, "active"),
                          ("r3", "p", "fixed", 5, "2026-03-01", "2026-04-01", "active"), ("r4", "*", "custom", 1, "2026-05-01", None, "draft")])
    pools = spark.createDataFrame([(ts(f"2026-0{m}-01"), p) for m in range(1, 7) for p in "pq"] + [(ts("2025-12-01"), "p")], "month timestamp_ntz, pool string")
    pick = lambda drafts: {(r.month.month, r.pool): r.rule_id for r in allocation.choose_rules(pools, table, ["month", "pool"], "pool", "month", drafts).collect()}
    now, draft = pick(False), pick(True)
    assert [now[(m, "p")] for m in range(1, 7)] == ["r1", "r1", "r3", "r1", "r1", "r1"] and now[(12, "p")] is None
    assert {now[(m, "q")] for m in range(1, 7)} == {"r2"}
    assert draft[(5, "p")] == draft[(6, "q")] == "r4" and draft[(4, "p")] == "r1"


def test_pools_add_up_to_the_cent_with_sub_cent_lines_and_without_a_rule(spark):
    m1, m2 = ts("2026-01-01"), ts("2026-02-01")
    facts = [(m1, "p", "x", Decimal("10.004"), Decimal("1"), 1), (m1, "p", "y", Decimal("0.003"), Decimal("2"), 1), (m1, "p", "z", None, Decimal("3"), 1),
             (m2, "p", "x", Decimal("5.5"), None, None), (m2, "q", "x", Decimal("7"), Decimal("1"), 1)]
    f = spark.createDataFrame(facts, FACT)
    table = rules(spark, [("r1", "p", "custom", 5, "2026-01-01", None, "active")])
    shares = spark.createDataFrame([("r1", "x", 1), ("r1", "y", 1), ("r1", "w", 9)], "rule_id string, target string, weight long")
    got = {(r.month.month, r.pool, r.team): r.allocated_cents for r in allocation.allocate_by_rules(f, table, shares, ["month", "pool"], "pool", "month", "team").collect()}
    assert got == {(1, "p", "x"): 501, (1, "p", "y"): 500, (1, "p", "z"): 0, (2, "p", "Unallocated"): 550, (2, "q", "Unallocated"): 700}
    later = rules(spark, [("r1", "p", "custom", 5, "2026-01-01", None, "active"), ("r2", "p", "equal", 1, "2026-01-01", None, "active")])
    both = [allocation.allocate_by_rules(f, t, shares, ["month", "pool"], "pool", "month", "team") for t in (table, later)]
    changes = allocation.allocation_changes(*both, ["month", "pool"], "team").collect()
    assert sum(r.change_cents for r in changes) == 0 and {(r.team, r.before_rule, r.after_rule) for r in changes} == {(t, "r1", "r2") for t in "xyz"}


def test_shares_of_many_targets_sum_to_the_pool(spark):
    weights = spark.range(1000).select(F.lit("n").alias("node"), F.concat(F.lit("a"), F.col("id").cast("string")).alias("account"), (F.col("id") % 7).alias("weight"))
    pools = spark.createDataFrame([("n", 100_001), ("idle", 77)], "node string, pool_cents long")
    got = allocation.split_by_share(pools, weights, ["node"], "account")
    assert {r.node: r.s for r in got.groupBy("node").agg(F.sum("allocated_cents").alias("s")).collect()} == {"n": 100_001, "idle": 77}
    assert got.filter("node = 'idle'").first().account == "Unallocated"


def test_margin_by_plan_conserves_the_nodes_cost(spark):
    month = ts("2026-01-01")
    traffic = spark.createDataFrame([(month, "n1", A, 300), (month, "n1", B, 100), (month, "n2", A, 1)], "month timestamp_ntz, node_id string, account_uuid string, weight long")
    costs = spark.createDataFrame([(month, "n1", 1001), (month, "n2", 500), (month, "n3", 9)], "month timestamp_ntz, node_id string, pool_cents long")
    revenue = spark.createDataFrame([(month, B, 900), (month, "c", 5)], "month timestamp_ntz, account_uuid string, revenue_cents long")
    plans = spark.createDataFrame([(A, "pro"), (B, "free")], "account_uuid string, plan string")
    users = margin.account_margin(traffic, costs, revenue, plans)
    by = {r.account_uuid: r for r in users.collect()}
    assert (by[A].cost_cents, by[A].margin_cents) == (751 + 500, -1251) and (by[B].cost_cents, by[B].margin_cents) == (250, 650)
    rows = {r.plan: r for r in margin.plan_margin(users).collect()}
    assert sum(r.cost_cents for r in rows.values()) == 1510 and rows["pro"].losing_accounts == 1 and rows["none"].revenue_cents == 5
    health = margin.plan_health(margin.plan_margin(users), spark.createDataFrame([("pro", 100, 10_000), ("free", 100, 200)], "plan string, included_quota_bytes long, price_cents long"))
    assert {r.plan: r.healthy for r in health.collect()} == {"pro": True, "free": False}


def test_mapping_names_the_rule_of_every_column_and_keeps_the_line(spark):
    lines = spark.createDataFrame([(1, None, "x"), (2, "eu", "x"), (3, "us", None)], "id int, region string, `odd name` string")
    table = (MappingRule("g", "region", "'global'", "region IS NULL"), MappingRule("u", "region", "upper(region)", "region = 'us'"), MappingRule("n", "note", "`odd name`", "id < 3"))
    got = {r["raw"]["id"]: r for r in map_lines(lines, table).collect()}
    assert [got[i]["region"] for i in (1, 2, 3)] == ["global", None, "US"]
    assert [got[i]["mapped_by"]["region"] for i in (1, 2, 3)] == ["g", None, "u"] and got[3]["mapped_by"]["note"] is None
    assert got[2]["raw"]["odd name"] == "x" and got[2]["raw"]["region"] == "eu"


def test_price_of_the_own_region_before_the_global_one_and_never_of_another_currency(spark):
    d = [ts(f"2026-0{m}-01") for m in range(1, 6)]
    usage = spark.createDataFrame([("s", r, c, t, 1) for r, c in (("eu", "EUR"), ("us", "EUR"), (None, "EUR"), ("eu", "USD")) for t in d], "service_name string, region string, currency string, day timestamp_ntz, quantity long")
    book = spark.createDataFrame([("s", "global", "EUR", d[1], Decimal(1)), ("s", "eu", "EUR", d[2], Decimal(2)), ("s", "eu", "EUR", d[4], Decimal(3)), ("s", "global", "EUR", d[3], Decimal(4))],
                                 "service_name string, region string, currency string, effective_from timestamp_ntz, unit_price decimal(18,2)")
    got = {(r.region, r.currency, r.day.month): r for r in analytics.price_asof_scoped(usage, book).collect()}
    price = lambda region, currency: [None if x is None else int(x) for x in (got[(region, currency, m)].unit_price for m in range(1, 6))]
    assert price("eu", "EUR") == [None, 1, 2, 2, 3] and price("us", "EUR") == price(None, "EUR") == [None, 1, 1, 4, 4]
    assert price("eu", "USD") == [None] * 5 and len(got) == 20


def test_grains_add_up_with_sub_cent_lines_and_null_dimensions(spark):
    at = [datetime(2026, 1, 31, 23, 30), datetime(2026, 1, 31, 23, 40), datetime(2026, 2, 1, 0, 10)]
    lines = spark.createDataFrame([(p, t, Decimal("0.004")) for p in ("aws", None) for t in at], "provider string, usage_start_time timestamp_ntz, amount decimal(18,4)")
    rows = analytics.cost_grains(lines, ["provider"]).collect()
    assert all(r.adds_up for r in rows) and Counter(r.grain for r in rows) == {"hour": 4, "day": 4, "month": 4, "all": 2}
    assert {(r.provider, r.cost, r.lines) for r in rows if r.grain == "all"} == {("aws", Decimal("0.01"), 3), (None, Decimal("0.01"), 3)}


def test_grains_read_the_fact_once(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["cost_grains"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in x and "l_extendedprice" in x for x in plan.splitlines()) == 1


REGISTRY = "source_id string, expected_node_id string, expected_env string, enabled boolean"


def test_a_mismatching_source_leaves_nothing_and_an_equal_one_is_metered(spark):
    def rows(source, node, env, n):
        return [(ts(f"2026-07-13 10:{m:02d}:05"), node, env, 0, u, "", "t", 100 * (m + 1), 0, source) for m in range(n) for u in (A, B)]

    entries = spark.createDataFrame(rows("s1", "n1", "prod", 3) + rows("s2", "n2", "prod", 2) + rows("s2", "n2", "uat", 1) + rows("off", "n3", "prod", 2), INBOUND + ", source_id string")
    snapshots = entries.select("source_id", "collected_at", "node_id", "env").distinct()
    reg = spark.createDataFrame([("s1", " n1".strip(), "prod", True), ("s2", "n2", "prod", True), ("off", "", "", False), ("s4", "n4", "", True)], REGISTRY)
    state = spark.createDataFrame([("s1", ts("2026-07-13 10:00:00")), ("s2", ts("2026-07-13 10:00:00"))], "source_id string, last_completed_until timestamp_ntz")
    r = collect(snapshots, entries, reg, state, "2026-07-13 10:05:30", cfg=RatingConfig(price_per_byte=1.0, initial_balance=0.0))
    report = {x.source_id: x for x in source_report(r, source_windows(state, reg, "2026-07-13 10:05:30")).collect()}
    assert (report["s2"].status, report["s2"].buckets, report["s2"].ledger_rows, report["s2"].moved) == ("error", 0, 0, False)
    assert (report["s1"].status, report["s1"].buckets, report["s1"].total_bytes, report["s1"].moved) == ("ok", 6, 600, True)
    assert "off" not in report and report["s4"].buckets == 0
    nodes = {"prod:n1"}
    for df in (r.metered.buckets, r.metered.checkpoints, r.metered.rated):
        assert {x.node_id for x in df.select("node_id").distinct().collect()} == nodes
    assert {x.current_balance for x in r.metered.quota_states.collect()} == {-300.0}


def test_worst_status_of_a_pushed_batch_does_not_depend_on_the_order(spark):
    rows = [(1, 10, False, None), (1, 11, True, None), (1, 12, False, None), (2, 20, False, "bad"), (2, 20, False, None), (2, 21, False, None), (3, 30, False, None)]
    e = spark.createDataFrame(rows, "batch int, snap int, refused boolean, reject_reason string")
    for order in (e, e.orderBy(F.desc("snap"))):
        got = {r.batch: (r.status, r.results, r.ok, r.partial, r.error, r.first_error) for r in status.push_batches(order, "batch", "snap").collect()}
        assert got == {1: ("error", 3, 2, 0, 1, 11), 2: ("partial", 2, 1, 1, 0, None), 3: ("ok", 1, 1, 0, 0, None)}


def test_zone_reads_only_the_folders_of_the_windows(spark, tmp_path):
    path = str(tmp_path / "zone")
    snaps = spark.range(0, 24 * 4).select(F.concat(F.lit("s"), (F.col("id") % 2).cast("string")).alias("source_id"), F.lit("n").alias("node_id"),
                                          F.timestamp_add("HOUR", F.col("id").cast("int"), F.lit("2026-07-10 00:30:00").cast("timestamp_ntz")).alias("collected_at"))
    landing.append_zone(snaps, path)
    for day, hour in (("2026-07-10", 3), ("2026-07-13", 5), ("2026-07-12", 11), ("2026-07-12", 14)):  # any touch of these would fail
        with open(os.path.join(path, f"day={day}", f"hour={hour}", "part-broken.snappy.parquet"), "wb") as f:
            f.write(b"no parquet")
    w = spark.createDataFrame([("s0", ts("2026-07-12 12:00:00"), ts("2026-07-12 13:30:00"), False), ("s1", ts("2026-07-12 13:00:00"), ts("2026-07-12 13:59:00"), False),
                               ("s9", ts("2026-07-12 23:00:00"), ts("2026-07-12 22:00:00"), True)], "source_id string, since timestamp_ntz, until timestamp_ntz, noop boolean")
    df = landing.read_zone(spark, path, w)
    assert sorted((r.source_id, r.collected_at.hour) for r in df.collect()) == [("s0", 12), ("s1", 13)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "day#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    nothing = landing.read_zone(spark, path, w.filter("noop"))
    assert nothing.count() == 0 and nothing.columns == ["source_id", "node_id", "collected_at"]


@pytest.mark.parametrize("name", ["window_scan", "source_watermark"])
def test_window_bounds_reach_the_scan(spark, name):
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert any("ts" in x.split("]")[0] and "GreaterThanOrEqual(ts" in x.split("ReadSchema")[0] for x in plan.split("PushedFilters: [")[1:])


def test_lines_go_to_the_services_that_hold_at_their_time(spark):
    lines = spark.createDataFrame(
        [("r1", datetime(2024, 1, d), Decimal(a), "USD") for d, a in ((1, "0.010000000001"), (5, "0.01"), (9, "0.01"), (9, "0.005"))]
        + [("r2", datetime(2024, 1, 5), Decimal("-1"), "USD"), (None, datetime(2024, 1, 5), Decimal("2.5"), "EUR"), ("r9", datetime(2024, 1, 5), None, "EUR")],
        "resource string, at timestamp_ntz, amount decimal(38,12), currency string")
    day = lambda d: datetime(2024, 1, d)
    mapping = spark.createDataFrame(
        [("r1", "a", day(1), day(9)), ("r1", "b", day(1), None), ("r1", "b", day(2), None), ("r1", "c", day(5), None), ("r1", "c", day(5), None),
         ("r1", None, day(1), None), ("r2", "b", day(6), None), (None, "z", day(1), None)],
        "resource_id string, service string, effective_from timestamp_ntz, effective_until timestamp_ntz")
    got = {(r.currency, r.service): (r.allocated, r.line_parts)
           for r in identity.cost_by_service(lines, mapping, "resource", "at", "amount", ["currency"]).collect()}
    # 1st: a, b, where half a unit is rounded up and a takes the rest; 5th: a, b, c, the odd unit to a; 9th, both lines: a has ended, so b and c
    assert got == {("USD", "a"): (Decimal("0.008333333334"), 2), ("USD", "b"): (Decimal("0.015833333334"), 4),
                   ("USD", "c"): (Decimal("0.010833333333"), 3), ("USD", "Unallocated"): (Decimal("-1"), 1), ("EUR", "Unallocated"): (Decimal("2.5"), 2)}
    empty = identity.cost_by_service(lines, mapping.limit(0), "resource", "at", "amount", ["currency"])
    assert {(r.service, r.line_parts) for r in empty.collect()} == {("Unallocated", 5), ("Unallocated", 2)}
    assert identity.cost_by_service(lines.limit(0), mapping, "resource", "at", "amount", ["currency"]).count() == 0


def test_versions_of_a_hot_request_are_numbered_in_order(spark, tmp_path):
    from meterwise.sources import fixtures

    rows = [(i, 1 if i % 3 else i, datetime(2024, 1 + i % 12, 1 + i % 5), 10.0 + i) for i in range(300)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    want, seen = {}, Counter()
    for i, c, at, price in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        seen[c] += 1
        want[c, seen[c]] = (Decimal(price) * Decimal("0.01")).quantize(Decimal("0.01"))
    got = {(r.pr_id, r.version): r.cost_before for r in fixtures.estimates(spark, str(tmp_path)).collect()}
    assert got == want and max(seen.values()) == 200


def test_lines_are_split_in_their_own_row_over_the_span_that_holds_their_time(spark):
    t = [ts(f"2026-0{m}-01") for m in range(1, 8)]
    mapping = spark.createDataFrame(
        [("r", "b", t[0], None), ("r", "a", t[1], t[4]), ("r", "a", t[2], t[5]), ("r", "c", t[2], t[3]), ("r", "c", t[2], t[3]), ("r", "d", t[3], t[3]),
         ("r", None, t[0], None), (None, "x", t[0], None), ("r", "y", None, None), ("s", "z", t[1], t[2])],
        "resource_id string, service string, effective_from timestamp_ntz, effective_until timestamp_ntz")
    rows = [(n, at, Decimal("0.01")) for n in ("r", "s", None) for at in (*t, None)] + [("r", t[2], Decimal("-0.02")), ("r", t[2], None)]
    lines = spark.createDataFrame(rows, "resource string, at timestamp_ntz, amount decimal(18,2)").withColumn("day", F.col("at"))
    df = identity.cost_by_service(lines, mapping, "resource", "at", "amount", ["day"])
    got = {(r.day, r.service): (r.allocated, r.line_parts) for r in df.collect()}
    third = Decimal("-0.003333333333")
    assert {s: got[(t[2], s)] for s in "abc"} == {"a": (Decimal("-0.01") - 2 * third, 3), "b": (third, 3), "c": (third, 3)}
    assert {(m, s) for m, x in enumerate(t) for s in "abcz" if (x, s) in got} == {
        *((m, "b") for m in range(7)), *((m, "a") for m in (1, 2, 3, 4)), (2, "c"), (1, "z")}
    assert got[(None, "Unallocated")] == (Decimal("0.03"), 3) and sum(a for a, _ in got.values()) == Decimal("0.22")
    windows = re.findall(r"windowspecdefinition\((\w+)#", df._jdf.queryExecution().optimizedPlan().toString())
    assert set(windows) == {"of"}  # over the mapping only, never over lines
