"""Tier B queries over account state, resources and cost control (B-10, B-18 to B-34), credits and the full sync row.

Rules the documents leave open are decided here and stated in the docstrings.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F

from meterwise.functions.prefix import chunked_lag
from meterwise.functions.time import day_start
from meterwise.operators import analytics, rating, resources, sync
from meterwise.operators.entitlements import sync_entitlements
from meterwise.plans.catalog import ORACLE, register
from meterwise.plans.oracle import with_views
from meterwise.plans.queries_metering import FIXTURE_CFG, metered
from meterwise.plans.queries_tier_a import WINDOW_AS_OF, cols, sourced, sync_state
from meterwise.plans.queries_tier_b import BUDGET, SERVICE, SVC_DAILY_SQL, money, service_daily
from meterwise.session import materialize
from meterwise.sources import fixtures as fx
from meterwise.sources.tables import table

# Parameters of the fixture runs.
PLANS = (("free", 10000, 0.0), ("starter", 50000, 1 / 512), ("pro", 200000, 1 / 1024), ("scale", 1000000, 1 / 2048))
HOST_WEIGHTS = {"cpu": 40, "mem": 30, "disk": 20, "net": 10}
HOST_RULE = "host-split-v1"
IDLE_DAYS = 14
STREAK_FACTOR, STREAK_DAYS = 1.5, 2


def month_of(c):
    return F.date_trunc("month", c).cast("timestamp_ntz")


# ---------------------------------------------------------------- A-W5, A-W6 with credits
AC = "id, account_uuid, entry_at, entry_type, amount_delta, balance_after, arrears, arrears_since, throttle_state"


@register("arrears_with_credits", with_views(["m_rated", "v_credits", "v_quota_states"], f"""
WITH e AS (SELECT id, account_uuid, bucket_start AS entry_at, 0 AS entry_rank, entry_type, amount_delta, last_collected_at FROM m_rated
           UNION ALL SELECT id, account_uuid, entry_at, entry_rank, entry_type, amount_delta, last_collected_at FROM v_credits),
s AS (SELECT e.*, coalesce(q.current_balance, 64.0::DOUBLE) AS seed, q.arrears_since AS seed_since
      FROM e LEFT JOIN v_quota_states q USING (account_uuid)),
b AS (SELECT *, seed + sum(amount_delta) OVER (w ROWS UNBOUNDED PRECEDING) AS balance_after,
             seed + coalesce(sum(amount_delta) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS balance_before,
             row_number() OVER w AS rn FROM s WINDOW w AS (PARTITION BY account_uuid ORDER BY entry_at, entry_rank, id)),
m AS (SELECT *, CASE WHEN balance_after < 0 AND rn = 1 THEN coalesce(seed_since, last_collected_at)
                     WHEN balance_after < 0 AND balance_before >= 0 THEN last_collected_at END AS start_at FROM b),
r AS (SELECT *, last_value(start_at IGNORE NULLS) OVER (PARTITION BY account_uuid ORDER BY entry_at, entry_rank, id
                ROWS UNBOUNDED PRECEDING) AS run_start FROM m)
SELECT id, account_uuid, entry_at, entry_type, amount_delta, balance_after, balance_after < 0 AS arrears,
       CASE WHEN balance_after < 0 THEN run_start END AS arrears_since,
       CASE WHEN balance_after < 0 THEN 'throttled' ELSE 'normal' END AS throttle_state
FROM r"""))
def q_arrears_with_credits(spark, sf):
    """Charges and credits of an account in one running balance; a credit may end an arrears episode."""
    charges = metered(spark, sf).rated.select(
        "id", "account_uuid", F.col("bucket_start").alias("entry_at"), F.lit(0).alias("entry_rank"), "entry_type",
        "amount_delta", "last_collected_at",
    )
    entries = charges.unionByName(fx.credits(spark, sf))
    return rating.run_balances(entries, fx.quota_states(spark, sf), FIXTURE_CFG).select(*cols(AC))


# ---------------------------------------------------------------- A-S16
def _sync_rows_sql() -> str:
    head, tail = ORACLE["source_watermark"].rsplit("\nSELECT w.source_id,", 1)
    return f"""{head},
marks AS (SELECT w.source_id,{tail}),
stored AS (SELECT source_id, last_completed_until, last_completed_until + INTERVAL 1 MINUTE AS t FROM state)
SELECT coalesce(m.source_id, s.source_id) AS source_id,
       CASE WHEN m.source_id IS NOT NULL THEN m.last_completed_until ELSE s.last_completed_until END AS last_completed_until,
       CASE WHEN m.source_id IS NOT NULL THEN TIMESTAMP '{WINDOW_AS_OF}' ELSE s.t END AS last_attempted_at,
       CASE WHEN m.source_id IS NOT NULL AND NOT m.failed THEN TIMESTAMP '{WINDOW_AS_OF}' ELSE s.t END AS last_succeeded_at,
       CASE WHEN m.source_id IS NOT NULL THEN m.last_error ELSE '' END AS last_error
FROM marks m FULL OUTER JOIN stored s ON m.source_id = s.source_id"""


@register("source_sync_rows", _sync_rows_sql())
def q_source_sync_rows(spark, sf):
    """The stored row of every source after a run: mark, attempt, success and error."""
    reg, state = fx.registry(spark), sync_state(spark, sf)
    marks = sync.advance_watermarks(sync.source_windows(state, reg, WINDOW_AS_OF), sourced(spark, sf), reg)
    ran = (F.col("last_completed_until") + F.expr("INTERVAL 1 MINUTE")).cast("timestamp_ntz")
    stored = state.select("*", ran.alias("last_attempted_at"), ran.alias("last_succeeded_at"), F.lit("").alias("last_error"))
    return sync.sync_state_rows(stored, marks, WINDOW_AS_OF)


# ---------------------------------------------------------------- B-10
PLAN_OF = "CASE event_id % 3 WHEN 0 THEN 'starter' WHEN 1 THEN 'pro' ELSE 'scale' END"
KIND_OF = "CASE WHEN event_type = 'subscription_updated' AND event_id % 29 = 0 THEN 'subscription_deleted' ELSE event_type END"


ENTITLEMENT_SQL = f"""
WITH ev AS (SELECT event_id, account_id, occurred_at, {KIND_OF} AS event_type, {PLAN_OF} AS plan_id FROM v_payments),
plans AS (SELECT * FROM (VALUES {', '.join(f"('{a}', {b}::BIGINT, {c!r}::DOUBLE)" for a, b, c in PLANS)}) p(plan_id, quota, price)),
acc AS (SELECT account_id, max(occurred_at) FILTER (WHERE event_type = 'invoice_paid') AS paid_at FROM ev GROUP BY 1),
sub AS (SELECT account_id, CASE WHEN event_type = 'subscription_deleted' THEN 'free' ELSE plan_id END AS plan_id
        FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY occurred_at DESC, event_id DESC) AS rn FROM ev
              WHERE event_type LIKE 'subscription%') WHERE rn = 1),
f AS (SELECT account_id, count(*) AS n, min(occurred_at) AS first_at FROM ev JOIN acc USING (account_id)
      WHERE event_type = 'payment_failed' AND (paid_at IS NULL OR occurred_at > paid_at) GROUP BY 1),
j AS (SELECT q.*, sub.plan_id, plans.quota, plans.price, acc.paid_at, coalesce(f.n, 0) AS n, f.first_at
      FROM v_quota_states q LEFT JOIN acc ON q.account_uuid = '00000000-0000-4000-8000-' || lpad(CAST(acc.account_id AS VARCHAR), 12, '0')
      LEFT JOIN sub USING (account_id) LEFT JOIN plans USING (plan_id) LEFT JOIN f USING (account_id))
SELECT account_uuid, plan_id, quota AS included_quota_bytes, price AS base_price_per_byte,
       CASE WHEN paid_at IS NOT NULL AND quota IS NOT NULL THEN quota ELSE remaining_included_quota END AS remaining_included_quota,
       CASE WHEN n > 0 THEN true WHEN paid_at IS NOT NULL THEN false ELSE arrears END AS arrears,
       CASE WHEN n > 0 AND paid_at IS NOT NULL THEN first_at WHEN n > 0 THEN coalesce(arrears_since, first_at)
            WHEN paid_at IS NULL THEN arrears_since END AS arrears_since,
       CASE WHEN n >= 3 THEN 'throttled' WHEN paid_at IS NOT NULL THEN 'normal' ELSE throttle_state END AS throttle_state,
       CASE WHEN n >= 5 THEN 'suspended' WHEN paid_at IS NOT NULL THEN 'active' ELSE suspend_state END AS suspend_state
FROM j"""


@register("entitlement_sync", with_views(["v_payments", "v_quota_states"], ENTITLEMENT_SQL))
def q_entitlement_sync(spark, sf):
    """B-10: plan and quota row of every account after its billing events, each third event delivered twice."""
    return entitled(spark, sf, fx.quota_states(spark, sf)).drop("entitled_at")


def entitled(spark, sf, states):
    p = fx.payments(spark, sf).select(
        "event_id", "account_id", "occurred_at", F.expr(KIND_OF).alias("event_type"), F.expr(PLAN_OF).alias("plan_id")
    )
    plans = spark.createDataFrame(list(PLANS), "plan_id string, plan_quota_bytes long, plan_price_per_byte double")
    events = p.unionByName(p.filter(F.col("event_id") % 3 == 0))
    return sync_entitlements(events, plans, states, fx.account_uuid(F.col("account_id")))


@register("entitlement_resync", with_views(["v_payments", "v_quota_states"], f"""
WITH {ENTITLEMENT_SQL.strip()[5:].rsplit("SELECT account_uuid, plan_id", 1)[0].rstrip()},
once AS (SELECT account_uuid, plan_id{ENTITLEMENT_SQL.rsplit("SELECT account_uuid, plan_id", 1)[1]})
SELECT * REPLACE (CAST(remaining_included_quota // 2 AS BIGINT) AS remaining_included_quota) FROM once"""))
def q_entitlement_resync(spark, sf):
    """B-10 run again over the same events after half of each quota has been used: nothing is refilled."""
    first = entitled(spark, sf, fx.quota_states(spark, sf))
    used = first.withColumn("remaining_included_quota", F.expr("remaining_included_quota div 2")).drop("plan_id", "included_quota_bytes", "base_price_per_byte")
    return entitled(spark, sf, materialize(used)).drop("entitled_at")


# ---------------------------------------------------------------- B-19, B-30, B-32
HOST_METRICS = tuple(HOST_WEIGHTS)


@register("host_allocation", with_views(["v_cost_lines", "v_utilisation"], f"""
WITH h AS (SELECT resource_id, CAST(date_trunc('month', usage_start_time) AS TIMESTAMP) AS month, currency,
                  CAST(sum(CAST(amount * 100 AS BIGINT)) AS BIGINT) AS pool_cents FROM v_cost_lines GROUP BY 1, 2, 3),
u AS (SELECT resource_id, CAST(date_trunc('month', day) AS TIMESTAMP) AS month, service,
             {', '.join(f'sum({m}) AS {m}' for m in HOST_METRICS)} FROM v_utilisation GROUP BY 1, 2, 3),
j AS (SELECT *, count(*) OVER w AS n, {', '.join(f'sum({m}) OVER w AS t_{m}' for m in HOST_METRICS)}
      FROM h JOIN u USING (resource_id, month) WINDOW w AS (PARTITION BY resource_id, month, currency)),
l AS (SELECT *, {' + '.join(f'CASE WHEN t_{m} > 0 THEN {v} ELSE 0 END' for m, v in HOST_WEIGHTS.items())} AS live FROM j),
s AS (SELECT *, CASE WHEN live > 0 THEN (0.0::DOUBLE + {' + '.join(
    f'CASE WHEN t_{m} > 0 THEN {v}.0::DOUBLE * CAST({m} AS DOUBLE) / CAST(t_{m} AS DOUBLE) ELSE 0.0::DOUBLE END' for m, v in HOST_WEIGHTS.items())})
       / CAST(live AS DOUBLE) ELSE 1.0::DOUBLE / n END AS share FROM l),
w1 AS (SELECT *, CAST(floor(share * 1000000000) AS BIGINT) AS weight FROM s),
w2 AS (SELECT *, sum(weight) OVER (PARTITION BY resource_id, month, currency) AS den FROM w1),
w3 AS (SELECT *, CAST((CAST(pool_cents AS HUGEINT) * weight) // den AS BIGINT) AS part FROM w2),
w4 AS (SELECT *, sum(part) OVER (PARTITION BY resource_id, month, currency) AS given,
              row_number() OVER (PARTITION BY resource_id, month, currency ORDER BY weight DESC, service) AS rk FROM w3)
SELECT resource_id, month, currency, service, share,
       CAST(CASE WHEN rk = 1 THEN part + pool_cents - given ELSE part END AS BIGINT) AS allocated_cents, '{HOST_RULE}' AS rule_version
FROM w4"""))
def q_host_allocation(spark, sf):
    """B-19: monthly cost of every host split over its services by weighted use."""
    keys = ["resource_id", "month", "currency"]
    hosts = fx.cost_lines(spark, sf).groupBy("resource_id", month_of("usage_start_time").alias("month"), "currency").agg(
        F.sum((F.col("amount") * 100).cast("long")).cast("long").alias("pool_cents")
    )
    use = fx.utilisation(spark, sf).groupBy("resource_id", month_of("day").alias("month"), "service").agg(
        *[F.sum(m).cast("long").alias(m) for m in HOST_METRICS]
    )
    use = use.join(hosts.select(*keys), ["resource_id", "month"])
    return resources.host_split(hosts, use, keys, HOST_WEIGHTS, HOST_RULE)


@register("idle_resources", with_views(["v_cost_lines", "v_utilisation"], f"""
WITH c AS (SELECT resource_id, currency, CAST(date_trunc('day', usage_start_time) AS TIMESTAMP) AS day, sum(amount) AS cost
           FROM v_cost_lines GROUP BY 1, 2, 3),
u AS (SELECT resource_id, day, sum(cpu + mem + disk + net) AS used FROM v_utilisation GROUP BY 1, 2),
d AS (SELECT c.*, coalesce(u.used, 0) AS used FROM c LEFT JOIN u USING (resource_id, day)),
s AS (SELECT *, sum(CASE WHEN used > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY resource_id, currency ORDER BY day ROWS UNBOUNDED PRECEDING) AS stretch FROM d),
g AS (SELECT resource_id, currency, stretch, min(day) AS idle_from, max(day) AS idle_to, CAST(sum(cost) AS DECIMAL(38,2)) AS idle_cost
      FROM s WHERE used = 0 AND cost > 0 GROUP BY 1, 2, 3)
SELECT resource_id, currency, idle_from, idle_to, date_diff('day', idle_from, idle_to) + 1 AS idle_days, idle_cost
FROM g WHERE date_diff('day', idle_from, idle_to) + 1 >= {IDLE_DAYS}"""))
def q_idle_resources(spark, sf):
    """B-30: resources that cost money over two weeks or more without any use."""
    cost = fx.cost_lines(spark, sf).groupBy("resource_id", "currency", day_start(F.col("usage_start_time")).alias("day")).agg(
        F.sum("amount").alias("cost")
    )
    use = fx.utilisation(spark, sf).groupBy("resource_id", "day").agg(
        F.sum(F.col("cpu") + F.col("mem") + F.col("disk") + F.col("net")).alias("used")
    )
    return resources.idle_stretches(cost.join(use, ["resource_id", "day"], "left"), ["resource_id", "currency"], IDLE_DAYS)


@register("dedupe_asset_vs_bill", with_views(["v_cost_lines", "v_assets"], """
WITH bill AS (SELECT resource_id, CAST(date_trunc('day', usage_start_time) AS TIMESTAMP) AS day, currency, sum(amount) AS cost
              FROM v_cost_lines GROUP BY 1, 2, 3),
a AS (SELECT a.*, EXISTS (SELECT 1 FROM bill b WHERE b.resource_id = a.resource_id AND b.day = a.window_start) AS covered FROM v_assets a),
u AS (SELECT day AS d, currency, cost AS billed, 0 AS counted, 0 AS covered FROM bill
      UNION ALL SELECT window_start, currency, 0, CASE WHEN covered THEN 0 ELSE amount END, CASE WHEN covered THEN amount ELSE 0 END FROM a)
SELECT CAST(date_trunc('month', d) AS TIMESTAMP) AS month, currency, CAST(sum(billed) AS DECIMAL(38,2)) AS bill_cost,
       CAST(sum(counted) AS DECIMAL(38,2)) AS asset_cost, CAST(sum(covered) AS DECIMAL(38,2)) AS asset_covered,
       CAST(sum(billed) + sum(counted) AS DECIMAL(38,2)) AS total_cost
FROM u GROUP BY 1, 2"""))
def q_dedupe_asset_vs_bill(spark, sf):
    """B-32: monthly total of the cloud bill and of the assets it does not cover; a window that comes twice counts once."""
    bill = fx.cost_lines(spark, sf).groupBy("resource_id", day_start(F.col("usage_start_time")).alias("day"), "currency").agg(
        F.sum("amount").alias("cost")
    )
    assets = resources.uncovered_assets(resources.load_windows(fx.assets(spark, sf), ["resource_id", "window_start", "currency"]), bill)
    none = F.lit(0).cast("decimal(38,2)")
    rows = bill.select(month_of("day").alias("month"), "currency", money(F.col("cost")).alias("billed"), none.alias("counted"), none.alias("covered"))
    rows = rows.unionByName(assets.select(
        month_of("window_start").alias("month"), "currency", none.alias("billed"),
        F.when(F.col("covered"), none).otherwise(F.col("amount")).alias("counted"),
        F.when(F.col("covered"), F.col("amount")).otherwise(none).alias("covered"),
    ))
    return rows.groupBy("month", "currency").agg(
        money(F.sum("billed")).alias("bill_cost"), money(F.sum("counted")).alias("asset_cost"),
        money(F.sum("covered")).alias("asset_covered"), money(F.sum("billed") + F.sum("counted")).alias("total_cost"),
    )


# ---------------------------------------------------------------- B-24, B-25
@register("cost_by_owner_rollup", with_views(["v_cost_lines"], """
WITH l AS (SELECT *, CASE WHEN kind = 'modern' THEN 'prod' ELSE 'dev' END AS environment FROM v_cost_lines)
SELECT currency, team, product, environment, CAST(sum(amount) AS DECIMAL(38,2)) AS cost, count(*) AS rows,
       CAST(GROUPING(team, product, environment) AS INTEGER) AS level
FROM l GROUP BY currency, ROLLUP (team, product, environment)"""))
def q_cost_by_owner_rollup(spark, sf):
    """B-24: subtotals by team > product > environment in each currency."""
    l = fx.cost_lines(spark, sf).select(
        "currency", "team", "product", F.when(F.col("kind") == "modern", "prod").otherwise("dev").alias("environment"),
        F.col("amount").alias("cost_amount"),
    )
    return analytics.cost_rollup(l, ["team", "product", "environment"])


@register("estimate_vs_actual", with_views(["v_estimates"], """
WITH e AS (SELECT pr_id, arg_max(cost_after, version) AS latest_estimate FROM v_estimates GROUP BY 1),
a AS (SELECT o_custkey AS pr_id, CAST(CAST(sum(CAST(round(l_extendedprice * l_discount * 100) AS BIGINT)) AS DECIMAL(38,0)) * CAST('0.01' AS DECIMAL(3,2)) AS DECIMAL(38,2)) AS actual_cost
      FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT pr_id, latest_estimate, actual_cost, CAST(actual_cost - latest_estimate AS DECIMAL(38,2)) AS variance,
       CASE WHEN latest_estimate <> 0 THEN CAST(CAST(actual_cost - latest_estimate AS DECIMAL(38,2)) AS DOUBLE) / CAST(latest_estimate AS DOUBLE) END AS variance_ratio,
       coalesce(abs(CAST(actual_cost - latest_estimate AS DECIMAL(38,2))) > latest_estimate * CAST('0.2' AS DECIMAL(2,1)), false) AS drift
FROM e LEFT JOIN a USING (pr_id)"""))
def q_estimate_vs_actual(spark, sf):
    """B-25, B-28 (estimate drift): the latest estimate of each change request against the cost of its lines."""
    e = fx.estimates(spark, sf).groupBy("pr_id").agg(F.max_by("cost_after", "version").alias("latest_estimate"))
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    per_order = li.groupBy("l_orderkey").agg(F.sum(F.round(F.col("l_extendedprice") * F.col("l_discount") * 100).cast("long")).alias("cents"))
    a = o.join(per_order, o.o_orderkey == per_order.l_orderkey).groupBy(F.col("o_custkey").alias("pr_id")).agg(
        money(F.sum("cents").cast("decimal(38,0)") * F.lit(Decimal("0.01"))).alias("actual_cost")
    )
    variance = money(F.col("actual_cost") - F.col("latest_estimate"))
    return e.join(a, "pr_id", "left").select(
        "pr_id", "latest_estimate", "actual_cost", variance.alias("variance"),
        analytics.ratio(variance, F.col("latest_estimate")).alias("variance_ratio"),
        F.coalesce(F.abs(variance) > F.col("latest_estimate") * F.lit(Decimal("0.2")), F.lit(False)).alias("drift"),
    )


# ---------------------------------------------------------------- B-28, B-29
@register("anomaly_streak", with_views(["v_cost_lines"], f"""
WITH {SVC_DAILY_SQL},
m AS (SELECT *, sum(CAST(cost AS DOUBLE)) OVER (PARTITION BY service_name, currency) / count(*) OVER (PARTITION BY service_name, currency) AS mean FROM s),
x AS (SELECT *, day - to_days(CAST(row_number() OVER (PARTITION BY service_name, currency ORDER BY day) AS INT)) AS island
      FROM m WHERE CAST(cost AS DOUBLE) > mean * {STREAK_FACTOR})
SELECT service_name, currency, min(day) AS first_day, max(day) AS last_day, count(*) AS days, CAST(sum(cost) AS DECIMAL(38,2)) AS cost
FROM x GROUP BY service_name, currency, island HAVING count(*) >= {STREAK_DAYS}"""))
def q_anomaly_streak(spark, sf):
    """B-28: each service has its own threshold, 1.5 times its mean day; only runs of two days or more are reported,
    so a single noisy day is not."""
    return analytics.streaks(service_daily(spark, sf), SERVICE, STREAK_FACTOR, STREAK_DAYS)


@register("anomaly_forecast", with_views(["v_cost_lines"], """
WITH m AS (SELECT service_name, currency, CAST(date_trunc('month', usage_start_time) AS TIMESTAMP) AS month, CAST(sum(amount) AS DECIMAL(38,2)) AS cost,
                  CAST(coalesce(sum(amount) FILTER (WHERE dayofmonth(usage_start_time) <= 10), 0) AS DECIMAL(38,2)) AS first_days
           FROM v_cost_lines GROUP BY 1, 2, 3),
f AS (SELECT *, CAST(first_days AS DOUBLE) / 10 * dayofmonth(last_day(month)) AS forecast FROM m)
SELECT service_name, currency, month, cost, forecast FROM f WHERE CAST(cost AS DOUBLE) > forecast * 1.5 AND CAST(cost AS DOUBLE) - forecast >= 5000"""))
def q_anomaly_forecast(spark, sf):
    """B-28 forecast deviation: months that cost half as much again as the run rate of their first ten days said."""
    day = F.col("usage_start_time")
    m = fx.cost_lines(spark, sf).groupBy(*SERVICE, month_of(day).alias("month")).agg(
        money(F.sum("amount")).alias("cost"),
        money(F.coalesce(F.sum(F.when(F.dayofmonth(day) <= 10, F.col("amount"))), F.lit(0))).alias("first_days"),
    )
    forecast = F.col("first_days").cast("double") / 10 * F.dayofmonth(F.last_day("month"))
    cost = F.col("cost").cast("double")
    return m.select(*SERVICE, "month", "cost", forecast.alias("forecast")).filter(
        (cost > F.col("forecast") * 1.5) & (cost - F.col("forecast") >= 5000)
    )


@register("budget_forecast", with_views(["v_cost_lines"], f"""
WITH d AS (SELECT coalesce(region, 'Unknown') AS region, currency, CAST(date_trunc('day', usage_start_time) AS TIMESTAMP) AS day,
                  CAST(sum(amount) AS DECIMAL(38,2)) AS cost FROM v_cost_lines GROUP BY 1, 2, 3),
m AS (SELECT *, CAST(date_trunc('month', day) AS TIMESTAMP) AS month,
             CAST(sum(cost) OVER (PARTITION BY region, currency, date_trunc('month', day) ORDER BY day ROWS UNBOUNDED PRECEDING) AS DOUBLE)
             / dayofmonth(day) * dayofmonth(last_day(day)) AS forecast FROM d)
SELECT region, currency, month, min(day) AS warned_on, arg_min(forecast, day) AS forecast FROM m
WHERE dayofmonth(day) >= 5 AND forecast > {BUDGET} GROUP BY 1, 2, 3"""))
def q_budget_forecast(spark, sf):
    """B-29: the first day from the fifth on whose run rate ends the month over the budget."""
    d = fx.cost_lines(spark, sf).groupBy(
        F.coalesce("region", F.lit("Unknown")).alias("region"), "currency", day_start(F.col("usage_start_time")).alias("day")
    ).agg(money(F.sum("amount")).alias("cost")).withColumn("month", month_of("day"))
    w = Window.partitionBy("region", "currency", "month").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    forecast = F.sum("cost").over(w).cast("double") / F.dayofmonth("day") * F.dayofmonth(F.last_day("day"))
    over = d.withColumn("forecast", forecast).filter((F.dayofmonth("day") >= 5) & (F.col("forecast") > F.lit(float(BUDGET))))
    return over.groupBy("region", "currency", "month").agg(F.min("day").alias("warned_on"), F.min_by("forecast", "day").alias("forecast"))


# ---------------------------------------------------------------- B-34
@register("source_gap_list", with_views(["v_samples"], """
WITH m AS (SELECT DISTINCT storage_node_id, CAST(date_trunc('minute', collected_at) AS TIMESTAMP) AS minute FROM v_samples),
x AS (SELECT *, lag(minute) OVER (PARTITION BY storage_node_id ORDER BY minute) AS prev FROM m)
SELECT storage_node_id, prev + INTERVAL 1 MINUTE AS gap_from, minute - INTERVAL 1 MINUTE AS gap_to,
       date_diff('minute', prev, minute) - 1 AS missing_minutes
FROM x WHERE date_diff('minute', prev, minute) > 1"""))
def q_source_gap_list(spark, sf):
    """B-34: every gap between two snapshots of a storage node, as its first and last missing minute."""
    m = fx.samples(spark, sf).select(
        "storage_node_id", F.date_trunc("minute", "collected_at").cast("timestamp_ntz").alias("minute")
    ).distinct()
    x = chunked_lag(m, ["storage_node_id"], ["minute"], day_start(F.col("minute")), ["minute"])
    missing = (F.timestamp_diff("MINUTE", F.col("prev_minute"), F.col("minute")) - 1).cast("long")
    minute = F.expr("INTERVAL 1 MINUTE")
    return x.select(
        "storage_node_id", (F.col("prev_minute") + minute).cast("timestamp_ntz").alias("gap_from"),
        (F.col("minute") - minute).cast("timestamp_ntz").alias("gap_to"), missing.alias("missing_minutes"),
    ).filter(F.col("missing_minutes") > 0)
