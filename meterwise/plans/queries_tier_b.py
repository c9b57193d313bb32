"""Tier B queries: the documented read side and cost analytics, over the fixture views.

Rules the documents leave open are decided here and stated in the docstrings.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F

from meterwise.operators import allocation, analytics, costs, identity, periods, rating, upsert
from meterwise.operators.entitlements import failures_since_paid
from meterwise.operators.pricing import attach_pricing
from meterwise.plans.catalog import register
from meterwise.plans.oracle import with_views
from meterwise.plans.queries_metering import FIXTURE_CFG, metered
from meterwise.plans.queries_tier_a import UNIFIED_SQL, cols
from meterwise.sources import fixtures as fx
from meterwise.sources.tables import table

# Parameters of the fixture runs.
USAGE_FROM, USAGE_TO = "2024-01-08 00:00:00", "2024-01-15 00:00:00"
PAGE_SIZE = 5
DUNNING_AS_OF = "1998-08-03 00:00:00"
BUDGET = Decimal("100000")
BUDGET_THRESHOLDS = (Decimal("0.5"), Decimal("0.8"), Decimal("1.0"))
FIXED_SHARES = {"team-0": 40, "team-1": 30, "team-2": 15, "team-3": 10, "team-4": 5}
RECONCILE_TOLERANCE = 1.0
DRIVERS_TOP_K = 5


def money(c):
    return c.cast("decimal(38,2)")


# ---------------------------------------------------------------- B-1, B-2, B-4, B-5
US = ("account_uuid, total_bytes, uplink_bytes, downlink_bytes, included_quota_bytes, remaining_quota, used_quota, "
      "used_pct, last_bucket_at")
LAST_RATED = """last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account_uuid
                ORDER BY bucket_start DESC, node_id DESC, region DESC, line_code DESC) AS rn FROM m_rated) WHERE rn = 1)"""


@register("usage_summary", with_views(["m_rated", "m_pricing"], f"""
WITH tot AS (SELECT account_uuid, CAST(sum(total_bytes) AS BIGINT) AS total_bytes, CAST(sum(uplink_bytes) AS BIGINT) AS uplink_bytes,
                    CAST(sum(downlink_bytes) AS BIGINT) AS downlink_bytes, max(bucket_start) AS last_bucket_at
             FROM m_rated GROUP BY 1),
{LAST_RATED},
j AS (SELECT tot.*, coalesce(p.included_quota_bytes, 50000) AS included_quota_bytes, last.remaining_after AS remaining_quota
      FROM tot LEFT JOIN last USING (account_uuid) LEFT JOIN m_pricing p USING (account_uuid))
SELECT account_uuid, total_bytes, uplink_bytes, downlink_bytes, included_quota_bytes, remaining_quota,
       CAST(greatest(included_quota_bytes - remaining_quota, 0) AS BIGINT) AS used_quota,
       CASE WHEN included_quota_bytes <> 0 THEN CAST(CAST(greatest(included_quota_bytes - remaining_quota, 0) AS BIGINT) AS DOUBLE)
            / CAST(included_quota_bytes AS DOUBLE) * 100 END AS used_pct,
       last_bucket_at
FROM j"""))
def q_usage_summary(spark, sf):
    r = metered(spark, sf)
    accounts = r.buckets.select("account_uuid").distinct()
    pricing = attach_pricing(accounts, fx.profiles(spark, sf), FIXTURE_CFG)
    return analytics.usage_summary(r.buckets, r.quota_states, pricing).select(*cols(US))


@register("usage_buckets_latest", with_views(["m_buckets"], f"""
SELECT * FROM (SELECT account_uuid, bucket_start, node_id, total_bytes,
                      row_number() OVER (PARTITION BY account_uuid ORDER BY bucket_start DESC, node_id DESC) AS rn
               FROM m_buckets) WHERE rn <= {PAGE_SIZE}"""))
def q_usage_buckets_latest(spark, sf):
    from meterwise.operators import metering

    good, _ = metering.validate_samples(fx.inbound(spark, sf))
    d = metering.counter_deltas(metering.aggregate_inbounds(good), None, FIXTURE_CFG)
    b = metering.minute_buckets(d, FIXTURE_CFG).select("account_uuid", "bucket_start", "node_id", "total_bytes")
    out = analytics.latest_per_group(b, ["account_uuid"], [F.col("bucket_start").desc(), F.col("node_id").desc()], PAGE_SIZE)
    return out.withColumn("rn", F.col("rn").cast("long"))


BS = "account_uuid, entries, rated_bytes, amount_total, balance, first_bucket_at, last_bucket_at"


@register("billing_summary", with_views(["m_rated"], f"""
WITH {LAST_RATED}
SELECT r.account_uuid, count(*) AS entries, CAST(sum(r.rated_bytes) AS BIGINT) AS rated_bytes, sum(r.amount_delta) AS amount_total,
       any_value(last.balance_after) AS balance, min(r.bucket_start) AS first_bucket_at, max(r.bucket_start) AS last_bucket_at
FROM m_rated r JOIN last USING (account_uuid) GROUP BY 1"""))
def q_billing_summary(spark, sf):
    rated = metered(spark, sf).rated
    return rated.groupBy("account_uuid").agg(
        F.count("*").alias("entries"),
        F.sum("rated_bytes").cast("long").alias("rated_bytes"),
        F.sum("amount_delta").alias("amount_total"),
        F.max_by("balance_after", F.struct(*rating.RATE_ORDER)).alias("balance"),
        F.min("bucket_start").alias("first_bucket_at"),
        F.max("bucket_start").alias("last_bucket_at"),
    ).select(*cols(BS))


@register("usage_window", with_views(["m_buckets"], f"""
SELECT account_uuid, count(*) AS buckets, CAST(sum(total_bytes) AS BIGINT) AS total_bytes FROM m_buckets
WHERE bucket_start >= TIMESTAMP '{USAGE_FROM}' AND bucket_start < TIMESTAMP '{USAGE_TO}' GROUP BY 1"""))
def q_usage_window(spark, sf):
    return analytics.usage_window(metered(spark, sf).buckets, USAGE_FROM, USAGE_TO)


# ---------------------------------------------------------------- B-3
def identity_map(spark, sf):
    """Proxy account -> canonical account: two proxies per account; keys ending in 9 unmapped."""
    c = table(spark, sf, "customer").filter(F.col("c_custkey") % 10 != 9)
    return c.select(
        fx.account_uuid(F.col("c_custkey")).alias("account_uuid"),
        F.concat(F.lit("acct-"), F.expr("c_custkey div 2").cast("string")).alias("account_id"),
    )


IDMAP_SQL = """idmap AS (SELECT '00000000-0000-4000-8000-' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS account_uuid,
                         'acct-' || (c_custkey // 2) AS account_id FROM customer WHERE c_custkey % 10 <> 9)"""


@register("identity_mapping", with_views(["m_buckets"], f"""
WITH {IDMAP_SQL}
SELECT b.account_uuid, i.account_id, count(*) AS buckets, CAST(sum(b.total_bytes) AS BIGINT) AS total_bytes
FROM m_buckets b LEFT JOIN idmap i USING (account_uuid) GROUP BY 1, 2"""))
def q_identity_mapping(spark, sf):
    b = metered(spark, sf).buckets
    j = b.join(identity_map(spark, sf), "account_uuid", "left")
    return j.groupBy("account_uuid", "account_id").agg(
        F.count("*").alias("buckets"), F.sum("total_bytes").cast("long").alias("total_bytes")
    )


@register("account_rollup", with_views(["m_buckets"], f"""
WITH {IDMAP_SQL}
SELECT i.account_id, CAST(date_trunc('day', b.bucket_start) AS TIMESTAMP) AS day, count(DISTINCT b.node_id) AS nodes,
       count(DISTINCT b.account_uuid) AS proxies, CAST(sum(b.total_bytes) AS BIGINT) AS total_bytes
FROM m_buckets b JOIN idmap i USING (account_uuid) GROUP BY 1, 2"""))
def q_account_rollup(spark, sf):
    """Samples of unmapped proxies are dropped here (and counted by identity_mapping)."""
    b = metered(spark, sf).buckets
    j = b.join(identity_map(spark, sf), "account_uuid", "inner")
    return j.groupBy("account_id", F.date_trunc("day", "bucket_start").cast("timestamp_ntz").alias("day")).agg(
        F.countDistinct("node_id").alias("nodes"),
        F.countDistinct("account_uuid").alias("proxies"),
        F.sum("total_bytes").cast("long").alias("total_bytes"),
    )


# ---------------------------------------------------------------- B-6, B-7, B-8, B-9
def subscriptions(spark, sf):
    """First billing event per account = the subscription; its start is mapped into the
    metered month (2024-01-01 + event_id % 20 days); a refund request follows after
    ``account_id % 10`` days."""
    p = fx.payments(spark, sf)
    first = p.groupBy("account_id").agg(F.min_by("event_id", F.struct("occurred_at", "event_id")).alias("first_event"))
    start = F.timestamp_add("DAY", (F.col("first_event") % 20).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    return first.select(
        "account_id",
        fx.account_uuid(F.col("account_id")).alias("account_uuid"),
        start.alias("subscription_start"),
        F.timestamp_add("DAY", (F.col("account_id") % 10).cast("int"), start).alias("request_at"),
    )


@register("refund_eligibility", with_views(["v_payments", "m_buckets", "m_pricing"], """
WITH first AS (SELECT account_id, arg_min(event_id, (occurred_at, event_id)) AS first_event FROM v_payments GROUP BY 1),
s AS (SELECT account_id, '00000000-0000-4000-8000-' || lpad(CAST(account_id AS VARCHAR), 12, '0') AS account_uuid,
             TIMESTAMP '2024-01-01' + to_days(CAST(first_event % 20 AS INT)) AS subscription_start FROM first),
s2 AS (SELECT *, subscription_start + to_days(CAST(account_id % 10 AS INT)) AS request_at FROM s),
u AS (SELECT s2.account_id, CAST(coalesce(sum(b.total_bytes), 0) AS BIGINT) AS usage_bytes
      FROM s2 LEFT JOIN m_buckets b ON b.account_uuid = s2.account_uuid
       AND b.bucket_start >= s2.subscription_start AND b.bucket_start < s2.request_at GROUP BY 1)
SELECT s2.account_id, s2.subscription_start, s2.request_at, u.usage_bytes,
       coalesce(p.included_quota_bytes, 50000) AS included_quota_bytes,
       (s2.request_at <= s2.subscription_start + INTERVAL 7 DAYS) AND coalesce(p.included_quota_bytes, 50000) > 0
         AND u.usage_bytes * 20 < coalesce(p.included_quota_bytes, 50000) AS eligible
FROM s2 JOIN u USING (account_id) LEFT JOIN m_pricing p USING (account_uuid)"""))
def q_refund_eligibility(spark, sf):
    """B-6: subscribed at most 7 days and used under 5 % of the included quota (quota 0:
    never eligible).  Usage between start and request comes from totals by day and the buckets of the two days
    at its ends."""
    s = subscriptions(spark, sf)
    b = metered(spark, sf).buckets.select("account_uuid", "bucket_start", "total_bytes")
    u = periods.usage_in_windows(b, s, "account_uuid", "subscription_start", "request_at", "usage_bytes")
    priced = attach_pricing(u, fx.profiles(spark, sf), FIXTURE_CFG)
    q = F.col("included_quota_bytes")
    eligible = (F.col("request_at") <= F.col("subscription_start") + F.expr("INTERVAL 7 DAYS")) & (q > 0) & (F.col("usage_bytes") * 20 < q)
    return priced.select("account_id", "subscription_start", "request_at", "usage_bytes", "included_quota_bytes", eligible.alias("eligible"))


MONTHLY_FEE = 10.0


@register("amount_due", with_views(["m_rated", "v_credits"], f"""
WITH c AS (SELECT account_uuid, CAST(date_trunc('month', entry_at) AS TIMESTAMP) AS month, sum(amount_delta) AS credits FROM v_credits GROUP BY 1, 2),
d AS (SELECT account_uuid, CAST(date_trunc('month', bucket_start) AS TIMESTAMP) AS month, CAST(sum(total_bytes) AS BIGINT) AS used_bytes,
       any_value(included_quota_bytes) AS included_quota_bytes, any_value(price_per_byte) AS price, any_value(multiplier) AS mult
FROM (SELECT r.*, coalesce(p.included_quota_bytes, 50000) AS included_quota_bytes FROM m_rated r LEFT JOIN m_pricing p USING (account_uuid))
GROUP BY 1, 2)
SELECT account_uuid, month, used_bytes, included_quota_bytes, coalesce(credits, 0.0) AS credits,
       {MONTHLY_FEE} + CAST(greatest(used_bytes - included_quota_bytes, 0) AS DOUBLE) * price * mult - coalesce(credits, 0.0) AS amount_due
FROM d LEFT JOIN c USING (account_uuid, month)"""))
def q_amount_due(spark, sf):
    """B-7: monthly fee + max(0, use - included) x price x multiplier - credits and refunds of the month, per
    account and month with use."""
    r = metered(spark, sf).rated
    g = r.groupBy("account_uuid", F.date_trunc("month", "bucket_start").cast("timestamp_ntz").alias("month")).agg(
        F.sum("total_bytes").cast("long").alias("used_bytes"),
        F.first("price_per_byte").alias("price"),
        F.first("multiplier").alias("mult"),
    )
    g = attach_pricing(g, fx.profiles(spark, sf), FIXTURE_CFG).select(*g.columns, "included_quota_bytes")
    credits = fx.credits(spark, sf).groupBy(
        "account_uuid", F.date_trunc("month", "entry_at").cast("timestamp_ntz").alias("month")
    ).agg(F.sum("amount_delta").alias("credits"))
    g = g.join(credits, ["account_uuid", "month"], "left")
    over = F.greatest(F.col("used_bytes") - F.col("included_quota_bytes"), F.lit(0)).cast("double")
    back = F.coalesce("credits", F.lit(0.0))
    return g.select("account_uuid", "month", "used_bytes", "included_quota_bytes", back.alias("credits"),
                    (F.lit(MONTHLY_FEE) + over * F.col("price") * F.col("mult") - back).alias("amount_due"))


@register("dunning_ladder", with_views(["v_payments"], f"""
WITH lp AS (SELECT account_id, max(occurred_at) FILTER (WHERE event_type = 'invoice_paid') AS last_paid_at FROM v_payments GROUP BY 1),
f AS (SELECT p.account_id, count(*) AS failures, min(p.occurred_at) AS first_failure_at
      FROM v_payments p JOIN lp USING (account_id)
      WHERE p.event_type = 'payment_failed' AND (lp.last_paid_at IS NULL OR p.occurred_at > lp.last_paid_at) GROUP BY 1)
SELECT lp.account_id, lp.last_paid_at, CAST(coalesce(f.failures, 0) AS BIGINT) AS failures, f.first_failure_at,
       CASE WHEN coalesce(f.failures, 0) = 0 THEN 'current'
            WHEN date_diff('day', f.first_failure_at, TIMESTAMP '{DUNNING_AS_OF}') >= 14 THEN 'suspended'
            WHEN f.failures >= 3 OR date_diff('day', f.first_failure_at, TIMESTAMP '{DUNNING_AS_OF}') >= 7 THEN 'throttled'
            ELSE 'arrears' END AS state
FROM lp LEFT JOIN f USING (account_id)"""))
def q_dunning_ladder(spark, sf):
    """B-8: failures since the last paid invoice; 1 -> arrears, 3 or 7 days -> throttled,
    14 days -> suspended, a payment clears."""
    j = failures_since_paid(fx.payments(spark, sf))
    days = F.datediff(F.lit(DUNNING_AS_OF).cast("timestamp_ntz"), F.col("first_failure_at"))
    n = F.col("failures")
    state = (F.when(n == 0, "current").when(days >= 14, "suspended").when((n >= 3) | (days >= 7), "throttled").otherwise("arrears"))
    return j.select("account_id", "last_paid_at", "failures", "first_failure_at", state.alias("state"))


@register("event_dedup", with_views(["v_payments"], "SELECT event_id, account_id, occurred_at, event_type, amount FROM v_payments"))
def q_event_dedup(spark, sf):
    """B-9: a replayed event id has no effect; the first delivery wins."""
    p = fx.payments(spark, sf)
    late = p.filter(F.col("event_id") % 3 == 0).withColumn("amount", F.col("amount") + 1)  # a replay with other content
    replayed = p.withColumn("arrival", F.lit(0)).unionByName(late.withColumn("arrival", F.lit(1)))
    return upsert.first_per_key(replayed, ["event_id"], "arrival").select(
        "event_id", "account_id", "occurred_at", "event_type", "amount"
    )


# ---------------------------------------------------------------- B-11, B-12, B-13
RATED_LINES = """rl AS (SELECT l.*, CAST(date_trunc('month', usage_start_time) AS TIMESTAMP) AS month, r.rate_to_usd
                      FROM v_cost_lines l LEFT JOIN v_rates r ON r.currency = l.currency
                       AND r.month = CAST(date_trunc('month', l.usage_start_time) AS TIMESTAMP))"""


@register("gross_margin", with_views(["v_payments", "v_cost_lines", "v_rates"], f"""
WITH {RATED_LINES},
rev AS (SELECT CAST(date_trunc('month', occurred_at) AS TIMESTAMP) AS month, sum(amount) AS revenue FROM v_payments
        WHERE event_type = 'invoice_paid' GROUP BY 1),
cost AS (SELECT month, sum(CASE WHEN rate_to_usd > 0 THEN CAST(amount AS DECIMAL(18,2)) * rate_to_usd END) AS cost_usd,
                count(*) FILTER (WHERE rate_to_usd IS NULL OR rate_to_usd <= 0) AS unconverted_lines FROM rl GROUP BY 1)
SELECT coalesce(rev.month, cost.month) AS month, CAST(coalesce(revenue, 0) AS DECIMAL(38,2)) AS revenue,
       CAST(coalesce(cost_usd, 0) AS DECIMAL(38,2)) AS cost_usd,
       CAST(coalesce(revenue, 0) AS DECIMAL(38,2)) - CAST(coalesce(cost_usd, 0) AS DECIMAL(38,2)) AS margin,
       coalesce(unconverted_lines, 0) AS unconverted_lines
FROM rev FULL OUTER JOIN cost ON rev.month = cost.month"""))
def q_gross_margin(spark, sf):
    """B-11: monthly net revenue (paid invoices) minus USD cost; two pre-aggregated sides,
    full outer join on the month (view-level join only).  Lines without a usable rate cannot
    be converted: they are counted in ``unconverted_lines``, which flags the margin."""
    rev = fx.payments(spark, sf).filter(F.col("event_type") == "invoice_paid").groupBy(
        F.date_trunc("month", "occurred_at").cast("timestamp_ntz").alias("month")
    ).agg(F.sum("amount").alias("revenue"))
    lines = fx.cost_lines(spark, sf).withColumn("month", F.date_trunc("month", "usage_start_time").cast("timestamp_ntz"))
    rl = lines.join(fx.rates(spark, sf), ["currency", "month"], "left")
    usable = F.coalesce(F.col("rate_to_usd") > 0, F.lit(False))
    cost = rl.groupBy("month").agg(
        F.sum(F.when(usable, F.col("amount").cast("decimal(19,6)") * F.col("rate_to_usd"))).alias("cost_usd"),
        F.count(F.when(~usable, 1)).alias("unconverted_lines"),
    )
    j = rev.join(cost, "month", "full")
    r, c = money(F.coalesce(F.col("revenue"), F.lit(0))), money(F.coalesce(F.col("cost_usd"), F.lit(0)))
    return j.select("month", r.alias("revenue"), c.alias("cost_usd"), (r - c).cast("decimal(38,2)").alias("margin"),
                    F.coalesce(F.col("unconverted_lines"), F.lit(0)).alias("unconverted_lines"))


@register("unit_cost", with_views(["v_cost_lines"], """
SELECT service_name, currency, CAST(date_trunc('month', usage_start_time) AS TIMESTAMP) AS month, CAST(sum(amount) AS DECIMAL(38,2)) AS cost,
       sum(usage_quantity) AS quantity,
       CASE WHEN sum(usage_quantity) <> 0 THEN CAST(CAST(sum(amount) AS DECIMAL(38,2)) AS DOUBLE) / sum(usage_quantity) END AS unit_cost
FROM v_cost_lines GROUP BY 1, 2, 3"""))
def q_unit_cost(spark, sf):
    """B-12: monthly cost per unit of usage per service and currency (null without usage)."""
    g = fx.cost_lines(spark, sf).groupBy(
        "service_name", "currency", F.date_trunc("month", "usage_start_time").cast("timestamp_ntz").alias("month")
    ).agg(money(F.sum("amount")).alias("cost"), F.sum("usage_quantity").alias("quantity"))
    return g.withColumn("unit_cost", analytics.ratio(F.col("cost"), F.col("quantity")))


@register("reconcile_drift", f"""
WITH ext AS (SELECT o_custkey AS account_id, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS amount FROM orders
             WHERE o_orderstatus = 'P' AND o_orderkey % 17 <> 0 GROUP BY 1),
int AS (SELECT o_custkey AS account_id,
               CAST(sum(CAST(round(l_extendedprice * (1 - l_discount) * (1 + l_tax) * 100) AS BIGINT)) AS DECIMAL(38,0)) * CAST('0.01' AS DECIMAL(3,2)) AS amount
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' AND o_orderkey % 13 <> 0 GROUP BY 1),
j AS (SELECT coalesce(ext.account_id, int.account_id) AS account_id, CAST(ext.amount AS DECIMAL(38,2)) AS external_amount,
             CAST(int.amount AS DECIMAL(38,2)) AS internal_amount FROM ext FULL OUTER JOIN int ON ext.account_id = int.account_id)
SELECT account_id, external_amount, internal_amount, CAST(external_amount - internal_amount AS DECIMAL(38,2)) AS diff,
       CASE WHEN internal_amount IS NULL THEN 'missing_internal' WHEN external_amount IS NULL THEN 'missing_external'
            WHEN abs(external_amount - internal_amount) > {RECONCILE_TOLERANCE} THEN 'mismatch' ELSE 'ok' END AS status
FROM j""")
def q_reconcile_drift(spark, sf):
    """B-13: paid order totals (external) vs the sum of their priced line items
    (internal), per account; missing rows on either side are classified too."""
    o = table(spark, sf, "orders").filter(F.col("o_orderstatus") == "P")
    ext = o.filter(F.col("o_orderkey") % 17 != 0).groupBy(F.col("o_custkey").alias("account_id")).agg(
        money(F.sum(F.col("o_totalprice").cast("decimal(18,2)"))).alias("amount")
    )
    li = table(spark, sf, "lineitem")
    cents = F.round(F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount")) * (F.lit(1) + F.col("l_tax")) * 100).cast("long")
    internal = (
        o.filter(F.col("o_orderkey") % 13 != 0)
        .join(li, li.l_orderkey == o.o_orderkey)
        .groupBy(F.col("o_custkey").alias("account_id"))
        .agg(money(F.sum(cents).cast("decimal(38,0)") * F.lit(Decimal("0.01"))).alias("amount"))
    )
    return analytics.reconcile(ext, internal, "account_id", RECONCILE_TOLERANCE)


# ---------------------------------------------------------------- B-14, B-15, B-17, B-21
FOCUS = ("provider_name, sub_account_id, service_name, region_name, charge_period_start, charge_period_end, billed_cost, "
         "effective_cost, list_cost, billing_currency, raw_region, raw_kind")


@register("focus_normalize", with_views(["v_cost_lines"], """
SELECT provider AS provider_name, account_id AS sub_account_id, coalesce(service_name, 'Unknown') AS service_name,
       CASE WHEN provider = 'gcp' AND coalesce(region, '') = '' THEN 'global'
            WHEN provider = 'azure' AND region IS NULL THEN 'Unknown' ELSE region END AS region_name,
       usage_start_time AS charge_period_start, usage_start_time + INTERVAL 1 DAY AS charge_period_end,
       amount AS billed_cost, amount AS effective_cost, amount AS list_cost, currency AS billing_currency,
       region AS raw_region, kind AS raw_kind
FROM v_cost_lines"""))
def q_focus_normalize(spark, sf):
    """B-14: FOCUS-style columns per cost line; raw fields kept.  Only one amount is
    known per line, so billed = effective = list cost; region defaults follow A-P12."""
    l = fx.cost_lines(spark, sf)
    region = (
        F.when((F.col("provider") == "gcp") & (F.coalesce(F.col("region"), F.lit("")) == ""), F.lit("global"))
        .when((F.col("provider") == "azure") & F.col("region").isNull(), F.lit("Unknown"))
        .otherwise(F.col("region"))
    )
    return l.select(
        F.col("provider").alias("provider_name"), F.col("account_id").alias("sub_account_id"),
        F.coalesce(F.col("service_name"), F.lit("Unknown")).alias("service_name"), region.alias("region_name"),
        F.col("usage_start_time").alias("charge_period_start"),
        (F.col("usage_start_time") + F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz").alias("charge_period_end"),
        F.col("amount").alias("billed_cost"), F.col("amount").alias("effective_cost"), F.col("amount").alias("list_cost"),
        F.col("currency").alias("billing_currency"), F.col("region").alias("raw_region"), F.col("kind").alias("raw_kind"),
    )


CC = "provider, account_id, service_name, region, usage_start_time, currency, cost_amount, rate_to_usd, amount_usd, rate_ok"


@register("currency_convert", with_views(["v_cost_lines", "v_rates"], f"""
WITH u AS ({UNIFIED_SQL})
SELECT u.provider, u.account_id, u.service_name, u.region, u.usage_start_time, u.currency, u.cost_amount, r.rate_to_usd,
       CASE WHEN r.rate_to_usd > 0 THEN CAST(CAST(u.cost_amount AS DECIMAL(24,10)) * CAST(r.rate_to_usd AS DECIMAL(12,8)) AS DECIMAL(38,10)) END AS amount_usd,
       coalesce(r.rate_to_usd > 0, false) AS rate_ok
FROM u LEFT JOIN v_rates r ON r.currency = u.currency AND r.month = CAST(date_trunc('month', u.usage_start_time) AS TIMESTAMP)"""))
def q_currency_convert(spark, sf):
    c = costs.unified_costs(fx.cost_lines(spark, sf))
    return analytics.convert_currency(c, fx.rates(spark, sf)).select(*cols(CC))


@register("cost_roles", with_views(["v_cost_lines"], """
WITH r AS (SELECT provider, currency, CAST(date_trunc('month', usage_start_time) AS TIMESTAMP) AS month, amount,
                  CASE WHEN resource_id % 5 = 0 THEN 'estimate' WHEN kind = 'modern' THEN 'adjustment' ELSE 'authoritative' END AS role
           FROM v_cost_lines)
SELECT provider, currency, month,
       CAST(coalesce(sum(amount) FILTER (WHERE role = 'authoritative'), 0) AS DECIMAL(38,2)) AS authoritative,
       CAST(coalesce(sum(amount) FILTER (WHERE role = 'adjustment'), 0) AS DECIMAL(38,2)) AS adjustment,
       CAST(coalesce(sum(amount) FILTER (WHERE role = 'estimate'), 0) AS DECIMAL(38,2)) AS estimate,
       CAST(coalesce(sum(amount) FILTER (WHERE role IN ('authoritative', 'adjustment')), 0) AS DECIMAL(38,2)) AS total
FROM r GROUP BY 1, 2, 3"""))
def q_cost_roles(spark, sf):
    """B-17: total = authoritative + adjustment; estimates are reported, never added.
    Role: estimate for resources ending in 0/5, adjustment for modern rows, else
    authoritative."""
    l = fx.cost_lines(spark, sf)
    role = F.when(F.col("resource_id") % 5 == 0, "estimate").when(F.col("kind") == "modern", "adjustment").otherwise("authoritative")
    l = l.withColumn("role", role)

    def part(*roles):
        return money(F.coalesce(F.sum(F.when(F.col("role").isin(*roles), F.col("amount"))), F.lit(0)))

    return l.groupBy("provider", "currency", F.date_trunc("month", "usage_start_time").cast("timestamp_ntz").alias("month")).agg(
        part("authoritative").alias("authoritative"), part("adjustment").alias("adjustment"),
        part("estimate").alias("estimate"), part("authoritative", "adjustment").alias("total"),
    )


@register("price_book_asof", with_views(["v_cost_lines", "v_price_book"], """
WITH u AS (SELECT service_name, CAST(date_trunc('day', usage_start_time) AS TIMESTAMP) AS day, sum(usage_quantity) AS quantity
           FROM v_cost_lines GROUP BY 1, 2)
SELECT u.service_name, u.day, u.quantity, p.effective_from AS price_effective_from, p.unit_price,
       p.unit_price IS NOT NULL AS priced,
       CAST(CAST(u.quantity AS DECIMAL(18,2)) * p.unit_price AS DECIMAL(38,4)) AS estimated_cost
FROM u ASOF LEFT JOIN v_price_book p ON u.service_name = p.service_name AND u.day >= p.effective_from"""))
def q_price_book_asof(spark, sf):
    """B-21: latest price version in effect on the usage day; before the first version
    the price is null and ``priced`` false."""
    u = fx.cost_lines(spark, sf).groupBy(
        "service_name", F.date_trunc("day", "usage_start_time").cast("timestamp_ntz").alias("day")
    ).agg(F.sum("usage_quantity").alias("quantity"))
    p = analytics.price_asof(u, fx.price_book(spark, sf), "service_name", "day")
    return p.withColumn("estimated_cost", (F.col("quantity").cast("decimal(18,2)") * F.col("unit_price")).cast("decimal(38,4)"))


# ---------------------------------------------------------------- B-18, B-20
SHARED = "cost_center IS NULL"


def alloc_inputs(spark, sf):
    l = fx.cost_lines(spark, sf).withColumn("month", F.date_trunc("month", "usage_start_time").cast("timestamp_ntz"))
    amount = F.col("amount").cast("decimal(38,12)")  # sub-cent lines count: sums are rounded, not lines
    # one aggregate over the lines; the pool of a month is a window over its few rows
    shared = F.col("cost_center").isNull()
    g = l.groupBy("month", "currency", "team").agg(
        F.sum(F.when(shared, amount)).alias("shared"),
        allocation.cents(F.sum(F.when(~shared, amount))).alias("direct_cents"),
        F.sum(F.when(~shared, F.col("usage_quantity"))).cast("long").alias("usage_units"),
    )
    pool = allocation.cents(F.sum("shared").over(Window.partitionBy("month", "currency")))
    return g.withColumn("pool_cents", pool).filter(F.col("direct_cents").isNotNull()).drop("shared")


ALLOC_BASE = """l AS (SELECT *, CAST(date_trunc('month', usage_start_time) AS TIMESTAMP) AS month, CAST(amount * 100 AS BIGINT) AS cents FROM v_cost_lines),
pools AS (SELECT month, currency, CAST(sum(cents) AS BIGINT) AS pool_cents FROM l WHERE cost_center IS NULL GROUP BY 1, 2),
direct AS (SELECT month, currency, team, CAST(sum(cents) AS BIGINT) AS direct_cents, CAST(sum(usage_quantity) AS BIGINT) AS usage_units
           FROM l WHERE cost_center IS NOT NULL GROUP BY 1, 2, 3)"""


def alloc_sql(weight_sql: str, extra: str = "") -> str:
    return with_views(["v_cost_lines", "v_payments"], f"""
WITH {ALLOC_BASE}{extra},
w AS ({weight_sql}),
w2 AS (SELECT month, currency, team, CAST(greatest(weight, 0) AS BIGINT) AS weight,
              sum(CAST(greatest(weight, 0) AS BIGINT)) OVER (PARTITION BY month, currency) AS wsum, count(*) OVER (PARTITION BY month, currency) AS n FROM w),
w3 AS (SELECT *, CASE WHEN wsum > 0 THEN weight ELSE 1 END AS eff, CASE WHEN wsum > 0 THEN wsum ELSE n END AS den FROM w2),
j AS (SELECT w3.*, p.pool_cents, CAST((CAST(p.pool_cents AS HUGEINT) * eff) // den AS BIGINT) AS share FROM w3 JOIN pools p USING (month, currency)),
k AS (SELECT *, row_number() OVER (PARTITION BY month, currency ORDER BY eff DESC, team) AS rk, sum(share) OVER (PARTITION BY month, currency) AS given FROM j)
SELECT month, currency, team, weight, CAST(CASE WHEN rk = 1 THEN share + pool_cents - given ELSE share END AS BIGINT) AS allocated_cents FROM k""")


def run_alloc(spark, sf, weight_fn):
    weights = weight_fn(spark, sf, alloc_inputs(spark, sf))
    return allocation.allocate(None, weights, ["month", "currency"], "team")


@register("allocate_equal", alloc_sql("SELECT month, currency, team, 1 AS weight FROM direct"))
def q_allocate_equal(spark, sf):
    """B-18 equal: every team with direct cost in the month weighs 1."""
    return run_alloc(spark, sf, lambda s, f, d: d.select("month", "currency", "team", "pool_cents", F.lit(1).alias("weight")))


@register("allocate_proportional", alloc_sql("SELECT month, currency, team, direct_cents AS weight FROM direct"))
def q_allocate_proportional(spark, sf):
    """B-18 proportional: weight = the team's direct cost in the month."""
    return run_alloc(spark, sf, lambda s, f, d: d.select("month", "currency", "team", "pool_cents", F.col("direct_cents").alias("weight")))


FIXED_CASE = "CASE team " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in FIXED_SHARES.items()) + " ELSE 0 END"


@register("allocate_fixed", alloc_sql(f"SELECT month, currency, team, {FIXED_CASE} AS weight FROM direct"))
def q_allocate_fixed(spark, sf):
    """B-18 fixed: fixed percentages per team (40/30/15/10/5)."""
    m = F.create_map(*[x for k, v in FIXED_SHARES.items() for x in (F.lit(k), F.lit(v))])
    return run_alloc(spark, sf, lambda s, f, d: d.select("month", "currency", "team", "pool_cents", F.coalesce(m[F.col("team")], F.lit(0)).alias("weight")))


@register("allocate_usage", alloc_sql("SELECT month, currency, team, usage_units AS weight FROM direct"))
def q_allocate_usage(spark, sf):
    """B-18 usage: weight = units used by the team's resources in the month."""
    return run_alloc(spark, sf, lambda s, f, d: d.select("month", "currency", "team", "pool_cents", F.col("usage_units").alias("weight")))


REV_SQL = """,
rev AS (SELECT CAST(date_trunc('month', occurred_at) AS TIMESTAMP) AS month, 'team-' || (account_id % 5) AS team,
               CAST(sum(amount * 100) AS BIGINT) AS revenue_cents FROM v_payments WHERE event_type = 'invoice_paid' GROUP BY 1, 2)"""


@register("allocate_revenue", alloc_sql(
    "SELECT d.month, d.currency, d.team, coalesce(r.revenue_cents, 0) AS weight FROM direct d LEFT JOIN rev r USING (month, team)", REV_SQL))
def q_allocate_revenue(spark, sf):
    """B-18 revenue: weight = paid invoices of the team's accounts (account % 5) in the
    month; a month without revenue is split equally."""
    def weights(s, f, d):
        rev = fx.payments(s, f).filter(F.col("event_type") == "invoice_paid").groupBy(
            F.date_trunc("month", "occurred_at").cast("timestamp_ntz").alias("month"),
            F.concat(F.lit("team-"), (F.col("account_id") % 5).cast("string")).alias("team"),
        ).agg((F.sum(F.col("amount") * 100)).cast("long").alias("revenue_cents"))
        j = d.join(rev, ["month", "team"], "left")
        return j.select("month", "currency", "team", "pool_cents", F.coalesce(F.col("revenue_cents"), F.lit(0)).alias("weight"))

    return run_alloc(spark, sf, weights)


@register("unallocated_ratio", with_views(["v_cost_lines"], """
WITH c AS (SELECT CAST(date_trunc('month', usage_start_time) AS TIMESTAMP) AS month, currency, amount,
                  CASE WHEN cost_center IS NULL THEN 'untagged' WHEN resource_id % 11 = 0 THEN 'unknown_resource'
                       WHEN product LIKE 'Brand#1%' THEN 'shared' ELSE 'allocated' END AS bucket FROM v_cost_lines),
g AS (SELECT month, currency, CAST(sum(amount) AS DECIMAL(38,2)) AS total,
             CAST(coalesce(sum(amount) FILTER (WHERE bucket = 'untagged'), 0) AS DECIMAL(38,2)) AS untagged,
             CAST(coalesce(sum(amount) FILTER (WHERE bucket = 'unknown_resource'), 0) AS DECIMAL(38,2)) AS unknown_resource,
             CAST(coalesce(sum(amount) FILTER (WHERE bucket = 'shared'), 0) AS DECIMAL(38,2)) AS shared,
             CAST(coalesce(sum(amount) FILTER (WHERE bucket = 'allocated'), 0) AS DECIMAL(38,2)) AS allocated FROM c GROUP BY 1, 2)
SELECT *, CASE WHEN total <> 0 THEN CAST(untagged + unknown_resource AS DOUBLE) / CAST(total AS DOUBLE) END AS unallocated_ratio,
       coalesce(CAST(untagged + unknown_resource AS DOUBLE) / CAST(total AS DOUBLE) > 0.15, false) AS alert
FROM g"""))
def q_unallocated_ratio(spark, sf):
    """B-20: every cost lands in one bucket (untagged, unknown resource, shared,
    allocated, in that order); the unallocated share per month and currency alerts over 15 %."""
    l = fx.cost_lines(spark, sf)
    bucket = (F.when(F.col("cost_center").isNull(), "untagged").when(F.col("resource_id") % 11 == 0, "unknown_resource")
              .when(F.col("product").startswith("Brand#1"), "shared").otherwise("allocated"))
    l = l.withColumn("bucket", bucket)

    def part(b):
        return money(F.coalesce(F.sum(F.when(F.col("bucket") == b, F.col("amount"))), F.lit(0)))

    g = l.groupBy(F.date_trunc("month", "usage_start_time").cast("timestamp_ntz").alias("month"), "currency").agg(
        money(F.sum("amount")).alias("total"), part("untagged").alias("untagged"), part("unknown_resource").alias("unknown_resource"),
        part("shared").alias("shared"), part("allocated").alias("allocated"),
    )
    r = analytics.ratio(F.col("untagged") + F.col("unknown_resource"), F.col("total"))
    return g.withColumn("unallocated_ratio", r).withColumn("alert", F.coalesce(r > 0.15, F.lit(False)))


# ---------------------------------------------------------------- B-22, B-24, B-25, B-26, B-27
@register("cost_change_drivers", with_views(["v_cost_lines"], f"""
WITH a AS (SELECT service_name, currency, sum(amount) FILTER (WHERE year(usage_start_time) = 1996) AS c0,
                  sum(amount) FILTER (WHERE year(usage_start_time) = 1997) AS c1 FROM v_cost_lines GROUP BY 1, 2),
b AS (SELECT service_name, currency, CAST(coalesce(c0, 0) AS DECIMAL(38,2)) AS cost_before, CAST(coalesce(c1, 0) AS DECIMAL(38,2)) AS cost_after FROM a),
c AS (SELECT *, CAST(cost_after - cost_before AS DECIMAL(38,2)) AS delta FROM b)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY currency ORDER BY abs(delta) DESC, service_name) AS rk FROM c) WHERE rk <= {DRIVERS_TOP_K}"""))
def q_cost_change_drivers(spark, sf):
    """B-22: services whose cost changed most between 1996 and 1997 (top k by |delta| in each currency).
    Both ranges are aggregated per service first; the final ranking sees one row per
    service and currency."""
    l = fx.cost_lines(spark, sf)
    y = F.year("usage_start_time")
    a = l.groupBy("service_name", "currency").agg(
        money(F.coalesce(F.sum(F.when(y == 1996, F.col("amount"))), F.lit(0))).alias("cost_before"),
        money(F.coalesce(F.sum(F.when(y == 1997, F.col("amount"))), F.lit(0))).alias("cost_after"),
    ).withColumn("delta", (F.col("cost_after") - F.col("cost_before")).cast("decimal(38,2)"))
    w = Window.partitionBy("currency").orderBy(F.abs("delta").desc(), "service_name")
    return a.withColumn("rk", F.row_number().over(w).cast("long")).filter(F.col("rk") <= DRIVERS_TOP_K)


@register("cost_daily", with_views(["v_cost_lines"], f"""
WITH u AS ({UNIFIED_SQL})
SELECT CAST(date_trunc('day', usage_start_time) AS TIMESTAMP) AS period, provider, currency,
       CAST(sum(cost_amount) AS DECIMAL(38,2)) AS cost, count(*) AS rows FROM u GROUP BY 1, 2, 3"""))
def q_cost_daily(spark, sf):
    return analytics.cost_by_period(costs.unified_costs(fx.cost_lines(spark, sf)), "day", ["provider", "currency"])


@register("cost_monthly", with_views(["v_cost_lines"], f"""
WITH u AS ({UNIFIED_SQL})
SELECT CAST(date_trunc('month', usage_start_time) AS TIMESTAMP) AS period, provider, currency,
       CAST(sum(cost_amount) AS DECIMAL(38,2)) AS cost, count(*) AS rows FROM u GROUP BY 1, 2, 3"""))
def q_cost_monthly(spark, sf):
    return analytics.cost_by_period(costs.unified_costs(fx.cost_lines(spark, sf)), "month", ["provider", "currency"])


@register("cost_by_dims_rollup", with_views(["v_cost_lines"], f"""
WITH u AS ({UNIFIED_SQL})
SELECT currency, provider, service_name, region, CAST(sum(cost_amount) AS DECIMAL(38,2)) AS cost, count(*) AS rows,
       CAST(GROUPING(provider, service_name, region) AS INTEGER) AS level
FROM u GROUP BY currency, ROLLUP (provider, service_name, region)"""))
def q_cost_by_dims_rollup(spark, sf):
    """B-24: subtotals by provider > service > region in each currency; aggregates equal detail."""
    return analytics.cost_rollup(costs.unified_costs(fx.cost_lines(spark, sf)), ["provider", "service_name", "region"])


@register("estimate_variance", with_views(["v_estimates"], """
SELECT pr_id, any_value(repository) AS repository, count(*) AS versions,
       arg_min(cost_before, version) AS first_estimate, arg_max(cost_after, version) AS latest_estimate,
       CAST(arg_max(cost_after, version) - arg_min(cost_before, version) AS DECIMAL(18,2)) AS variance
FROM v_estimates GROUP BY 1"""))
def q_estimate_variance(spark, sf):
    """B-25: per change request the first estimate (before) and the latest version's
    estimate (after), and their variance."""
    e = fx.estimates(spark, sf)
    return e.groupBy("pr_id").agg(
        F.first("repository").alias("repository"),
        F.count("*").alias("versions"),
        F.min_by("cost_before", "version").alias("first_estimate"),
        F.max_by("cost_after", "version").alias("latest_estimate"),
    ).withColumn("variance", (F.col("latest_estimate") - F.col("first_estimate")).cast("decimal(18,2)"))


# The policy table: rule -> (environment or None for all, limit, decision).  A decision of ``deny`` outranks ``warn``.
POLICY_VERSION = "policy-v2"
POLICY = {
    "increase_limit": (None, Decimal("500"), "deny"),
    "prod_growth": ("prod", Decimal("0.2"), "warn"),
    "dev_growth": ("dev", Decimal("0.5"), "warn"),
    "gpu_unapproved": (None, None, "deny"),
    "no_cost_center": (None, None, "deny"),
}


def policy_conditions() -> dict[str, str]:
    """SQL text of each rule over an estimate row; both engines read it alike."""
    texts = {}
    for rule, (env, limit, _) in POLICY.items():
        if rule == "increase_limit":
            text = f"cost_after - cost_before > {limit}"
        elif rule.endswith("_growth"):
            text = f"cost_after - cost_before > cost_before * CAST('{limit}' AS DECIMAL(3,1))"
        elif rule == "gpu_unapproved":
            text = "(pr_id + version) % 23 = 0 AND version % 2 = 1"
        else:
            text = "pr_id % 10 = 0"
        texts[rule] = f"{text} AND environment = '{env}'" if env else text
    return texts


RULE_SQL = policy_conditions()
ANY_OF = {d: " OR ".join(f"({RULE_SQL[r]})" for r, v in POLICY.items() if v[2] == d) for d in ("deny", "warn")}


@register("policy_checks", with_views(["v_estimates"], f"""
SELECT pr_id, version, environment, CAST(cost_after - cost_before AS DECIMAL(18,2)) AS delta,
       concat_ws(',', {', '.join(f"CASE WHEN {c} THEN '{r}' END" for r, c in RULE_SQL.items())}) AS violations,
       CASE WHEN {ANY_OF['deny']} THEN 'deny' WHEN {ANY_OF['warn']} THEN 'warn' ELSE 'pass' END AS decision,
       '{POLICY_VERSION}' AS policy_version
FROM v_estimates"""))
def q_policy_checks(spark, sf):
    """B-26: each estimate against the policy table: increase per change, growth by environment, GPU without approval
    (fixture: (pr + version) % 23 = 0 needs one, odd versions have none), no cost centre (fixture: pr % 10 = 0)."""
    hits = [F.when(F.expr(c), F.lit(r)) for r, c in RULE_SQL.items()]
    return fx.estimates(spark, sf).select(
        "pr_id", "version", "environment", (F.col("cost_after") - F.col("cost_before")).cast("decimal(18,2)").alias("delta"),
        F.concat_ws(",", *hits).alias("violations"),
        F.when(F.expr(ANY_OF["deny"]), "deny").when(F.expr(ANY_OF["warn"]), "warn").otherwise("pass").alias("decision"),
        F.lit(POLICY_VERSION).alias("policy_version"),
    )


DAILY_SQL = """d AS (SELECT currency, CAST(date_trunc('day', usage_start_time) AS TIMESTAMP) AS day, CAST(sum(amount) AS DECIMAL(38,2)) AS cost
                FROM v_cost_lines GROUP BY 1, 2)"""


@register("cost_mtd_forecast", with_views(["v_cost_lines"], f"""
WITH {DAILY_SQL},
m AS (SELECT *, CAST(sum(cost) OVER (PARTITION BY currency, date_trunc('month', day) ORDER BY day ROWS UNBOUNDED PRECEDING) AS DECIMAL(38,2)) AS mtd FROM d)
SELECT currency, day, cost, mtd, CAST(mtd AS DOUBLE) / dayofmonth(day) * dayofmonth(last_day(day)) AS forecast FROM m"""))
def q_cost_mtd_forecast(spark, sf):
    """B-27: month-to-date per currency and a linear run-rate forecast
    (MTD / days elapsed x days in month)."""
    d = fx.cost_lines(spark, sf).groupBy(
        "currency", F.date_trunc("day", "usage_start_time").cast("timestamp_ntz").alias("day")
    ).agg(money(F.sum("amount")).alias("cost"))
    w = Window.partitionBy("currency", F.date_trunc("month", "day")).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("mtd", money(F.sum("cost").over(w)))
    fc = F.col("mtd").cast("double") / F.dayofmonth("day") * F.dayofmonth(F.last_day("day"))
    return d.withColumn("forecast", fc)


@register("top_services", with_views(["v_cost_lines"], """
WITH m AS (SELECT CAST(date_trunc('month', usage_start_time) AS TIMESTAMP) AS month, currency, service_name, CAST(sum(amount) AS DECIMAL(38,2)) AS cost
           FROM v_cost_lines GROUP BY 1, 2, 3)
SELECT * FROM (SELECT *, rank() OVER (PARTITION BY month, currency ORDER BY cost DESC) AS rk FROM m) WHERE rk <= 3"""))
def q_top_services(spark, sf):
    """B-27: the three most expensive services of every month, in each currency."""
    m = fx.cost_lines(spark, sf).groupBy(
        F.date_trunc("month", "usage_start_time").cast("timestamp_ntz").alias("month"), "currency", "service_name"
    ).agg(money(F.sum("amount")).alias("cost"))
    w = Window.partitionBy("month", "currency").orderBy(F.col("cost").desc())
    return m.withColumn("rk", F.rank().over(w).cast("long")).filter(F.col("rk") <= 3)


# ---------------------------------------------------------------- B-28, B-29
SVC_DAILY_SQL = """d AS (SELECT service_name, currency, CAST(date_trunc('day', usage_start_time) AS TIMESTAMP) AS day, CAST(sum(amount) AS DECIMAL(38,2)) AS cost
                    FROM v_cost_lines GROUP BY 1, 2, 3),
bnd AS (SELECT service_name, currency, min(day) AS lo, max(day) AS hi FROM d GROUP BY 1, 2),
sp AS (SELECT service_name, currency, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS TIMESTAMP) AS day FROM bnd),
s AS (SELECT sp.service_name, sp.currency, sp.day, coalesce(d.cost, CAST(0 AS DECIMAL(38,2))) AS cost FROM sp LEFT JOIN d USING (service_name, currency, day))"""


SERVICE = ("service_name", "currency")  # amounts of different currencies are never added


def service_daily(spark, sf):
    d = fx.cost_lines(spark, sf).groupBy(
        *SERVICE, F.date_trunc("day", "usage_start_time").cast("timestamp_ntz").alias("day")
    ).agg(money(F.sum("amount")).alias("cost"))
    return analytics.daily_spine(d, SERVICE, "day", "cost")


def anomaly_sql(lag_n: int, ratio: str, delta: int) -> str:
    return with_views(["v_cost_lines"], f"""
WITH {SVC_DAILY_SQL},
x AS (SELECT *, lag(cost, {lag_n}) OVER (PARTITION BY service_name, currency ORDER BY day) AS previous FROM s)
SELECT service_name, currency, day, cost, previous, cost - previous AS change FROM x
WHERE previous IS NOT NULL AND cost > previous * {ratio} AND cost - previous >= {delta}""")


@register("anomaly_dod", anomaly_sql(1, "1.5", 1000))
def q_anomaly_dod(spark, sf):
    """B-28 day over day: +50 % and at least 1000 over the previous day (missing days
    count as 0 on the per-service date spine)."""
    return analytics.change_anomalies(service_daily(spark, sf), SERVICE, "day", "cost", 1, 1.5, 1000)


@register("anomaly_wow", anomaly_sql(7, "1.5", 1000))
def q_anomaly_wow(spark, sf):
    """B-28 week over week: the same rule against the value 7 days earlier."""
    return analytics.change_anomalies(service_daily(spark, sf), SERVICE, "day", "cost", 7, 1.5, 1000)


@register("anomaly_mom", with_views(["v_cost_lines"], """
WITH m AS (SELECT service_name, currency, CAST(date_trunc('month', usage_start_time) AS TIMESTAMP) AS month, CAST(sum(amount) AS DECIMAL(38,2)) AS cost
           FROM v_cost_lines GROUP BY 1, 2, 3),
bnd AS (SELECT service_name, currency, min(month) AS lo, max(month) AS hi FROM m GROUP BY 1, 2),
sp AS (SELECT service_name, currency, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS TIMESTAMP) AS month FROM bnd),
s AS (SELECT sp.service_name, sp.currency, sp.month, coalesce(m.cost, CAST(0 AS DECIMAL(38,2))) AS cost FROM sp LEFT JOIN m USING (service_name, currency, month)),
x AS (SELECT *, lag(cost) OVER (PARTITION BY service_name, currency ORDER BY month) AS previous FROM s)
SELECT service_name, currency, month, cost, previous, cost - previous AS change FROM x
WHERE previous IS NOT NULL AND cost > previous * 1.2 AND cost - previous >= 5000"""))
def q_anomaly_mom(spark, sf):
    """B-28 month over month: +20 % and at least 5000 over the previous month."""
    m = fx.cost_lines(spark, sf).groupBy(
        *SERVICE, F.date_trunc("month", "usage_start_time").cast("timestamp_ntz").alias("month")
    ).agg(money(F.sum("amount")).alias("cost"))
    bounds = m.groupBy(*SERVICE).agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    spine = bounds.select(*SERVICE, F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 MONTH"))).alias("month"))
    s = spine.join(m, [*SERVICE, "month"], "left").select(
        *SERVICE, F.col("month").cast("timestamp_ntz").alias("month"),
        F.coalesce(F.col("cost"), F.lit(0).cast("decimal(38,2)")).alias("cost"),
    )
    return analytics.change_anomalies(s, SERVICE, "month", "cost", 1, 1.2, 5000)


@register("anomaly_threshold", with_views(["v_cost_lines"], """
SELECT service_name, currency, CAST(date_trunc('day', usage_start_time) AS TIMESTAMP) AS day, CAST(sum(amount) AS DECIMAL(38,2)) AS cost
FROM v_cost_lines GROUP BY 1, 2, 3 HAVING sum(amount) > 20000"""))
def q_anomaly_threshold(spark, sf):
    """B-28 static threshold: a service-day over 20000."""
    d = fx.cost_lines(spark, sf).groupBy(
        *SERVICE, F.date_trunc("day", "usage_start_time").cast("timestamp_ntz").alias("day")
    ).agg(money(F.sum("amount")).alias("cost"))
    return d.filter(F.col("cost") > 20000)


@register("budget_alerts", with_views(["v_cost_lines"], f"""
WITH d AS (SELECT coalesce(region, 'Unknown') AS region, currency, CAST(date_trunc('day', usage_start_time) AS TIMESTAMP) AS day,
                  CAST(sum(amount) AS DECIMAL(38,2)) AS cost FROM v_cost_lines GROUP BY 1, 2, 3),
m AS (SELECT *, CAST(date_trunc('month', day) AS TIMESTAMP) AS month,
             sum(cost) OVER (PARTITION BY region, currency, date_trunc('month', day) ORDER BY day ROWS UNBOUNDED PRECEDING) AS mtd FROM d),
t AS (SELECT m.*, th.threshold FROM m, (VALUES {', '.join(f"(CAST('{x}' AS DECIMAL(3,1)))" for x in BUDGET_THRESHOLDS)}) th(threshold))
SELECT region, currency, month, threshold, min(day) AS crossed_on FROM t WHERE mtd >= {BUDGET} * threshold GROUP BY 1, 2, 3, 4"""))
def q_budget_alerts(spark, sf):
    """B-29: first day each month a region's running cost reaches 50 / 80 / 100 % of its
    budget (100,000 per region and month, in each currency)."""
    d = fx.cost_lines(spark, sf).groupBy(
        F.coalesce(F.col("region"), F.lit("Unknown")).alias("region"), "currency",
        F.date_trunc("day", "usage_start_time").cast("timestamp_ntz").alias("day"),
    ).agg(money(F.sum("amount")).alias("cost"))
    budgets = d.select("region", "currency", F.date_trunc("month", "day").cast("timestamp_ntz").alias("month")).distinct().withColumn(
        "budget", F.lit(BUDGET).cast("decimal(18,2)")
    )
    out = analytics.budget_crossings(d, budgets, ["region", "currency"], [x for x in BUDGET_THRESHOLDS])
    return out.withColumn("threshold", F.col("threshold").cast("decimal(3,1)"))


# ---------------------------------------------------------------- B-31, B-34, B-35
# The base tags and the key tags among them.
TAGS = ("managed_by", "repository", "service", "product", "team", "environment", "cost_center", "owner")
KEY_TAGS = ("team", "environment", "cost_center")
TAG_SQL = {
    "managed_by": "CASE WHEN resource_id % 6 = 0 THEN NULL ELSE 'terraform' END",
    "repository": "'repo-' || (resource_id % 9)",
    "service": "service_name",
    "product": "product",
    "team": "team",
    "environment": "CASE WHEN resource_id % 14 = 0 THEN '' WHEN kind = 'modern' THEN 'prod' ELSE 'dev' END",
    "cost_center": "cost_center",
    "owner": "CASE WHEN resource_id % 4 = 0 THEN NULL ELSE team || '-lead' END",
}


@register("tag_coverage", with_views(["v_cost_lines"], f"""
WITH t AS (SELECT provider, {', '.join(f"nullif({TAG_SQL[x]}, '') AS t_{x}" for x in TAGS)} FROM v_cost_lines)
SELECT provider, count(*) AS lines, {', '.join(f'count(*) FILTER (WHERE t_{x} IS NULL) AS missing_{x}' for x in TAGS)},
       count(*) FILTER (WHERE {' OR '.join(f't_{x} IS NULL' for x in KEY_TAGS)}) AS missing_key_tags,
       CAST(count(*) FILTER (WHERE {' AND '.join(f't_{x} IS NOT NULL' for x in KEY_TAGS)}) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS key_tag_coverage
FROM t GROUP BY 1"""))
def q_tag_coverage(spark, sf):
    """B-31: the eight base tags as a map per line (a blank tag is a missing one); how many lines lack each tag and
    any of the key tags, per provider."""
    l = fx.cost_lines(spark, sf)
    tags = F.create_map(*[c for x in TAGS for c in (F.lit(x), F.expr(f"nullif({TAG_SQL[x]}, '')"))])
    l = l.select("provider", F.map_filter(tags, lambda k, v: v.isNotNull()).alias("tags"))
    missing = {x: ~F.map_contains_key("tags", x) for x in TAGS}
    lacks_key = missing[KEY_TAGS[0]]
    for x in KEY_TAGS[1:]:
        lacks_key = lacks_key | missing[x]
    return l.groupBy("provider").agg(
        F.count("*").alias("lines"),
        *[F.count(F.when(missing[x], 1)).alias(f"missing_{x}") for x in TAGS],
        F.count(F.when(lacks_key, 1)).alias("missing_key_tags"),
        (F.count(F.when(~lacks_key, 1)).cast("double") / F.count("*").cast("double")).alias("key_tag_coverage"),
    )


@register("source_gaps", with_views(["v_samples"], """
SELECT storage_node_id, min(date_trunc('minute', collected_at)) AS first_minute, max(date_trunc('minute', collected_at)) AS last_minute,
       CAST(date_diff('minute', min(date_trunc('minute', collected_at)), max(date_trunc('minute', collected_at))) + 1 AS BIGINT) AS expected_minutes,
       count(DISTINCT date_trunc('minute', collected_at)) AS observed_minutes,
       CAST(date_diff('minute', min(date_trunc('minute', collected_at)), max(date_trunc('minute', collected_at))) + 1 AS BIGINT)
         - count(DISTINCT date_trunc('minute', collected_at)) AS missing_minutes
FROM v_samples GROUP BY 1"""))
def q_source_gaps(spark, sf):
    """B-34: per storage node, minutes between its first and last snapshot with no
    snapshot (counted, not listed: the spine length is arithmetic)."""
    s = fx.samples(spark, sf).withColumn("m", F.date_trunc("minute", "collected_at").cast("timestamp_ntz"))
    g = s.groupBy("storage_node_id").agg(
        F.min("m").alias("first_minute"), F.max("m").alias("last_minute"), F.countDistinct("m").alias("observed_minutes")
    )
    expected = (F.timestamp_diff("MINUTE", F.col("first_minute"), F.col("last_minute")) + 1).cast("long")
    return g.select("storage_node_id", "first_minute", "last_minute", expected.alias("expected_minutes"), "observed_minutes",
                    (expected - F.col("observed_minutes")).alias("missing_minutes"))


@register("ops_metrics", with_views(["v_quota_states", "v_payments", "v_samples"], """
SELECT (SELECT count(*) FROM v_quota_states WHERE arrears) AS arrears_accounts,
       (SELECT count(*) FROM v_quota_states WHERE suspend_state = 'suspended') AS suspended_accounts,
       (SELECT CAST(count(*) FILTER (WHERE event_type = 'payment_failed') AS DOUBLE) / CAST(count(*) AS DOUBLE) FROM v_payments) AS payment_failure_rate,
       (SELECT max(collected_at) FROM v_samples) AS latest_snapshot_at"""))
def q_ops_metrics(spark, sf):
    """B-35: arrears count, suspended count, payment failure rate, freshness; one
    aggregate over a union of the three narrow inputs."""
    q = fx.quota_states(spark, sf).select(
        F.lit("q").alias("k"), F.col("arrears").alias("a"), (F.col("suspend_state") == "suspended").alias("s"),
        F.lit(None).cast("boolean").alias("f"), F.lit(None).cast("timestamp_ntz").alias("t"))
    p = fx.payments(spark, sf).select(
        F.lit("p").alias("k"), F.lit(None).cast("boolean").alias("a"), F.lit(None).cast("boolean").alias("s"),
        (F.col("event_type") == "payment_failed").alias("f"), F.lit(None).cast("timestamp_ntz").alias("t"))
    s = fx.samples(spark, sf).select(
        F.lit("s").alias("k"), F.lit(None).cast("boolean").alias("a"), F.lit(None).cast("boolean").alias("s"),
        F.lit(None).cast("boolean").alias("f"), F.col("collected_at").alias("t"))
    u = q.unionByName(p).unionByName(s)
    return u.agg(
        F.count(F.when(F.col("a"), 1)).alias("arrears_accounts"),
        F.count(F.when(F.col("s"), 1)).alias("suspended_accounts"),
        (F.count(F.when(F.col("f"), 1)).cast("double") / F.count(F.when(F.col("k") == "p", 1)).cast("double")).alias("payment_failure_rate"),
        F.max("t").alias("latest_snapshot_at"),
    )


# ---------------------------------------------------------------- B-16
def resource_map(spark, sf):
    """Resource -> service mapping with lifecycle: suppliers ending 0/4/8 map to svc-a from 1995-01-01 and to svc-b as
    well from 1996-06-01, suppliers ending 1/5/9 to one service from 1996-01-01 until 1997-07-01, the rest are unmapped."""
    s, k, at = table(spark, sf, "supplier"), F.col("s_suppkey"), lambda day: F.lit(f"{day} 00:00:00").cast("timestamp_ntz")
    row = lambda service, since, until: F.struct(service.alias("service"), since.alias("effective_from"), until.alias("effective_until"))
    open_end = F.lit(None).cast("timestamp_ntz")
    two = F.array(row(F.lit("svc-a"), at("1995-01-01"), open_end), row(F.lit("svc-b"), at("1996-06-01"), open_end))
    one = F.array(row(F.concat(F.lit("svc-"), (k % 3).cast("string")), at("1996-01-01"), at("1997-07-01")))
    return s.filter(k % 4 < 2).select(k.alias("resource_id"), F.explode(F.when(k % 4 == 0, two).otherwise(one)).alias("m")).select("resource_id", "m.*")


@register("resource_mapping", with_views(["v_cost_lines"], """
WITH m AS (SELECT s_suppkey AS resource_id, 'svc-a' AS service, TIMESTAMP '1995-01-01' AS born, CAST(NULL AS TIMESTAMP) AS died
           FROM supplier WHERE s_suppkey % 4 = 0
           UNION ALL SELECT s_suppkey, 'svc-b', TIMESTAMP '1996-06-01', NULL FROM supplier WHERE s_suppkey % 4 = 0
           UNION ALL SELECT s_suppkey, 'svc-' || (s_suppkey % 3), TIMESTAMP '1996-01-01', TIMESTAMP '1997-07-01'
           FROM supplier WHERE s_suppkey % 4 = 1),
l AS (SELECT resource_id, currency, usage_start_time, CAST(date_trunc('month', usage_start_time) AS TIMESTAMP) AS month,
             CAST(sum(amount) * 1000 AS HUGEINT) AS mills, count(*) AS lines FROM v_cost_lines GROUP BY 1, 2, 3, 4),
j AS (SELECT l.*, m.service, count(m.service) OVER w AS n, row_number() OVER (w ORDER BY m.service) AS rank
      FROM l LEFT JOIN m ON l.resource_id = m.resource_id AND l.usage_start_time >= m.born AND (m.died IS NULL OR l.usage_start_time < m.died)
      WINDOW w AS (PARTITION BY l.resource_id, l.currency, l.usage_start_time))
SELECT month, currency, coalesce(service, 'Unallocated') AS service,
       CAST(CAST(sum(CASE WHEN service IS NULL THEN mills WHEN rank = 1 THEN mills - mills // n * (n - 1) ELSE mills // n END) AS DECIMAL(27,0)) * 0.001
            AS DECIMAL(38,12)) AS allocated,
       CAST(sum(lines) AS BIGINT) AS line_parts
FROM j GROUP BY 1, 2, 3"""))
def q_resource_mapping(spark, sf):
    """B-16: each cost line goes to the services its resource maps to at that time, split evenly at full precision;
    unmapped -> Unallocated, so totals are conserved.  The join fans out by at most the mappings of one resource."""
    lines = fx.cost_lines(spark, sf).select(
        "resource_id", "currency", "usage_start_time", "amount",
        F.date_trunc("month", "usage_start_time").cast("timestamp_ntz").alias("month"))
    return identity.cost_by_service(lines, resource_map(spark, sf), "resource_id", "usage_start_time", "amount", ["month", "currency"])
