"""Read-side queries: usage of the current period (B-1), the cost overview (B-27) and AI token cost (B-23).

Rules that the documents leave open are decided here and stated in the docstrings.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from meterwise.operators import ai_rating, analytics, periods
from meterwise.operators.pricing import attach_pricing
from meterwise.plans.catalog import register
from meterwise.plans.oracle import view, with_views
from meterwise.plans.queries_metering import FIXTURE_CFG, metered
from meterwise.plans.queries_tier_a import cols
from meterwise.plans.queries_tier_b import LAST_RATED, money, subscriptions
from meterwise.sources import fixtures as fx
from meterwise.sources.tables import table

# ---------------------------------------------------------------- B-1
# Fixed value: the instant of the read; some accounts have traffic after it.
READ_AT = "2024-01-25 12:00:30"
US = ("account_uuid, plan, total_bytes, uplink_bytes, downlink_bytes, included_quota_bytes, remaining_quota, used_quota, used_pct, "
      "period_start, period_end, period_source, period_bytes, last_bucket_at, sync_delay_seconds")


@register("usage_summary_period", with_views(["m_rated", "m_pricing", "v_payments"], f"""
WITH t AS (SELECT TIMESTAMP '{READ_AT}' AS read_at),
tot AS (SELECT account_uuid, CAST(sum(total_bytes) AS BIGINT) AS total_bytes, CAST(sum(uplink_bytes) AS BIGINT) AS uplink_bytes,
               CAST(sum(downlink_bytes) AS BIGINT) AS downlink_bytes, max(bucket_start) AS last_bucket_at FROM m_rated GROUP BY 1),
{LAST_RATED},
f AS (SELECT '00000000-0000-4000-8000-' || lpad(CAST(account_id AS VARCHAR), 12, '0') AS account_uuid,
             TIMESTAMP '2024-01-01' + to_days(CAST(arg_min(event_id, (occurred_at, event_id)) % 20 AS INT)) AS anchor
      FROM v_payments GROUP BY account_id),
k AS (SELECT account_uuid, anchor, date_diff('month', anchor, read_at) AS n, read_at FROM f, t WHERE anchor <= read_at),
s AS (SELECT account_uuid, anchor, CASE WHEN anchor + to_months(CAST(n AS INT)) > read_at THEN n - 1 ELSE n END AS n FROM k),
p AS (SELECT tot.*, CASE WHEN anchor IS NULL THEN date_trunc('month', read_at) ELSE anchor + to_months(CAST(n AS INT)) END AS period_start,
             CASE WHEN anchor IS NULL THEN date_trunc('month', read_at) + INTERVAL 1 MONTH ELSE anchor + to_months(CAST(n + 1 AS INT)) END AS period_end,
             CASE WHEN anchor IS NULL THEN 'calendar' ELSE 'subscription' END AS period_source, read_at
      FROM tot CROSS JOIN t LEFT JOIN s USING (account_uuid)),
b AS (SELECT p.account_uuid, sum(r.total_bytes) AS n FROM p JOIN m_rated r ON r.account_uuid = p.account_uuid AND r.bucket_start >= p.period_start AND r.bucket_start < p.read_at GROUP BY 1),
j AS (SELECT p.*, m.pricing_rule_version AS plan, coalesce(m.included_quota_bytes, 50000) AS included_quota_bytes, last.remaining_after AS remaining_quota,
             CAST(coalesce(b.n, 0) AS BIGINT) AS period_bytes
      FROM p LEFT JOIN last USING (account_uuid) LEFT JOIN m_pricing m USING (account_uuid) LEFT JOIN b USING (account_uuid))
SELECT account_uuid, plan, total_bytes, uplink_bytes, downlink_bytes, included_quota_bytes, remaining_quota,
       CAST(greatest(included_quota_bytes - remaining_quota, 0) AS BIGINT) AS used_quota,
       CASE WHEN included_quota_bytes <> 0 THEN CAST(CAST(greatest(included_quota_bytes - remaining_quota, 0) AS BIGINT) AS DOUBLE)
            / CAST(included_quota_bytes AS DOUBLE) * 100 END AS used_pct,
       CAST(period_start AS TIMESTAMP) AS period_start, CAST(period_end AS TIMESTAMP) AS period_end, period_source, period_bytes, last_bucket_at,
       CAST(greatest(date_part('epoch', read_at) - date_part('epoch', last_bucket_at), 0) AS BIGINT) AS sync_delay_seconds
FROM j"""))
def q_usage_summary_period(spark, sf):
    """B-1 as the accounts page reads it: the whole-history totals and quota use, the period of the entitlement (the
    subscription's month, or the calendar month without one), the bytes of that period up to the read, and how far
    the last bucket lies behind it (0 for one that is not yet past)."""
    r = metered(spark, sf)
    at = F.lit(READ_AT).cast("timestamp_ntz")
    accounts = r.buckets.select("account_uuid").distinct()
    pricing = attach_pricing(accounts, fx.profiles(spark, sf), FIXTURE_CFG)
    s = analytics.usage_summary(r.buckets, r.quota_states, pricing)
    p = periods.account_periods(accounts, subscriptions(spark, sf), READ_AT).withColumn("at", at)
    p = periods.usage_in_windows(r.buckets, p, "account_uuid", "period_start", "at", "period_bytes")
    plan = pricing.join(fx.profiles(spark, sf), "account_uuid", "left_semi").select("account_uuid", F.col("pricing_rule_version").alias("plan"))
    delay = F.greatest(F.timestamp_diff("SECOND", "last_bucket_at", at), F.lit(0)).cast("long")
    return s.join(p, "account_uuid").join(plan, "account_uuid", "left").withColumn("sync_delay_seconds", delay).select(*cols(US))


# ---------------------------------------------------------------- B-27
# Monthly budgets; one currency has none.
BUDGETS = (("USD", Decimal("2000000")), ("EUR", Decimal("1500000")), ("CNY", Decimal("1000000")))


@register("cost_overview", with_views(["v_cost_lines"], f"""
WITH d AS (SELECT currency, service_name, CAST(date_trunc('day', usage_start_time) AS TIMESTAMP) AS day, CAST(date_trunc('month', usage_start_time) AS TIMESTAMP) AS month, sum(amount) AS cost
           FROM v_cost_lines GROUP BY 1, 2, 3, 4),
m AS (SELECT currency, month, max(day) AS as_of, CAST(sum(cost) AS DECIMAL(38,2)) AS cost FROM d GROUP BY 1, 2),
sv AS (SELECT currency, month, service_name, CAST(sum(cost) AS DECIMAL(38,2)) AS c FROM d GROUP BY 1, 2, 3),
top AS (SELECT *, count(*) OVER (PARTITION BY currency, month) AS services FROM sv
        QUALIFY row_number() OVER (PARTITION BY currency, month ORDER BY c DESC, service_name NULLS FIRST) = 1),
prev AS (SELECT m.currency, m.month, CAST(sum(d.cost) AS DECIMAL(38,2)) AS previous_cost FROM m JOIN d ON d.currency = m.currency
         AND d.month + INTERVAL 1 MONTH = m.month AND dayofmonth(d.day) <= dayofmonth(m.as_of) GROUP BY 1, 2),
x AS (SELECT m.*, CAST(m.cost AS DOUBLE) / dayofmonth(as_of) * dayofmonth(last_day(as_of)) AS forecast, b.budget, previous_cost,
             CAST(m.cost - previous_cost AS DECIMAL(38,2)) AS change, top.service_name AS top_service, top.c AS top_cost, services
      FROM m JOIN top USING (currency, month) LEFT JOIN prev USING (currency, month)
      LEFT JOIN (VALUES {', '.join(f"('{c}', CAST({b} AS DECIMAL(18,2)))" for c, b in BUDGETS)}) b(currency, budget) USING (currency))
SELECT currency, month, as_of, cost, forecast, budget, CAST(cost AS DOUBLE) / CAST(budget AS DOUBLE) AS budget_used, forecast / CAST(budget AS DOUBLE) AS budget_forecast,
       previous_cost, change, CASE WHEN previous_cost <> 0 THEN CAST(change AS DOUBLE) / CAST(previous_cost AS DOUBLE) END AS change_ratio, top_service, top_cost, services
FROM x"""))
def q_cost_overview(spark, sf):
    """B-27: the overview's numbers per currency and month in one row."""
    d = fx.cost_lines(spark, sf).groupBy("currency", "service_name", F.date_trunc("day", "usage_start_time").cast("timestamp_ntz").alias("day")).agg(
        money(F.sum("amount")).alias("cost"))
    budgets = spark.createDataFrame(list(BUDGETS), "currency string, budget decimal(18,2)")
    return analytics.cost_overview(d, budgets)


# ---------------------------------------------------------------- B-23
# Prices per million tokens (input, cached, output) from a day on.  model-2 has no price before March
# and no cached price; model-3 has none at all.
PRICES = (
    ("model-0", "2024-01-01", "3.00", "0.30", "15.00"), ("model-0", "2024-02-10", "2.50", "0.25", "12.50"),
    ("model-1", "2024-01-01", "0.15", "0.075", "0.60"), ("model-2", "2024-03-01", "10.00", None, "30.00"),
)
AI_DIMS = ("user_id", "project", "model", "task")


view("v_ai_usage", (), """
SELECT TIMESTAMP '2024-01-01' + to_days(CAST(conv_id % 90 AS INT)) AS used_at, 'model-' || (conv_id % 4) AS model, conv_id % 11 AS user_id,
       'project-' || (conv_id % 5) AS project, CASE WHEN role = 'system' THEN 'setup' WHEN turn > 3 THEN 'long chat' ELSE 'chat' END AS task,
       CASE WHEN role = 'assistant' THEN 0 ELSE coalesce(length(text), 0) // 4 - CASE WHEN turn > 1 THEN coalesce(length(text), 0) // 12 ELSE 0 END END AS input_tokens,
       CASE WHEN role <> 'assistant' AND turn > 1 THEN coalesce(length(text), 0) // 12 ELSE 0 END AS cached_tokens,
       CASE WHEN role = 'assistant' THEN coalesce(length(text), 0) // 4 ELSE 0 END AS output_tokens
FROM conversations
""")


def ai_usage(spark, sf):
    """A turn stands for a request: four characters a token; what users and systems say is input, of which later turns
    have a third from the cache."""
    c, k = table(spark, sf, "conversations"), F.col("conv_id")
    length = F.coalesce(F.char_length("text"), F.lit(0))
    answer, later = F.col("role") == "assistant", F.col("turn") > 1
    quarter, part = F.floor(length / 4), F.floor(length / 12)
    return c.select(
        F.timestamp_add("DAY", (k % 90).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("used_at"),
        F.concat(F.lit("model-"), (k % 4).cast("string")).alias("model"), (k % 11).alias("user_id"),
        F.concat(F.lit("project-"), (k % 5).cast("string")).alias("project"),
        F.when(F.col("role") == "system", "setup").when(F.col("turn") > 3, "long chat").otherwise("chat").alias("task"),
        F.when(answer, 0).otherwise(quarter - F.when(later, part).otherwise(0)).alias("input_tokens"),
        F.when(~answer & later, part).otherwise(0).alias("cached_tokens"),
        F.when(answer, quarter).otherwise(0).alias("output_tokens"))


@register("ai_token_cost", with_views(["v_ai_usage"], f"""
WITH pr AS (SELECT *, lead(f) OVER (PARTITION BY model ORDER BY f) AS u FROM (VALUES {', '.join(
    f"('{m}', TIMESTAMP '{f}', CAST({i} AS DECIMAL(12,6)), CAST({c or i} AS DECIMAL(12,6)), CAST({o} AS DECIMAL(12,6)))" for m, f, i, c, o in PRICES)}) t(model, f, pi, pc, po)),
r AS (SELECT a.*, CAST(date_trunc('month', used_at) AS TIMESTAMP) AS month, pr.f IS NOT NULL AS priced, CAST(a.input_tokens * pi + a.cached_tokens * pc + a.output_tokens * po AS DECIMAL(38,6)) AS micro
      FROM v_ai_usage a LEFT JOIN pr ON a.model = pr.model AND pr.f <= used_at AND (pr.u IS NULL OR used_at < pr.u)),
x AS ({' UNION ALL '.join(f"SELECT month, '{d}' AS dim, CAST({d} AS VARCHAR) AS item, input_tokens, cached_tokens, output_tokens, micro, priced FROM r" for d in AI_DIMS)})
SELECT month, dim, item, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(cached_tokens) AS BIGINT) AS cached_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
       CAST(CAST(sum(micro) AS DECIMAL(26,6)) * CAST(0.000001 AS DECIMAL(6,6)) AS DECIMAL(38,6)) AS cost,
       CAST(sum(CASE WHEN priced THEN 0 ELSE input_tokens + cached_tokens + output_tokens END) AS BIGINT) AS unpriced_tokens
FROM x GROUP BY 1, 2, 3"""))
def q_ai_token_cost(spark, sf):
    """B-23: tokens and cost by month for each user, project, model and task."""
    prices = spark.createDataFrame([(m, f, *[x and Decimal(x) for x in p]) for m, f, *p in PRICES],
                                   "model string, f string, input_price decimal(12,6), cached_price decimal(12,6), output_price decimal(12,6)")
    prices = prices.withColumn("effective_from", F.col("f").cast("timestamp_ntz"))
    daily = ai_rating.daily_tokens(ai_usage(spark, sf), [d for d in AI_DIMS if d != "model"])
    return ai_rating.token_costs(ai_rating.rate_tokens(daily, prices), AI_DIMS)
