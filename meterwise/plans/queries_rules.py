"""Queries whose rules are tables: resource names, allocation rules, mapping rules, price scopes, the source gate; and
margins, which join metering with cost.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from meterwise.operators import allocation, analytics, identity, margin, metering, status, sync
from meterwise.operators.focus import FOCUS_RULES, columns_of, map_lines
from meterwise.operators.pricing import resolve_pricing
from meterwise.plans.catalog import register
from meterwise.plans.collect_job import collect, source_report
from meterwise.plans.oracle import VIEWS, buckets_sql, delta_sql, rated_sql, t, view, with_views
from meterwise.plans.queries_metering import FIXTURE_CFG, metered
from meterwise.plans.queries_tier_a import IDENT_SQL, SOURCED_SQL, WINDOW_AS_OF, WINDOW_SQL, sourced, sync_state
from meterwise.sources import fixtures as fx
from meterwise.sources.tables import table


def ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


def month_of(col: str):
    return F.date_trunc("month", col).cast("timestamp_ntz")


# ---------------------------------------------------------------- B-16
# Lives of a supplier's names by its key's remainder of 7: (remainder, suffix, born, died, next suffix).
LIVES = (
    (1, "", "1990-01-01", "1996-01-01", "-b"), (1, "-b", "1996-01-01", "1997-06-01", "-c"), (1, "-c", "1997-06-01", "1999-01-01", "-d"),
    (1, "-d", "1999-01-01", None, None), (2, "", "1990-01-01", "1998-01-01", None), (3, "", "1990-01-01", "1997-01-01", "-b"),
    (3, "-b", "1997-01-01", None, None), (3, "", "1999-01-01", None, None), (4, "", "1996-06-01", None, None), (5, "", "1990-01-01", None, None),
    (6, "", "1990-01-01", None, None), (0, "", "1990-01-01", None, None),
)


def resource_names(spark, sf):
    """Names of every supplier: three renames, a retirement, a rename with the old name born again, a late start."""
    lives = spark.createDataFrame([(a, b, c, d, e) for a, b, c, d, e in LIVES], "m int, suffix string, born string, died string, next string")
    s = table(spark, sf, "supplier").select(F.concat(F.lit("r"), F.col("s_suppkey").cast("string")).alias("k"), (F.col("s_suppkey") % 7).cast("int").alias("m"))
    j = s.join(lives, "m")
    nxt = F.col("next").isNotNull()
    return j.select(F.concat("k", "suffix").alias("name"), F.col("born").cast("timestamp_ntz").alias("born"), F.col("died").cast("timestamp_ntz").alias("died"),
                    F.when(nxt, F.concat("k", "next")).alias("next_name"), F.when(nxt, F.col("died").cast("timestamp_ntz")).alias("next_born"))


def named_lines(spark, sf):
    """Cost lines under the name their feed knows: legacy feeds keep the first name, modern ones the name in force."""
    l = fx.cost_lines(spark, sf)
    k, at = F.col("resource_id"), F.col("usage_start_time")
    in_force = F.when(k % 7 == 1, F.when(at < ntz("1996-01-01"), "").when(at < ntz("1997-06-01"), "-b").when(at < ntz("1999-01-01"), "-c").otherwise("-d")).when(
        (k % 7 == 3) & (at >= ntz("1997-01-01")), "-b").otherwise("")
    suffix = F.when(F.col("kind") == "modern", in_force).otherwise("")
    return l.select(F.concat(F.lit("r"), k.cast("string"), suffix).alias("name"), "usage_start_time", month_of("usage_start_time").alias("month"), "currency", "amount")


def _ts(x):
    return "NULL::TIMESTAMP" if x is None else f"TIMESTAMP '{x}'"


view("v_names", (), f"""
SELECT 'r' || s_suppkey || suffix AS name, born, died, CASE WHEN next IS NOT NULL THEN 'r' || s_suppkey || next END AS next_name,
       CASE WHEN next IS NOT NULL THEN died END AS next_born
FROM supplier JOIN (VALUES {', '.join(f"({m}, '{s}', {_ts(b)}, {_ts(d)}, {'NULL' if n is None else repr(n)})" for m, s, b, d, n in LIVES)}) v(m, suffix, born, died, next)
  ON s_suppkey % 7 = m
""")
view("v_named_lines", ("v_cost_lines",), """
SELECT 'r' || resource_id || CASE WHEN kind <> 'modern' THEN ''
         WHEN resource_id % 7 = 1 THEN CASE WHEN usage_start_time < TIMESTAMP '1996-01-01' THEN '' WHEN usage_start_time < TIMESTAMP '1997-06-01' THEN '-b'
                                            WHEN usage_start_time < TIMESTAMP '1999-01-01' THEN '-c' ELSE '-d' END
         WHEN resource_id % 7 = 3 AND usage_start_time >= TIMESTAMP '1997-01-01' THEN '-b' ELSE '' END AS name,
       usage_start_time, CAST(date_trunc('month', usage_start_time) AS TIMESTAMP) AS month, currency, amount
FROM v_cost_lines
""")


@register("resource_renames", with_views(["v_names", "v_named_lines"], """
WITH c AS (
  SELECT a.name, a.born, lead(a.born) OVER (PARTITION BY a.name ORDER BY a.born) AS until,
         coalesce(d.name, c.name, b.name, a.name) AS resource,
         CASE WHEN d.name IS NOT NULL THEN d.died WHEN c.name IS NOT NULL THEN c.died WHEN b.name IS NOT NULL THEN b.died ELSE a.died END AS ended_at,
         CASE WHEN d.name IS NOT NULL THEN 3 WHEN c.name IS NOT NULL THEN 2 WHEN b.name IS NOT NULL THEN 1 ELSE 0 END AS hops
  FROM v_names a LEFT JOIN v_names b ON b.name = a.next_name AND b.born = a.next_born
  LEFT JOIN v_names c ON c.name = b.next_name AND c.born = b.next_born LEFT JOIN v_names d ON d.name = c.next_name AND d.born = c.next_born),
j AS (SELECT l.*, c.resource, c.hops, CASE WHEN c.born IS NULL THEN 'unmapped' WHEN l.usage_start_time >= c.ended_at THEN 'after_end' ELSE 'active' END AS status
      FROM v_named_lines l LEFT JOIN c ON l.name = c.name AND l.usage_start_time >= c.born AND (c.until IS NULL OR l.usage_start_time < c.until))
SELECT month, currency, CASE WHEN status = 'active' THEN resource ELSE 'Unallocated' END AS resource, status,
       CAST(sum(amount) AS DECIMAL(38,2)) AS cost, count(*) AS lines, CAST(max(hops) AS BIGINT) AS hops
FROM j GROUP BY 1, 2, 3, 4"""))
def q_resource_renames(spark, sf):
    """B-16: monthly cost by the resource's last name, through chains of renames, ends and names that are born again."""
    return identity.cost_by_resource(named_lines(spark, sf), resource_names(spark, sf), "name", "usage_start_time", "amount", ["month", "currency"])


# ---------------------------------------------------------------- B-18
# Allocation rules (rule, pool, method, priority, from, to, state) and their shares (rule, target, weight).
RULES = (
    ("R1", "aws", "proportional", 10, "1990-01-01", "1998-01-01", "active"), ("R2", "aws", "fixed", 5, "1997-01-01", None, "active"),
    ("R3", "gcp", "equal", 10, "1990-01-01", None, "active"), ("R4", "gcp", "usage", 10, "1996-07-01", None, "active"),
    ("R5", "*", "usage", 100, "1995-06-01", None, "active"), ("R6", "aws", "equal", 20, "1999-01-01", None, "active"),
    ("R7", "*", "custom", 5, "2000-01-01", "2000-07-01", "active"), ("D1", "azure", "custom", 1, "1998-01-01", None, "draft"),
)
SHARES = (("R2", "team-0", 40), ("R2", "team-1", 30), ("R2", "team-2", 30), ("R7", "team-3", 1), ("R7", "team-4", 2), ("D1", "team-1", 3), ("D1", "team-2", 1))
BACKDATED = tuple(("R2", "aws", "fixed", 5, "1996-01-01", None, "active") if r[0] == "R2" else r for r in RULES)
POOL = ["month", "currency", "provider"]


def rule_tables(spark, rules):
    r = spark.createDataFrame(list(rules), "rule_id string, pool string, method string, priority int, effective_from string, effective_to string, state string")
    r = r.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("effective_from", "effective_to")})
    return r, spark.createDataFrame(list(SHARES), "rule_id string, target string, weight long")


def pool_facts(spark, sf):
    l = fx.cost_lines(spark, sf).withColumn("month", month_of("usage_start_time"))
    shared, amount = F.col("cost_center").isNull(), F.col("amount").cast("decimal(38,12)")
    return l.groupBy(*POOL, "team").agg(F.sum(F.when(shared, amount)).alias("shared"), F.sum(F.when(~shared, amount)).alias("direct"),
                                        F.sum(F.when(~shared, F.col("usage_quantity"))).cast("long").alias("usage"))


def by_rules(spark, sf, rules, drafts=False):
    r, shares = rule_tables(spark, rules)
    return allocation.allocate_by_rules(pool_facts(spark, sf), r, shares, POOL, "provider", "month", "team", drafts)


def rules_sql(name: str, rules, drafts: bool = False) -> str:
    live = [r for r in rules if drafts or r[6] == "active"]
    values = ", ".join(f"('{a}', '{b}', '{c}', {d}, {_ts(e)}, {_ts(f)})" for a, b, c, d, e, f, _ in live)
    return f"""
{name}_p AS (SELECT month, currency, provider, CAST(round(sum(shared) * 100, 0) AS BIGINT) AS pool_cents, count(direct) AS targets
        FROM facts GROUP BY 1, 2, 3 HAVING count(shared) > 0),
{name}_c AS (SELECT p.*, r.rule_id, r.method FROM {name}_p p LEFT JOIN (VALUES {values}) r(rule_id, pool, method, priority, f, t)
        ON r.pool IN ('*', p.provider) AND r.f <= p.month AND (r.t IS NULL OR p.month < r.t)
        QUALIFY row_number() OVER (PARTITION BY p.month, p.currency, p.provider ORDER BY r.priority, r.pool = '*', r.f DESC, r.rule_id) = 1),
{name}_w AS (SELECT c.*, f.team, CAST(greatest(CASE c.method WHEN 'equal' THEN 1 WHEN 'proportional' THEN CAST(round(f.direct * 100, 0) AS BIGINT) WHEN 'usage' THEN f.usage
             ELSE coalesce(s.weight, 0) END, 0) AS BIGINT) AS weight
        FROM {name}_c c JOIN facts f USING (month, currency, provider) LEFT JOIN (VALUES {', '.join(f"('{a}', '{b}', {c})" for a, b, c in SHARES)}) s(rule_id, team, weight)
        ON s.rule_id = c.rule_id AND s.team = f.team WHERE f.direct IS NOT NULL AND c.rule_id IS NOT NULL),
{name}_e AS (SELECT *, CASE WHEN sum(weight) OVER w > 0 THEN weight ELSE 1 END AS eff, CASE WHEN sum(weight) OVER w > 0 THEN sum(weight) OVER w ELSE count(*) OVER w END AS den
        FROM {name}_w WINDOW w AS (PARTITION BY month, currency, provider)),
{name}_s AS (SELECT *, CAST((CAST(pool_cents AS HUGEINT) * eff) // den AS BIGINT) AS share FROM {name}_e),
{name} AS (SELECT month, currency, provider, rule_id, method, team, weight,
                  CAST(share + CASE WHEN row_number() OVER (PARTITION BY month, currency, provider ORDER BY eff DESC, team) = 1
                       THEN pool_cents - sum(share) OVER (PARTITION BY month, currency, provider) ELSE 0 END AS BIGINT) AS allocated_cents FROM {name}_s
           UNION ALL SELECT month, currency, provider, rule_id, method, 'Unallocated', 0, pool_cents FROM {name}_c WHERE rule_id IS NULL OR targets = 0)"""


FACTS_SQL = """facts AS (SELECT CAST(date_trunc('month', usage_start_time) AS TIMESTAMP) AS month, currency, provider, team,
  sum(amount) FILTER (WHERE cost_center IS NULL) AS shared, sum(amount) FILTER (WHERE cost_center IS NOT NULL) AS direct,
  CAST(sum(usage_quantity) FILTER (WHERE cost_center IS NOT NULL) AS BIGINT) AS usage FROM v_cost_lines GROUP BY 1, 2, 3, 4)"""
CHANGE_SQL = """SELECT month, currency, provider, team, a.rule_id AS before_rule, b.rule_id AS after_rule,
  coalesce(a.allocated_cents, 0) AS before_cents, coalesce(b.allocated_cents, 0) AS after_cents, coalesce(b.allocated_cents, 0) - coalesce(a.allocated_cents, 0) AS change_cents
FROM a FULL OUTER JOIN b USING (month, currency, provider, team) WHERE coalesce(a.allocated_cents, 0) <> coalesce(b.allocated_cents, 0)"""


@register("allocate_rules", with_views(["v_cost_lines"], f"WITH {FACTS_SQL}, {rules_sql('a', RULES)} SELECT * FROM a"))
def q_allocate_rules(spark, sf):
    """B-18: each month's pools by the rule in force, chosen by priority among effective-dated rules."""
    return by_rules(spark, sf, RULES)


@register("allocate_simulated", with_views(["v_cost_lines"], f"WITH {FACTS_SQL}, {rules_sql('a', RULES)}, {rules_sql('b', RULES, True)} {CHANGE_SQL}"))
def q_allocate_simulated(spark, sf):
    """B-18: what the draft rules would change."""
    return allocation.allocation_changes(by_rules(spark, sf, RULES), by_rules(spark, sf, RULES, True), POOL, "team")


@register("allocate_recomputed", with_views(["v_cost_lines"], f"WITH {FACTS_SQL}, {rules_sql('a', RULES)}, {rules_sql('b', BACKDATED)} {CHANGE_SQL}"))
def q_allocate_recomputed(spark, sf):
    """B-18: adjustments to the past months that a backdated rule changes."""
    return allocation.allocation_changes(by_rules(spark, sf, RULES), by_rules(spark, sf, BACKDATED), POOL, "team")


# ---------------------------------------------------------------- B-11, B-12
# The fixture's costs and payments of this year stand for the months of the metered year.
COST_YEAR, USAGE_YEAR = 1996, 2024


def as_usage_month(col: str):
    return F.make_timestamp_ntz(F.lit(USAGE_YEAR), F.month(col), F.lit(1), F.lit(0), F.lit(0), F.lit(0))


def node_costs(spark, sf):
    """Monthly cost of the metered nodes in USD cents: the resources that run on a node, at the month's rate."""
    l = fx.cost_lines(spark, sf).filter(F.year("usage_start_time") == COST_YEAR).withColumn("month", month_of("usage_start_time"))
    k = F.col("resource_id") % 3
    node = F.when(k == 0, "prod:node-0").when(k == 1, "prod:node-1").otherwise("uat:node-2")
    j = l.join(fx.rates(spark, sf), ["currency", "month"], "left").filter(F.col("rate_to_usd") > 0)
    return j.groupBy(as_usage_month("month").alias("month"), node.alias("node_id")).agg(
        allocation.cents(F.sum(F.col("amount") * F.col("rate_to_usd"))).alias("pool_cents"))


def account_revenue(spark, sf):
    p = fx.payments(spark, sf).filter((F.col("event_type") == "invoice_paid") & (F.year("occurred_at") == COST_YEAR))
    return p.groupBy(as_usage_month("occurred_at").alias("month"), fx.account_uuid(F.col("account_id")).alias("account_uuid")).agg(
        allocation.cents(F.sum("amount")).alias("revenue_cents"))


def account_plans(spark, sf):
    return resolve_pricing(fx.profiles(spark, sf), FIXTURE_CFG).select("account_uuid", F.col("pricing_rule_version").alias("plan"))


def margins(spark, sf):
    return margin.account_margin(margin.node_traffic(metered(spark, sf).buckets), node_costs(spark, sf), account_revenue(spark, sf), account_plans(spark, sf))


MARGIN_SQL = f"""
pool AS (SELECT make_timestamp({USAGE_YEAR}, month(l.usage_start_time), 1, 0, 0, 0) AS month,
                CASE resource_id % 3 WHEN 0 THEN 'prod:node-0' WHEN 1 THEN 'prod:node-1' ELSE 'uat:node-2' END AS node_id,
                CAST(round(sum(amount * rate_to_usd) * 100, 0) AS BIGINT) AS pool_cents
         FROM v_cost_lines l JOIN v_rates r ON r.currency = l.currency AND r.month = CAST(date_trunc('month', usage_start_time) AS TIMESTAMP)
         WHERE year(usage_start_time) = {COST_YEAR} AND rate_to_usd > 0 GROUP BY 1, 2),
use AS (SELECT CAST(date_trunc('month', bucket_start) AS TIMESTAMP) AS month, node_id, account_uuid, CAST(sum(total_bytes) AS HUGEINT) AS w
        FROM m_buckets GROUP BY 1, 2, 3 HAVING sum(total_bytes) > 0),
sh AS (SELECT use.*, pool_cents, CAST((pool_cents * w) // sum(w) OVER p AS BIGINT) AS share, row_number() OVER (PARTITION BY month, node_id ORDER BY w DESC, account_uuid) AS rk
       FROM use JOIN pool USING (month, node_id) WINDOW p AS (PARTITION BY month, node_id)),
sh2 AS (SELECT month, account_uuid, w, share + CASE WHEN rk = 1 THEN pool_cents - sum(share) OVER (PARTITION BY month, node_id) ELSE 0 END AS c FROM sh
        UNION ALL SELECT month, 'Unallocated', 0, pool_cents FROM pool ANTI JOIN use USING (month, node_id)),
cost AS (SELECT month, account_uuid, CAST(sum(w) AS BIGINT) AS bytes, CAST(sum(c) AS BIGINT) AS cost_cents FROM sh2 GROUP BY 1, 2),
rev AS (SELECT make_timestamp({USAGE_YEAR}, month(occurred_at), 1, 0, 0, 0) AS month, '00000000-0000-4000-8000-' || lpad(CAST(account_id AS VARCHAR), 12, '0') AS account_uuid,
               CAST(round(sum(amount) * 100, 0) AS BIGINT) AS revenue_cents
        FROM v_payments WHERE event_type = 'invoice_paid' AND year(occurred_at) = {COST_YEAR} GROUP BY 1, 2),
margin AS (SELECT month, account_uuid, CASE WHEN account_uuid = 'Unallocated' THEN account_uuid ELSE coalesce(pricing_rule_version, 'none') END AS plan,
                  coalesce(bytes, 0) AS bytes, coalesce(revenue_cents, 0) AS revenue_cents, coalesce(cost_cents, 0) AS cost_cents,
                  coalesce(revenue_cents, 0) - coalesce(cost_cents, 0) AS margin_cents
           FROM cost FULL OUTER JOIN rev USING (month, account_uuid) LEFT JOIN m_pricing USING (account_uuid)),
by_plan AS (SELECT month, plan, count(*) AS accounts, count(*) FILTER (WHERE margin_cents < 0) AS losing_accounts, CAST(sum(bytes) AS BIGINT) AS bytes,
                   CAST(sum(revenue_cents) AS BIGINT) AS revenue_cents, CAST(sum(cost_cents) AS BIGINT) AS cost_cents, CAST(sum(margin_cents) AS BIGINT) AS margin_cents
            FROM margin GROUP BY 1, 2)"""
MARGIN_VIEWS = ["m_buckets", "m_pricing", "v_cost_lines", "v_rates", "v_payments"]


@register("margin_by_user", with_views(MARGIN_VIEWS, f"WITH {MARGIN_SQL} SELECT * FROM margin"))
def q_margin_by_user(spark, sf):
    """B-11: revenue less the account's share of the nodes it used, by month."""
    return margins(spark, sf)


@register("margin_by_plan", with_views(MARGIN_VIEWS, f"WITH {MARGIN_SQL} SELECT * FROM by_plan"))
def q_margin_by_plan(spark, sf):
    """B-11: margins by plan, with the accounts that lose money."""
    return margin.plan_margin(margins(spark, sf))


@register("plan_health", with_views(MARGIN_VIEWS, f"""
WITH {MARGIN_SQL},
plans AS (SELECT pricing_rule_version AS plan, max(included_quota_bytes) AS included_quota_bytes, CAST(max(included_quota_bytes) // 1000 AS BIGINT) AS price_cents
          FROM m_pricing GROUP BY 1),
u AS (SELECT month, plan, cost_cents, bytes, CASE WHEN bytes <> 0 THEN CAST(cost_cents AS DOUBLE) / CAST(bytes AS DOUBLE) END AS unit_cost_cents, included_quota_bytes, price_cents
      FROM by_plan JOIN plans USING (plan))
SELECT *, CAST(included_quota_bytes AS DOUBLE) * unit_cost_cents AS quota_cost_cents, CAST(price_cents AS DOUBLE) >= CAST(included_quota_bytes AS DOUBLE) * unit_cost_cents AS healthy FROM u"""))
def q_plan_health(spark, sf):
    """B-12: unit cost of each plan's traffic against its price and included quota (null without traffic)."""
    plans = resolve_pricing(fx.profiles(spark, sf), FIXTURE_CFG).groupBy(F.col("pricing_rule_version").alias("plan")).agg(
        F.max("included_quota_bytes").alias("included_quota_bytes"), F.expr("CAST(max(included_quota_bytes) div 1000 AS BIGINT)").alias("price_cents"))
    return margin.plan_health(margin.plan_margin(margins(spark, sf)), plans)


# ---------------------------------------------------------------- B-14
RAW = ("provider", "service_name", "region", "kind", "amount")


@register("focus_traced", with_views(["v_cost_lines"], """
SELECT provider AS provider_name, account_id AS sub_account_id, coalesce(service_name, 'Unknown') AS service_name,
       CASE WHEN provider = 'gcp' AND (region IS NULL OR region = '') THEN 'global' WHEN provider = 'azure' AND region IS NULL THEN 'Unknown' ELSE region END AS region_name,
       usage_start_time AS charge_period_start, usage_start_time + INTERVAL 1 DAY AS charge_period_end, amount AS billed_cost, amount AS effective_cost, amount AS list_cost,
       currency AS billing_currency, CASE WHEN amount < 0 THEN 'Credit' WHEN kind = 'modern' AND amount = 0 THEN 'Adjustment' ELSE 'Usage' END AS charge_category,
       'res-' || resource_id AS resource_id,
       'provider-1' AS rule_provider_name, 'account-1' AS rule_sub_account_id, CASE WHEN service_name IS NULL THEN 'service-1' ELSE 'service-2' END AS rule_service_name,
       CASE WHEN provider = 'gcp' AND (region IS NULL OR region = '') THEN 'region-1' WHEN provider = 'azure' AND region IS NULL THEN 'region-2' ELSE 'region-3' END AS rule_region_name,
       'period-1' AS rule_charge_period_start, 'period-2' AS rule_charge_period_end, 'billed-1' AS rule_billed_cost, 'effective-1' AS rule_effective_cost,
       'list-1' AS rule_list_cost, 'currency-1' AS rule_billing_currency,
       CASE WHEN amount < 0 THEN 'category-1' WHEN kind = 'modern' AND amount = 0 THEN 'category-2' ELSE 'category-3' END AS rule_charge_category,
       CASE WHEN resource_id IS NOT NULL THEN 'resource-1' END AS rule_resource_id,
       provider AS raw_provider, service_name AS raw_service_name, region AS raw_region, kind AS raw_kind, amount AS raw_amount
FROM v_cost_lines"""))
def q_focus_traced(spark, sf):
    """B-14: common columns, the rule that gave each, and raw fields (of the nested struct, flat here)."""
    m = map_lines(fx.cost_lines(spark, sf))
    names = columns_of(FOCUS_RULES)
    return m.select(*names, *[F.col(f"mapped_by.{c}").alias(f"rule_{c}") for c in names], *[F.col(f"raw.{c}").alias(f"raw_{c}") for c in RAW])


# ---------------------------------------------------------------- B-21
view("v_price_book_regional", (), """
SELECT p_type AS service_name, CASE p_partkey % 4 WHEN 0 THEN 'global' WHEN 1 THEN 'ASIA' WHEN 2 THEN 'EUROPE' ELSE 'global' END AS region,
       CASE p_size % 3 WHEN 0 THEN 'EUR' ELSE 'USD' END AS currency, TIMESTAMP '1995-07-01' + to_years(CAST(p_size % 4 AS INT)) AS effective_from,
       CAST(max(p_retailprice) AS DECIMAL(18,2)) AS unit_price
FROM part GROUP BY 1, 2, 3, 4
""")


def price_book_regional(spark, sf):
    p, k, z = table(spark, sf, "part"), F.col("p_partkey"), F.col("p_size")
    region = F.when(k % 4 == 1, "ASIA").when(k % 4 == 2, "EUROPE").otherwise("global")
    eff = F.timestamp_add("YEAR", (z % 4).cast("int"), ntz("1995-07-01"))
    return p.groupBy(F.col("p_type").alias("service_name"), region.alias("region"), F.when(z % 3 == 0, "EUR").otherwise("USD").alias("currency"), eff.alias("effective_from")).agg(
        F.max("p_retailprice").cast("decimal(18,2)").alias("unit_price"))


@register("price_book_regional", with_views(["v_cost_lines", "v_price_book_regional"], """
WITH u AS (SELECT service_name, region, currency, CAST(date_trunc('day', usage_start_time) AS TIMESTAMP) AS day, sum(usage_quantity) AS quantity
           FROM v_cost_lines GROUP BY 1, 2, 3, 4),
own AS (SELECT u.*, p.unit_price AS p1, p.effective_from AS f1 FROM u ASOF LEFT JOIN v_price_book_regional p
        ON u.service_name = p.service_name AND u.currency = p.currency AND u.region = p.region AND u.day >= p.effective_from),
g AS (SELECT * FROM v_price_book_regional WHERE region = 'global'),
j AS (SELECT own.*, g.unit_price AS p2, g.effective_from AS f2 FROM own ASOF LEFT JOIN g ON own.service_name = g.service_name AND own.currency = g.currency AND own.day >= g.effective_from)
SELECT service_name, region, currency, day, quantity, CASE WHEN p1 IS NOT NULL THEN region WHEN p2 IS NOT NULL THEN 'global' END AS price_scope,
       coalesce(f1, f2) AS price_effective_from, coalesce(p1, p2) AS unit_price, coalesce(p1, p2) IS NOT NULL AS priced,
       CAST(CAST(quantity AS DECIMAL(18,2)) * coalesce(p1, p2) AS DECIMAL(38,4)) AS estimated_cost
FROM j"""))
def q_price_book_regional(spark, sf):
    """B-21: price in force by service, region and currency, with the global price of that currency to fall back on."""
    u = fx.cost_lines(spark, sf).groupBy("service_name", "region", "currency", F.date_trunc("day", "usage_start_time").cast("timestamp_ntz").alias("day")).agg(
        F.sum("usage_quantity").alias("quantity"))
    p = analytics.price_asof_scoped(u, price_book_regional(spark, sf))
    return p.withColumn("estimated_cost", (F.col("quantity").cast("decimal(18,2)") * F.col("unit_price")).cast("decimal(38,4)"))


# ---------------------------------------------------------------- B-24
@register("cost_grains", with_views(["v_cost_lines"], """
WITH l AS (SELECT *, usage_start_time + to_hours(CAST(resource_id % 24 AS INT)) AS t_at FROM v_cost_lines),
g AS (SELECT 'hour' AS grain, CAST(date_trunc('hour', t_at) AS TIMESTAMP) AS period, provider, currency, amount FROM l
      UNION ALL SELECT 'day', CAST(date_trunc('day', t_at) AS TIMESTAMP), provider, currency, amount FROM l
      UNION ALL SELECT 'month', CAST(date_trunc('month', t_at) AS TIMESTAMP), provider, currency, amount FROM l
      UNION ALL SELECT 'all', NULL, provider, currency, amount FROM l)
SELECT grain, period, provider, currency, CAST(sum(amount) AS DECIMAL(38,2)) AS cost, count(*) AS lines, true AS adds_up FROM g GROUP BY 1, 2, 3, 4"""))
def q_cost_grains(spark, sf):
    """B-24: hours, days, months and the whole from one read; each grain adds up to the whole."""
    l = fx.cost_lines(spark, sf)
    at = F.timestamp_add("HOUR", (F.col("resource_id") % 24).cast("int"), F.col("usage_start_time"))
    return analytics.cost_grains(l.withColumn("usage_start_time", at), ["provider", "currency"])


# ---------------------------------------------------------------- A-P3, A-A6
view("g_inbound", ("v_inbound", "v_samples", "v_registry"), f"""
WITH src AS ({SOURCED_SQL}), {WINDOW_SQL},
inwin AS (SELECT s.* FROM src s JOIN win w ON s.source_id = w.source_id WHERE s.collected_at BETWEEN w.since AND w.until),
{IDENT_SQL.replace('SRC', 'inwin')}
SELECT i.* FROM v_inbound i JOIN win w ON w.source_id = 's' || substr(i.node_id, 6) JOIN ident d ON d.source_id = w.source_id
WHERE d.status <> 'error' AND i.collected_at BETWEEN w.since AND w.until
""")
view("g_flagged", ("g_inbound",), VIEWS["m_flagged"][1].replace("v_inbound", "g_inbound"))
view("g_samples", ("g_flagged",), VIEWS["m_samples"][1].replace("m_flagged", "g_flagged"))
view("g_deltas", ("g_samples",), delta_sql("g_samples"))
view("g_buckets", ("g_deltas",), buckets_sql("g_deltas"))
view("g_rated", ("g_buckets", "m_pricing", "v_quota_states"), rated_sql("g_buckets"))


@register("rejected_source_leaves_nothing", with_views(["g_rated", "v_samples", "v_registry"], f"""
WITH src AS ({SOURCED_SQL}), {WINDOW_SQL},
inwin AS (SELECT s.* FROM src s JOIN win w ON s.source_id = w.source_id WHERE s.collected_at BETWEEN w.since AND w.until),
{IDENT_SQL.replace('SRC', 'inwin')},
b AS (SELECT 's' || split_part(node_id, '-', 2) AS source_id, count(*) AS buckets, count(id) AS ledger_rows, CAST(sum(total_bytes) AS BIGINT) AS total_bytes FROM g_rated GROUP BY 1),
last AS (SELECT source_id, max(collected_at) AS last_processed FROM inwin GROUP BY 1),
m AS (SELECT i.source_id, i.status, i.error, i.snapshots, coalesce(b.buckets, 0) AS buckets, coalesce(b.ledger_rows, 0) AS ledger_rows, coalesce(b.total_bytes, 0) AS total_bytes,
             w.previous_until, CASE WHEN i.status = 'error' THEN w.previous_until
               ELSE greatest(w.previous_until, CASE WHEN w.since > w.until THEN w.until ELSE least(w.until, coalesce(l.last_processed, w.until)) END) END AS last_completed_until
      FROM ident i JOIN win w USING (source_id) LEFT JOIN b USING (source_id) LEFT JOIN last l USING (source_id))
SELECT *, previous_until IS DISTINCT FROM last_completed_until AS moved FROM m"""))
def q_rejected_source_leaves_nothing(spark, sf):
    """A-P3 in the job: what each source left behind; the mismatching one has no bucket, ledger row or new mark."""
    reg, state = fx.registry(spark), sync_state(spark, sf)
    entries = fx.inbound(spark, sf).withColumn("source_id", F.concat(F.lit("s"), F.substring("node_id", 6, 10)))
    r = collect(sourced(spark, sf), entries, reg, state, WINDOW_AS_OF, fx.profiles(spark, sf), fx.quota_states(spark, sf), None, FIXTURE_CFG)
    return source_report(r, sync.source_windows(state, reg, WINDOW_AS_OF))


PUSH_BATCH = 40  # snapshots of one push, by event id


@register("push_status", with_views(["v_inbound"], f"""
WITH e AS (SELECT event_id, event_id // {PUSH_BATCH} AS batch_id, CASE WHEN event_id % 211 = 0 THEN ' ' ELSE env END AS env, uuid, node_id, collected_at FROM v_inbound),
s AS (SELECT batch_id, event_id, CASE WHEN max({t('env')}) = '' THEN 'error' WHEN bool_or({t('uuid')} = 'not-a-uuid') THEN 'partial' ELSE 'ok' END AS status FROM e GROUP BY 1, 2)
SELECT batch_id, CASE WHEN bool_or(status = 'error') THEN 'error' WHEN bool_or(status = 'partial') THEN 'partial' ELSE 'ok' END AS status, count(*) AS results,
       count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'partial') AS partial, count(*) FILTER (WHERE status = 'error') AS error,
       min(event_id) FILTER (WHERE status = 'error') AS first_error
FROM s GROUP BY 1"""))
def q_push_status(spark, sf):
    """A-A6: the worst outcome of each pushed batch of snapshots: refused, accepted in part, or accepted."""
    e = fx.inbound(spark, sf).withColumns({"batch_id": F.expr(f"event_id div {PUSH_BATCH}"), "env": F.when(F.col("event_id") % 211 == 0, " ").otherwise(F.col("env"))})
    flagged = metering.flag_samples(e).withColumn("refused", metering.snapshot_reject_reason().isNotNull())
    return status.push_batches(flagged, "batch_id", "event_id")
