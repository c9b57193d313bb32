"""DuckDB SQL text of the fixture views and of the shared metering chain.

``with_views(names, body)`` prepends the named views (and what they depend on) as
CTEs, so every oracle statement runs on the driver's base tables alone.  The Spark
side of each view is in :mod:`meterwise.sources.fixtures` /
:mod:`meterwise.plans.metering_job`; both follow FIXTURES.md.
"""

from __future__ import annotations

WS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"


def t(x: str) -> str:
    """Trim ASCII white space (same set as ``meterwise.functions.text.go_trim``)."""
    return f"trim({x}, {WS})"


HEX = "[0-9a-fA-F]"
DASHED = f"{HEX}{{8}}-{HEX}{{4}}-{HEX}{{4}}-{HEX}{{4}}-{HEX}{{12}}"
UUID_RE = f"^(?:{DASHED}|[uU][rR][nN]:[uU][uU][iI][dD]:{DASHED}|.{DASHED}.|{HEX}{{32}})$"


def canonical(x: str) -> str:
    core = f"CASE WHEN length({x}) = 45 THEN substr({x}, 10, 36) WHEN length({x}) = 38 THEN substr({x}, 2, 36) ELSE {x} END"
    h = f"lower(replace({core}, '-', ''))"
    body = (
        f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || "
        f"substr({h}, 17, 4) || '-' || substr({h}, 21, 12)"
    )
    return f"CASE WHEN regexp_full_match({x}, '{UUID_RE}') THEN {body} END"


def uuid5(key: str) -> str:
    h = f"sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode({key}))"
    return (
        f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || "
        f"translate(substr({h}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({h}, 18, 3) || '-' || "
        f"substr({h}, 21, 12))"
    )


def ledger_id_sql() -> str:
    key = (
        "strftime(bucket_start, '%Y-%m-%dT%H:%M:%SZ') || '|' || node_id || '|' || account_uuid || '|' || "
        "region || '|' || line_code"
    )
    return uuid5(key)


# Fixture defaults for accounts without a profile / quota row (FIXTURES.md).
DEFAULT_PRICE = "(1.0 / 2048)"
DEFAULT_QUOTA = "50000"
DEFAULT_BALANCE = "64.0"
DEFAULT_REVISION = "'rev-1'"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, deps: tuple[str, ...], sql: str) -> None:
    VIEWS[name] = (deps, sql)


view("v_samples", (), """
WITH e AS (
  SELECT event_id, ts AS collected_at, user_id,
         CAST(json_extract_string(props, '$.k') AS INT) AS k,
         CAST(round(value * 100) AS BIGINT) AS up
  FROM events),
x AS (
  SELECT *, 'node-' || (k % 3) AS node_id,
         CASE WHEN k % 3 = 2 THEN 'uat' ELSE 'prod' END AS env,
         '00000000-0000-4000-8000-' || lpad(CAST(user_id AS VARCHAR), 12, '0') AS account_uuid
  FROM e)
SELECT event_id, collected_at, node_id, env, env || ':' || node_id AS storage_node_id, account_uuid, user_id,
       CAST(sum(up)     OVER w AS BIGINT) AS uplink_total,
       CAST(sum(k * 10) OVER w AS BIGINT) AS downlink_total
FROM x
WINDOW w AS (PARTITION BY node_id, user_id, date_trunc('week', collected_at)
             ORDER BY collected_at, event_id ROWS UNBOUNDED PRECEDING)
""")

view("v_inbound", ("v_samples",), """
SELECT event_id, collected_at, node_id, env, 0 AS pos, account_uuid AS uuid, '' AS email, 'xhttp' AS inbound_tag,
       uplink_total - uplink_total // 3 AS uplink_bytes_total, downlink_total AS downlink_bytes_total
FROM v_samples
UNION ALL
SELECT event_id, collected_at, node_id, env, 1,
       CASE WHEN event_id % 97 = 0 THEN 'not-a-uuid' ELSE upper(account_uuid) END,
       ' u' || user_id || '@example.com ', 'tcp', uplink_total // 3, CAST(0 AS BIGINT)
FROM v_samples
""")

view("v_profiles", (), """
SELECT '00000000-0000-4000-8000-' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS account_uuid,
       CAST(CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE (c_custkey % 10 + 1) * 60000 END AS BIGINT) AS included_quota_bytes,
       CASE WHEN c_acctbal < 0 THEN 0.0::DOUBLE ELSE (1 + c_custkey % 5) / 1024.0::DOUBLE END AS base_price_per_byte,
       0.5::DOUBLE * (c_nationkey % 5) AS region_multiplier,
       1 + 0.25::DOUBLE * (c_custkey % 3) AS line_multiplier,
       CASE WHEN c_custkey % 6 = 0 THEN '  ' ELSE 'pricing-v' || (c_custkey % 3) END AS pricing_rule_version
FROM customer WHERE c_mktsegment <> 'BUILDING'
""")

view("v_registry", (), """
SELECT * FROM (VALUES
  ('s0', 'node-0', 'prod', true), ('s1', 'node-1', 'prod', true),
  ('s2', 'node-2', 'prod', true), ('s3', 'node-9', '', false))
AS t(source_id, expected_node_id, expected_env, enabled)
""")

view("v_quota_states", (), """
SELECT '00000000-0000-4000-8000-' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS account_uuid,
       CAST((c_custkey % 7) * 1000 AS BIGINT) AS remaining_included_quota,
       CAST(floor(c_acctbal) AS DOUBLE) AS current_balance, c_acctbal < 0 AS arrears,
       CASE WHEN c_acctbal < 0 AND c_custkey % 5 <> 0
            THEN TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey % 28 AS INT)) END AS arrears_since,
       CASE WHEN c_acctbal < 0 THEN 'throttled' ELSE 'normal' END AS throttle_state,
       CASE WHEN c_custkey % 11 = 0 THEN 'suspended' ELSE 'active' END AS suspend_state
FROM customer
""")

view("v_cost_lines", (), """
SELECT CASE l_suppkey % 3 WHEN 0 THEN 'aws' WHEN 1 THEN 'gcp' ELSE 'azure' END AS provider,
       'acct-' || (l_suppkey % 7) AS account_id, p_type AS service_name,
       CASE WHEN l_suppkey % 3 = 1 AND r_name = 'AFRICA' THEN ''
            WHEN l_suppkey % 3 = 2 AND r_name = 'AMERICA' THEN NULL ELSE r_name END AS region,
       l_shipdate AS usage_start_time,
       CAST(CAST(CAST(round(l_extendedprice * l_discount * 100) AS BIGINT) AS DECIMAL(18,0)) / 100 AS DECIMAL(18,2)) AS amount,
       CASE l_suppkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'CNY' ELSE 'JPY' END AS currency,
       CASE WHEN l_linenumber % 2 = 0 THEN 'modern' ELSE 'legacy' END AS kind,
       l_suppkey AS resource_id, l_quantity AS usage_quantity,
       'team-' || (l_suppkey % 5) AS team, p_brand AS product,
       CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE 'cc-' || (l_suppkey % 4) END AS cost_center
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")

view("v_payments", (), """
SELECT o_orderkey AS event_id, o_custkey AS account_id, o_orderdate AS occurred_at,
       CASE o_orderstatus WHEN 'P' THEN 'invoice_paid' WHEN 'F' THEN 'payment_failed' ELSE 'subscription_updated' END AS event_type,
       CAST(o_totalprice AS DECIMAL(18,2)) AS amount
FROM orders
""")

view("v_rates", (), """
SELECT currency, month,
       CAST(CASE WHEN currency = 'JPY' AND month = TIMESTAMP '1996-03-01' THEN '0'
            WHEN currency = 'USD' THEN '1' WHEN currency = 'EUR' THEN '1.125'
            WHEN currency = 'CNY' THEN '0.140625' ELSE '0.0078125' END AS DECIMAL(18,8)) AS rate_to_usd
FROM (VALUES ('USD'), ('EUR'), ('CNY'), ('JPY')) c(currency),
     (SELECT DISTINCT CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS month FROM lineitem) m
""")

view("v_price_book", (), """
SELECT p_type AS service_name, TIMESTAMP '1995-07-01' + to_years(CAST(p_size % 4 AS INT)) AS effective_from,
       CAST(max(p_retailprice) AS DECIMAL(18,2)) AS unit_price, count(*) AS version_rows
FROM part GROUP BY 1, 2
""")

view("v_estimates", (), """
SELECT o_custkey AS pr_id,
       CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS version,
       'repo-' || (o_custkey % 9) AS repository, CASE WHEN o_custkey % 2 = 0 THEN 'prod' ELSE 'dev' END AS environment,
       CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * CAST('0.01' AS DECIMAL(3,2)), 2) AS DECIMAL(18,2)) AS cost_before,
       CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * (o_orderkey % 7 + 5) * CAST('0.00125' AS DECIMAL(6,5)), 2) AS DECIMAL(18,2)) AS cost_after
FROM orders
""")

view("v_utilisation", (), """
SELECT l_suppkey AS resource_id, 'svc-' || (l_partkey % 4) AS service, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS day,
       CAST(sum(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE 0 END) AS BIGINT) AS cpu,
       CAST(sum(CASE WHEN l_linenumber % 2 = 0 THEN l_partkey % 7 ELSE 0 END) AS BIGINT) AS mem,
       CAST(sum(CASE WHEN l_linenumber % 2 = 0 THEN l_partkey % 5 ELSE 0 END) AS BIGINT) AS disk, CAST(0 AS BIGINT) AS net
FROM lineitem GROUP BY 1, 2, 3
""")

view("v_assets", ("v_cost_lines",), """
SELECT resource_id, window_start, currency, amount, 0 AS arrival FROM (
  SELECT CASE WHEN resource_id % 4 = 0 THEN resource_id + 1000000 ELSE resource_id END AS resource_id,
         CAST(date_trunc('day', usage_start_time) AS TIMESTAMP) AS window_start, currency, sum(amount) AS amount
  FROM v_cost_lines WHERE kind = 'modern' GROUP BY 1, 2, 3)
""")

view("v_credits", ("v_samples",), """
SELECT 'credit-' || event_id AS id, account_uuid, CAST(date_trunc('minute', collected_at) AS TIMESTAMP) AS entry_at, 1 AS entry_rank,
       'credit' AS entry_type, 100.0::DOUBLE AS amount_delta, collected_at AS last_collected_at
FROM v_samples WHERE event_id % 40 = 0
""")

# ---- metering chain over v_inbound (same steps as meterwise.plans.metering_job) ----

view("m_flagged", ("v_inbound",), f"""
SELECT *, {canonical(t('uuid'))} AS account_uuid,
       CASE WHEN coalesce({t('uuid')}, '') = '' THEN 'sample uuid is required'
            WHEN {canonical(t('uuid'))} IS NULL THEN 'sample uuid is not a valid UUID' END AS reject_reason
FROM v_inbound
""")

view("m_samples", ("m_flagged",), f"""
WITH entries AS (
  SELECT collected_at, node_id, env, pos, account_uuid,
         max(uplink_bytes_total) AS uplink_bytes_total, max(downlink_bytes_total) AS downlink_bytes_total,
         max({t('email')}) AS email
  FROM m_flagged WHERE reject_reason IS NULL
  GROUP BY collected_at, node_id, env, pos, account_uuid, inbound_tag)
SELECT collected_at, node_id, env, account_uuid,
       CAST(sum(uplink_bytes_total) AS BIGINT) AS uplink_total,
       CAST(sum(downlink_bytes_total) AS BIGINT) AS downlink_total,
       arg_min(email, pos) FILTER (WHERE email <> '') AS email,
       CASE WHEN coalesce({t('env')}, '') = '' THEN {t('node_id')} ELSE {t('env')} || ':' || {t('node_id')} END AS storage_node_id
FROM entries
GROUP BY collected_at, node_id, env, account_uuid
""")


def delta_sql(source: str) -> str:
    """Deltas over a samples relation with storage_node_id/account_uuid/collected_at/totals."""
    w = "PARTITION BY storage_node_id, account_uuid ORDER BY collected_at, uplink_total, downlink_total"
    return f"""
SELECT *, CAST(sum(CASE WHEN is_reset THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS reset_epoch,
       NOT is_reset AND NOT is_duplicate AS billable
FROM (
  SELECT *, NOT is_duplicate AND (delta_up < 0 OR delta_down < 0) AS is_reset
  FROM (
    SELECT *, uplink_total - coalesce(prev_up, 0) AS delta_up, downlink_total - coalesce(prev_down, 0) AS delta_down,
           prev_up IS NULL AS is_first, coalesce(prev_at = collected_at AND prev_up = uplink_total AND prev_down = downlink_total, false) AS is_duplicate
    FROM (
      SELECT *, lag(uplink_total) OVER w AS prev_up, lag(downlink_total) OVER w AS prev_down,
             lag(collected_at) OVER w AS prev_at
      FROM {source} WINDOW w AS ({w}))))
WINDOW w AS ({w})
"""


def buckets_sql(deltas: str, grain: str = "minute", policy: str = "sum") -> str:
    if policy == "last":
        up, down = "arg_max(delta_up, collected_at)", "arg_max(delta_down, collected_at)"
    else:
        up, down = "sum(delta_up)", "sum(delta_down)"
    return f"""
SELECT CAST(date_trunc('{grain}', collected_at) AS TIMESTAMP) AS bucket_start, storage_node_id AS node_id, account_uuid,
       '' AS region, '' AS line_code,
       CAST({up} AS BIGINT) AS uplink_bytes, CAST({down} AS BIGINT) AS downlink_bytes,
       CAST({up} + {down} AS BIGINT) AS total_bytes,
       min(collected_at) AS first_collected_at, max(collected_at) AS last_collected_at, count(*) AS snapshots,
       'rated' AS rating_status
FROM {deltas} WHERE billable
GROUP BY 1, 2, 3, 4, 5
"""


view("m_deltas", ("m_samples",), delta_sql("m_samples"))
view("m_buckets", ("m_deltas",), buckets_sql("m_deltas"))

view("m_pricing", ("v_profiles",), f"""
SELECT account_uuid,
       CAST(CASE WHEN included_quota_bytes > 0 THEN included_quota_bytes ELSE {DEFAULT_QUOTA} END AS BIGINT) AS included_quota_bytes,
       CASE WHEN base_price_per_byte > 0 THEN base_price_per_byte ELSE {DEFAULT_PRICE} END AS price_per_byte,
       CASE WHEN (CASE WHEN region_multiplier > 0 THEN region_multiplier ELSE 1.0 END)
               * (CASE WHEN line_multiplier > 0 THEN line_multiplier ELSE 1.0 END) > 0
            THEN (CASE WHEN region_multiplier > 0 THEN region_multiplier ELSE 1.0 END)
               * (CASE WHEN line_multiplier > 0 THEN line_multiplier ELSE 1.0 END)
            ELSE 1.0 END AS multiplier,
       CASE WHEN coalesce({t('pricing_rule_version')}, '') <> '' THEN {t('pricing_rule_version')} ELSE {DEFAULT_REVISION} END
         AS pricing_rule_version
FROM v_profiles
""")

RATE_W = "PARTITION BY account_uuid ORDER BY bucket_start, node_id, region, line_code"


def rated_sql(buckets: str, quota: str | None = "v_quota_states") -> str:
    qjoin = f"LEFT JOIN {quota} q USING (account_uuid)" if quota else ""
    qcol = (lambda c: f"q.{c}") if quota else (lambda c: "NULL")
    return f"""
WITH r0 AS (
  SELECT b.*,
         coalesce(p.included_quota_bytes, {DEFAULT_QUOTA}) AS included_quota_bytes,
         coalesce(p.price_per_byte, {DEFAULT_PRICE}) AS price_per_byte,
         coalesce(p.multiplier, 1.0) AS multiplier,
         coalesce(p.pricing_rule_version, {DEFAULT_REVISION}) AS pricing_rule_version,
         CAST(greatest(coalesce({qcol('remaining_included_quota')}, p.included_quota_bytes, {DEFAULT_QUOTA}), 0) AS BIGINT) AS seed_remaining,
         coalesce(CAST({qcol('current_balance')} AS DOUBLE), {DEFAULT_BALANCE}) AS seed_balance,
         CAST({qcol('arrears_since')} AS TIMESTAMP) AS seed_arrears_since,
         coalesce({qcol('suspend_state')}, 'active') AS suspend_state
  FROM {buckets} b LEFT JOIN m_pricing p USING (account_uuid) {qjoin}),
r1 AS (
  SELECT *, coalesce(sum(total_bytes) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bytes_before,
         row_number() OVER w - 1 AS rows_before
  FROM r0 WINDOW w AS ({RATE_W})),
r2 AS (SELECT *, CAST(greatest(seed_remaining - bytes_before, 0) AS BIGINT) AS remaining_before FROM r1),
r3 AS (SELECT *, least(remaining_before, total_bytes) AS included_applied FROM r2),
r4 AS (SELECT *, total_bytes - included_applied AS rated_bytes FROM r3),
r5 AS (SELECT *, (-CAST(rated_bytes AS DOUBLE)) * price_per_byte * multiplier + 0.0 AS amount_delta FROM r4),
r6 AS (
  SELECT *, seed_balance + coalesce(sum(amount_delta) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS balance_before,
         seed_balance + sum(amount_delta) OVER (w ROWS UNBOUNDED PRECEDING) AS balance_after
  FROM r5 WINDOW w AS ({RATE_W})),
r7 AS (
  SELECT *, CASE WHEN balance_after < 0 AND (rows_before = 0 OR balance_before >= 0)
                 THEN CASE WHEN rows_before = 0 THEN coalesce(seed_arrears_since, last_collected_at) ELSE last_collected_at END
            END AS start_at
  FROM r6),
r8 AS (
  SELECT *, last_value(start_at IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS run_start
  FROM r7 WINDOW w AS ({RATE_W}))
SELECT bucket_start, node_id, account_uuid, region, line_code, uplink_bytes, downlink_bytes, total_bytes, multiplier,
       rating_status, pricing_rule_version AS source_revision, {ledger_id_sql()} AS id,
       bucket_start + INTERVAL 1 MINUTE AS bucket_end, 'traffic_charge' AS entry_type,
       included_applied, rated_bytes, amount_delta, balance_after,
       remaining_before - included_applied AS remaining_after,
       balance_after < 0 AS arrears,
       CASE WHEN balance_after < 0 THEN run_start END AS arrears_since,
       CASE WHEN balance_after < 0 THEN 'throttled' ELSE 'normal' END AS throttle_state,
       suspend_state, pricing_rule_version, price_per_byte, first_collected_at, last_collected_at
FROM r8
"""


view("m_rated", ("m_buckets", "m_pricing", "v_quota_states"), rated_sql("m_buckets"))

# the same chain over v_samples (no inbound split)
view("s_deltas", ("v_samples",), delta_sql("v_samples"))
view("s_buckets", ("s_deltas",), buckets_sql("s_deltas"))
view("s_rated", ("s_buckets", "m_pricing", "v_quota_states"), rated_sql("s_buckets"))

# samples with copies, and with second readings of one instant
view("e_replayed", ("v_samples",), "SELECT * FROM v_samples UNION ALL SELECT * FROM v_samples WHERE event_id % 5 = 0")
view("e_samples", ("e_replayed",), """
SELECT * FROM e_replayed
UNION ALL
SELECT * REPLACE (uplink_total + 60 AS uplink_total, downlink_total + 5 AS downlink_total) FROM e_replayed WHERE event_id % 7 = 0
""")
view("e_deltas", ("e_samples",), delta_sql("e_samples"))

# a run over the inbound snapshots before PREFIX_CUT only (the "earlier run" of replay checks)
PREFIX_CUT = "2024-01-15 00:00:00"
view("p_samples", ("m_samples",), f"SELECT * FROM m_samples WHERE collected_at < TIMESTAMP '{PREFIX_CUT}'")
view("p_deltas", ("p_samples",), delta_sql("p_samples"))
view("p_buckets", ("p_deltas",), buckets_sql("p_deltas"))
view("p_rated", ("p_buckets", "m_pricing", "v_quota_states"), rated_sql("p_buckets"))


def with_views(names: list[str] | tuple[str, ...], body: str) -> str:
    """``WITH`` clause holding the named views and their dependencies, then ``body``."""
    ordered: list[str] = []

    def visit(n: str) -> None:
        if n in ordered:
            return
        for d in VIEWS[n][0]:
            visit(d)
        ordered.append(n)

    for n in names:
        visit(n)
    ctes = ",\n".join(f"{n} AS (\n{VIEWS[n][1].strip()}\n)" for n in ordered)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
