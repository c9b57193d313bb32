"""Deterministic inputs derived from the driver tables (see FIXTURES.md).

The metered service reads snapshots of cumulative counters, billing profiles, quota
rows and vendor cost lines; none of those exist in the driver data, so each is
derived here from an existing table by a fixed expression.  The DuckDB text of the
same views lives in ``meterwise.plans.oracle`` and the two are kept in step.

All derivations are narrow projections, joins and one window of the driver tables,
so they grow with the data and Catalyst prunes the parquet columns they do not use.
"""

from __future__ import annotations

from datetime import timedelta
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterwise.functions.prefix import chunked_running
from meterwise.sources.tables import table

# Fixture constants.
ACCOUNT_PREFIX = "00000000-0000-4000-8000-"
CURRENCIES = ("USD", "EUR", "CNY", "JPY")


def account_uuid(key: Column) -> Column:
    return F.concat(F.lit(ACCOUNT_PREFIX), F.lpad(key.cast("string"), 12, "0"))


def cents_to_money(cents: Column) -> Column:
    """Integer cents -> DECIMAL(18,2), exactly."""
    return (cents.cast("decimal(18,0)") / F.lit(100)).cast("decimal(18,2)")


def samples(spark: SparkSession, sf_dir: str, since=None, until=None) -> DataFrame:
    """``v_samples``: one cumulative-counter sample per (node, account, time).

    Counters restart every week, which gives natural counter resets.  With ``since`` and ``until`` (times) only the
    weeks that they touch are read: literal bounds that reach the scan and cut no counter.
    """
    ev = table(spark, sf_dir, "events")
    if since is not None:
        first, last = (x.replace(hour=0, minute=0, second=0, microsecond=0) - timedelta(days=x.weekday()) for x in (since, until))
        ev = ev.filter((F.col("ts") >= F.lit(first).cast("timestamp_ntz")) & (F.col("ts") < F.lit(last + timedelta(days=7)).cast("timestamp_ntz")))
    e = ev.select(
        "event_id",
        F.col("ts").alias("collected_at"),
        "user_id",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.round(F.col("value") * 100).cast("long").alias("up"),
    )
    x = e.select(
        "*",
        F.concat(F.lit("node-"), (F.col("k") % 3).cast("string")).alias("node_id"),
        F.when(F.col("k") % 3 == 2, "uat").otherwise("prod").alias("env"),
        account_uuid(F.col("user_id")).alias("account_uuid"),
    )
    w = (
        Window.partitionBy("node_id", "user_id", F.date_trunc("week", "collected_at"))
        .orderBy("collected_at", "event_id")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return x.select(
        "event_id",
        "collected_at",
        "node_id",
        "env",
        F.concat("env", F.lit(":"), "node_id").alias("storage_node_id"),
        "account_uuid",
        "user_id",
        F.sum("up").over(w).cast("long").alias("uplink_total"),
        F.sum(F.col("k") * 10).over(w).cast("long").alias("downlink_total"),
    )


def inbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v_inbound``: each sample split over two inbounds, as an exporter reports it.

    The second inbound carries the UUID in upper case with a padded e-mail, and for
    ``event_id % 97 == 0`` an invalid UUID.
    """
    s = samples(spark, sf_dir)
    third = F.expr("uplink_total div 3")
    first = F.struct(
        F.lit(0).alias("pos"),
        F.col("account_uuid").alias("uuid"),
        F.lit("").alias("email"),
        F.lit("xhttp").alias("inbound_tag"),
        (F.col("uplink_total") - third).alias("uplink_bytes_total"),
        F.col("downlink_total").alias("downlink_bytes_total"),
    )
    second = F.struct(
        F.lit(1).alias("pos"),
        F.when(F.col("event_id") % 97 == 0, F.lit("not-a-uuid")).otherwise(F.upper("account_uuid")).alias("uuid"),
        F.concat(F.lit(" u"), F.col("user_id").cast("string"), F.lit("@example.com ")).alias("email"),
        F.lit("tcp").alias("inbound_tag"),
        third.alias("uplink_bytes_total"),
        F.lit(0).cast("long").alias("downlink_bytes_total"),
    )
    # both entries from one read and one running total of the samples
    return s.select("event_id", "collected_at", "node_id", "env", F.inline(F.array(first, second)))


def replayed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v_samples`` with every fifth snapshot delivered twice."""
    s = samples(spark, sf_dir)
    return s.unionByName(s.filter(F.col("event_id") % 5 == 0))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v_profiles``: per-account pricing overrides (not every account has one)."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return c.filter(F.col("c_mktsegment") != "BUILDING").select(
        account_uuid(key).alias("account_uuid"),
        F.when(key % 4 == 0, F.lit(0)).otherwise((key % 10 + 1) * 60000).cast("long").alias("included_quota_bytes"),
        F.when(F.col("c_acctbal") < 0, F.lit(0.0))
        .otherwise((key % 5 + 1).cast("double") / 1024.0)
        .alias("base_price_per_byte"),
        (F.lit(0.5) * (F.col("c_nationkey") % 5)).cast("double").alias("region_multiplier"),
        (F.lit(1.0) + F.lit(0.25) * (key % 3)).cast("double").alias("line_multiplier"),
        F.when(key % 6 == 0, F.lit("  "))
        .otherwise(F.concat(F.lit("pricing-v"), (key % 3).cast("string")))
        .alias("pricing_rule_version"),
    )


def registry(spark: SparkSession) -> DataFrame:
    """``v_registry``: the configured exporter sources (a bounded config list)."""
    rows = [
        ("s0", "node-0", "prod", True),
        ("s1", "node-1", "prod", True),
        ("s2", "node-2", "prod", True),
        ("s3", "node-9", "", False),
    ]
    return spark.createDataFrame(
        rows, "source_id string, expected_node_id string, expected_env string, enabled boolean"
    )


def quota_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v_quota_states``: stored quota/balance rows for every customer."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    neg = F.col("c_acctbal") < 0
    return c.select(
        account_uuid(key).alias("account_uuid"),
        ((key % 7) * 1000).cast("long").alias("remaining_included_quota"),
        F.floor("c_acctbal").cast("double").alias("current_balance"),
        neg.alias("arrears"),
        F.when(
            neg & (key % 5 != 0),
            F.timestamp_add("DAY", (key % 28).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")),
        ).alias("arrears_since"),
        F.when(neg, "throttled").otherwise("normal").alias("throttle_state"),
        F.when(key % 11 == 0, "suspended").otherwise("active").alias("suspend_state"),
    )


def cost_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v_cost_lines``: daily vendor cost line items of three providers."""
    li = table(spark, sf_dir, "lineitem")
    pa = table(spark, sf_dir, "part")
    su = table(spark, sf_dir, "supplier")
    na = table(spark, sf_dir, "nation")
    re = table(spark, sf_dir, "region")
    j = (
        li.join(pa, li.l_partkey == pa.p_partkey)
        .join(su, li.l_suppkey == su.s_suppkey)
        .join(na, su.s_nationkey == na.n_nationkey)
        .join(re, na.n_regionkey == re.r_regionkey)
    )
    sk = F.col("l_suppkey")
    return j.select(
        F.when(sk % 3 == 0, "aws").when(sk % 3 == 1, "gcp").otherwise("azure").alias("provider"),
        F.concat(F.lit("acct-"), (sk % 7).cast("string")).alias("account_id"),
        F.col("p_type").alias("service_name"),
        F.when((sk % 3 == 1) & (F.col("r_name") == "AFRICA"), F.lit(""))
        .when((sk % 3 == 2) & (F.col("r_name") == "AMERICA"), F.lit(None).cast("string"))
        .otherwise(F.col("r_name"))
        .alias("region"),
        F.col("l_shipdate").alias("usage_start_time"),
        cents_to_money(F.round(F.col("l_extendedprice") * F.col("l_discount") * 100).cast("long")).alias("amount"),
        F.element_at(F.array(*[F.lit(c) for c in CURRENCIES]), (sk % 4 + 1).cast("int")).alias("currency"),
        F.when(F.col("l_linenumber") % 2 == 0, "modern").otherwise("legacy").alias("kind"),
        sk.alias("resource_id"),
        F.col("l_quantity").alias("usage_quantity"),
        F.concat(F.lit("team-"), (sk % 5).cast("string")).alias("team"),
        F.col("p_brand").alias("product"),
        F.when(sk % 10 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("cc-"), (sk % 4).cast("string")))
        .alias("cost_center"),
    )


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v_payments``: billing events per account."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("event_id"),
        F.col("o_custkey").alias("account_id"),
        F.col("o_orderdate").alias("occurred_at"),
        F.when(F.col("o_orderstatus") == "P", "invoice_paid")
        .when(F.col("o_orderstatus") == "F", "payment_failed")
        .otherwise("subscription_updated")
        .alias("event_type"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
    )


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v_rates``: monthly rate to USD per currency; JPY of 1996-03 is deliberately 0."""
    li = table(spark, sf_dir, "lineitem")
    months = li.select(F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("month")).distinct()
    # Rate to USD per currency.
    rate = (
        F.when((F.col("currency") == "JPY") & (F.col("month") == F.lit("1996-03-01").cast("timestamp_ntz")), F.lit("0"))
        .when(F.col("currency") == "USD", F.lit("1"))
        .when(F.col("currency") == "EUR", F.lit("1.125"))
        .when(F.col("currency") == "CNY", F.lit("0.140625"))
        .otherwise(F.lit("0.0078125"))
    )
    per_currency = months.select("month", F.explode(F.array(*[F.lit(c) for c in CURRENCIES])).alias("currency"))
    return per_currency.select("currency", "month", rate.cast("decimal(18,8)").alias("rate_to_usd"))


def price_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v_price_book``: versions of a unit price per service, by effective date."""
    p = table(spark, sf_dir, "part")
    eff = F.timestamp_add("YEAR", (F.col("p_size") % 4).cast("int"), F.lit("1995-07-01 00:00:00").cast("timestamp_ntz"))
    return (
        p.groupBy(F.col("p_type").alias("service_name"), eff.alias("effective_from"))
        .agg(F.max("p_retailprice").cast("decimal(18,2)").alias("unit_price"), F.count("*").alias("version_rows"))
    )


def estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v_estimates``: cost estimates, several versions per change request, numbered month by month in two levels, so
    that a request with very many versions is no single task."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    o = chunked_running(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], F.date_trunc("month", "o_orderdate"), {"version": (F.lit(1), "sum", True)})
    price = F.col("o_totalprice").cast("decimal(18,2)")
    return o.select(
        F.col("o_custkey").alias("pr_id"),
        F.col("version").cast("long").alias("version"),
        F.concat(F.lit("repo-"), (F.col("o_custkey") % 9).cast("string")).alias("repository"),
        F.when(F.col("o_custkey") % 2 == 0, "prod").otherwise("dev").alias("environment"),
        F.round(price * F.lit(Decimal("0.01")), 2).cast("decimal(18,2)").alias("cost_before"),
        F.round(price * (F.col("o_orderkey") % 7 + 5) * F.lit(Decimal("0.00125")), 2).cast("decimal(18,2)").alias("cost_after"),
    )


def utilisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v_utilisation``: use of each host (supplier) by service and day.

    Lines of an even number are used; the others only cost.  ``net`` is never measured.
    """
    li = table(spark, sf_dir, "lineitem")
    used = F.col("l_linenumber") % 2 == 0
    return li.groupBy(
        F.col("l_suppkey").alias("resource_id"),
        F.concat(F.lit("svc-"), (F.col("l_partkey") % 4).cast("string")).alias("service"),
        F.date_trunc("day", "l_shipdate").cast("timestamp_ntz").alias("day"),
    ).agg(
        F.sum(F.when(used, F.col("l_quantity")).otherwise(0)).cast("long").alias("cpu"),
        F.sum(F.when(used, F.col("l_partkey") % 7).otherwise(0)).cast("long").alias("mem"),
        F.sum(F.when(used, F.col("l_partkey") % 5).otherwise(0)).cast("long").alias("disk"),
        F.lit(0).cast("long").alias("net"),
    )


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v_assets``: an inventory's daily cost per resource.  Every fourth resource is unknown to the cloud bill
    (its id is shifted), and every fifth one's windows are delivered twice, the second time with another amount."""
    l = cost_lines(spark, sf_dir).filter(F.col("kind") == "modern")
    rid = F.col("resource_id")
    once = l.groupBy(
        F.when(rid % 4 == 0, rid + 1_000_000).otherwise(rid).alias("resource_id"),
        F.date_trunc("day", "usage_start_time").cast("timestamp_ntz").alias("window_start"),
        "currency",
    ).agg(F.sum("amount").cast("decimal(38,2)").alias("amount"))
    again = once.filter(F.col("resource_id") % 5 == 0).withColumn("amount", (F.col("amount") + 1).cast("decimal(38,2)"))
    return once.withColumn("arrival", F.lit(0)).unionByName(again.withColumn("arrival", F.lit(1)))


def credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v_credits``: a credit of 100 to an account with every fortieth event."""
    s = samples(spark, sf_dir).filter(F.col("event_id") % 40 == 0)
    return s.select(
        F.concat(F.lit("credit-"), F.col("event_id").cast("string")).alias("id"), "account_uuid",
        F.date_trunc("minute", "collected_at").cast("timestamp_ntz").alias("entry_at"), F.lit(1).alias("entry_rank"),
        F.lit("credit").alias("entry_type"), F.lit(100.0).alias("amount_delta"), F.col("collected_at").alias("last_collected_at"),
    )
