"""Gross margin by account and plan (B-11), and what a plan's quota costs (B-12).

A node's monthly cost is split over the accounts by their share of its traffic; the shares of a node sum to its cost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.operators.allocation import split_by_share
from meterwise.operators.analytics import ratio


def node_traffic(buckets: DataFrame) -> DataFrame:
    """``month, node_id, account_uuid, weight`` (bytes)."""
    return buckets.groupBy(F.date_trunc("month", "bucket_start").cast("timestamp_ntz").alias("month"), "node_id", "account_uuid").agg(
        F.sum("total_bytes").cast("long").alias("weight"))


def account_margin(traffic: DataFrame, node_costs: DataFrame, revenue: DataFrame, plans: DataFrame) -> DataFrame:
    """``month, account_uuid, plan, bytes, revenue_cents, cost_cents, margin_cents``.

    ``node_costs``: ``month, node_id, pool_cents``; ``revenue``: ``month, account_uuid, revenue_cents``; ``plans``: ``account_uuid,
    plan``.  Cost without traffic belongs to the account ``Unallocated``.
    """
    shares = split_by_share(node_costs, traffic, ["month", "node_id"], "account_uuid")
    cost = shares.groupBy("month", "account_uuid").agg(F.sum("weight").cast("long").alias("bytes"), F.sum("allocated_cents").cast("long").alias("cost_cents"))
    j = cost.join(revenue, ["month", "account_uuid"], "full").join(plans, "account_uuid", "left")
    n = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("bytes", "revenue_cents", "cost_cents")}
    plan = F.when(F.col("account_uuid") == "Unallocated", F.lit("Unallocated")).otherwise(F.coalesce("plan", F.lit("none")))
    return j.select("month", "account_uuid", plan.alias("plan"), *[v.alias(k) for k, v in n.items()], (n["revenue_cents"] - n["cost_cents"]).alias("margin_cents"))


def plan_margin(accounts: DataFrame) -> DataFrame:
    """``account_margin`` by month and plan, with the number of accounts that cost more than they bring."""
    sums = [F.sum(c).cast("long").alias(c) for c in ("bytes", "revenue_cents", "cost_cents", "margin_cents")]
    return accounts.groupBy("month", "plan").agg(F.count(F.lit(1)).alias("accounts"), F.count(F.when(F.col("margin_cents") < 0, 1)).alias("losing_accounts"), *sums)


def plan_health(by_plan: DataFrame, plans: DataFrame) -> DataFrame:
    """B-12: unit cost of a plan's traffic, and whether its price covers its included quota at that cost.
    ``plans``: ``plan, included_quota_bytes, price_cents``."""
    unit = ratio(F.col("cost_cents"), F.col("bytes"))
    j = by_plan.join(plans, "plan").withColumn("unit_cost_cents", unit)
    j = j.withColumn("quota_cost_cents", F.col("included_quota_bytes").cast("double") * F.col("unit_cost_cents"))
    return j.select("month", "plan", "cost_cents", "bytes", "unit_cost_cents", "included_quota_bytes", "price_cents", "quota_cost_cents",
                    (F.col("price_cents").cast("double") >= F.col("quota_cost_cents")).alias("healthy"))
