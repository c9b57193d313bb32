"""Payment events to account state: dunning counts and entitlement sync (B-8, B-10).

Events are reduced to one row per account and instant, then per account and day, before
anything is ordered by account, so a busy account costs at most one row a day there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterwise.functions.time import day_start

PAID, FAILED = "invoice_paid", "payment_failed"


def failures_since_paid(events: DataFrame) -> DataFrame:
    """Per account: the last paid invoice and the failed payments after it.

    A failure at the instant of a payment does not count.  Returns ``account_id, last_paid_at, failures,
    first_failure_at``; an account without any event has no row.
    """
    kind, at = F.col("event_type"), F.col("occurred_at")
    instants = events.groupBy("account_id", "occurred_at").agg(
        F.count(F.when(kind == FAILED, 1)).alias("failed"), F.max(F.when(kind == PAID, at)).alias("paid_at")
    )
    day = Window.partitionBy("account_id", "day")
    x = instants.withColumn("day", day_start(at)).withColumn("day_paid", F.max("paid_at").over(day))
    late = (F.col("failed") > 0) & (F.col("day_paid").isNull() | (at > F.col("day_paid")))
    days = x.groupBy("account_id", "day").agg(
        F.max("paid_at").alias("paid_at"),
        F.sum(F.when(late, F.col("failed")).otherwise(0)).alias("failed"),
        F.min(F.when(late, at)).alias("first_failed_at"),
    )
    account = Window.partitionBy("account_id")
    y = days.withColumn("last_paid_at", F.max("paid_at").over(account))
    after = F.col("last_paid_at").isNull() | (F.col("day") >= day_start(F.col("last_paid_at")))
    return y.groupBy("account_id").agg(
        F.first("last_paid_at").alias("last_paid_at"),
        F.sum(F.when(after, F.col("failed")).otherwise(0)).cast("long").alias("failures"),
        F.min(F.when(after, F.col("first_failed_at"))).alias("first_failure_at"),
    )


def sync_entitlements(
    events: DataFrame,
    plans: DataFrame,
    states: DataFrame,
    account_uuid: Column,
    free_plan: str = "free",
    throttle_after: int = 3,
    suspend_after: int = 5,
) -> DataFrame:
    """B-10: every account's plan and quota row after its billing events.

    * the latest ``subscription_updated`` names the plan, a later ``subscription_deleted`` puts the account on
      ``free_plan``; without either the account keeps what it had (null plan);
    * a paid invoice that is later than the row's ``entitled_at`` refills the included quota to the plan's and clears
      arrears, throttling and suspension, and becomes its ``entitled_at``: a second run over the same events, or over
      more without a payment, leaves what has been used since as it is;
    * failed payments after it set arrears; from ``throttle_after`` on the account is throttled, from
      ``suspend_after`` on suspended (a state is raised, never lowered).

    ``events``: ``event_id, account_id, occurred_at, event_type, plan_id``; replays of an event change nothing.
    ``plans``: ``plan_id, plan_quota_bytes, plan_price_per_byte`` (a price list).  ``states``: stored quota rows,
    one per ``account_uuid``; without an ``entitled_at`` no payment has been applied yet.
    """
    kind = F.col("event_type")
    plan = F.when(kind == "subscription_updated", F.col("plan_id")).when(kind == "subscription_deleted", F.lit(free_plan))
    subscribed = events.groupBy("account_id").agg(
        F.max(F.when(plan.isNotNull(), F.struct("occurred_at", "event_id", plan.alias("plan_id")))).alias("s")
    )
    subscribed = subscribed.select("account_id", F.col("s.plan_id").alias("plan_id"))
    dunning = failures_since_paid(events.dropDuplicates(["event_id"]))
    accounts = subscribed.join(dunning, "account_id").join(plans, "plan_id", "left").withColumn("account_uuid", account_uuid)
    if "entitled_at" not in states.columns:
        states = states.withColumn("entitled_at", F.lit(None).cast("timestamp_ntz"))
    j = states.join(accounts, "account_uuid", "left")

    paid = F.coalesce(F.col("last_paid_at") > F.coalesce("entitled_at", F.lit("0001-01-01").cast("timestamp_ntz")), F.lit(False))
    n = F.coalesce(F.col("failures"), F.lit(0))

    def after(stored: str, cleared) -> Column:
        return F.when(paid, F.lit(cleared)).otherwise(F.col(stored))

    return j.select(
        "account_uuid",
        "plan_id",
        F.col("plan_quota_bytes").alias("included_quota_bytes"),
        F.col("plan_price_per_byte").alias("base_price_per_byte"),
        F.when(paid & F.col("plan_quota_bytes").isNotNull(), F.col("plan_quota_bytes"))
        .otherwise(F.col("remaining_included_quota")).alias("remaining_included_quota"),
        F.when(n > 0, F.lit(True)).otherwise(after("arrears", False)).alias("arrears"),
        F.when(n > 0, F.when(paid, F.col("first_failure_at")).otherwise(F.coalesce("arrears_since", "first_failure_at")))
        .otherwise(F.when(~paid, F.col("arrears_since"))).alias("arrears_since"),
        F.when(n >= throttle_after, F.lit("throttled")).otherwise(after("throttle_state", "normal")).alias("throttle_state"),
        F.when(n >= suspend_after, F.lit("suspended")).otherwise(after("suspend_state", "active")).alias("suspend_state"),
        F.greatest("entitled_at", "last_paid_at").alias("entitled_at"),
    )
