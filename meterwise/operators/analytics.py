"""Read-side and cost-analytics operators (Tier B): summaries, cost views, currency,
as-of prices, reconciliation, anomalies, budgets.

All are aggregates, equi-joins and windows over *pre-aggregated* rows (per day,
month or account), so a hot key costs at most one row per period per key in any
window.  Money stays DECIMAL; ratios are computed as DOUBLE / DOUBLE.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterwise.functions.time import day_start, month_start

MONEY = "decimal(38,2)"


def ratio(num: Column, den: Column) -> Column:
    """num / den as DOUBLE, null when the denominator is 0 or null."""
    return F.when(den != 0, num.cast("double") / den.cast("double"))


# ------------------------------------------------------------------ usage side
def usage_summary(buckets: DataFrame, final_states: DataFrame, pricing: DataFrame) -> DataFrame:
    """B-1: per account totals over all buckets, quota used and its percentage."""
    tot = buckets.groupBy("account_uuid").agg(
        F.sum("total_bytes").cast("long").alias("total_bytes"),
        F.sum("uplink_bytes").cast("long").alias("uplink_bytes"),
        F.sum("downlink_bytes").cast("long").alias("downlink_bytes"),
        F.max("bucket_start").alias("last_bucket_at"),
    )
    j = tot.join(final_states.select("account_uuid", "remaining_included_quota"), "account_uuid", "left").join(
        pricing.select("account_uuid", "included_quota_bytes"), "account_uuid", "left"
    )
    used = F.greatest(F.col("included_quota_bytes") - F.col("remaining_included_quota"), F.lit(0)).cast("long")
    return j.select(
        "account_uuid", "total_bytes", "uplink_bytes", "downlink_bytes", "included_quota_bytes",
        F.col("remaining_included_quota").alias("remaining_quota"),
        used.alias("used_quota"),
        (ratio(used, F.col("included_quota_bytes")) * 100).alias("used_pct"),
        "last_bucket_at",
    )


def latest_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank_col: str = "rn") -> DataFrame:
    """B-2 paging: the first ``n`` rows per group.  ``row_number() <= n`` lets Spark put
    a partial per-partition limit before the shuffle, so a hot group ships n rows per
    map task, not all of its rows."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= n)


def usage_window(buckets: DataFrame, start: str, end: str) -> DataFrame:
    """B-5: usage per account in ``[start, end)``."""
    s, e = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    return (
        buckets.filter((F.col("bucket_start") >= s) & (F.col("bucket_start") < e))
        .groupBy("account_uuid")
        .agg(F.count("*").alias("buckets"), F.sum("total_bytes").cast("long").alias("total_bytes"))
    )


# ------------------------------------------------------------------ cost views
def cost_by_period(costs: DataFrame, grain: str, dims: Sequence[str]) -> DataFrame:
    """B-24: cost per ``grain`` (day / month) and dimensions."""
    period = day_start(F.col("usage_start_time")) if grain == "day" else month_start(F.col("usage_start_time"))
    return costs.groupBy(period.alias("period"), *dims).agg(
        F.sum("cost_amount").cast(MONEY).alias("cost"), F.count("*").alias("rows")
    )


def cost_rollup(costs: DataFrame, dims: Sequence[str]) -> DataFrame:
    """B-24: subtotals along ``dims`` (ROLLUP) in each currency, with the grouping level of ``dims``.  The rollup's one
    level above the currencies would add them up, so it is left out."""
    rolled = costs.rollup("currency", *dims).agg(
        F.sum("cost_amount").cast(MONEY).alias("cost"),
        F.count("*").alias("rows"),
        F.grouping_id().cast("int").alias("level"),
    )
    return rolled.filter(F.col("level") < 1 << len(dims))


def convert_currency(costs: DataFrame, rates: DataFrame, target: str = "USD") -> DataFrame:
    """B-15: amount in ``target`` with the month's rate.  A missing or non-positive rate
    gives a null amount and ``rate_ok = false`` -- never a silent 1.0."""
    r = rates.select("currency", "month", "rate_to_usd")
    j = costs.withColumn("month", month_start(F.col("usage_start_time"))).join(r, ["currency", "month"], "left")
    ok = F.coalesce(F.col("rate_to_usd") > 0, F.lit(False))
    amount = (F.col("cost_amount").cast("decimal(24,10)") * F.col("rate_to_usd").cast("decimal(12,8)")).cast("decimal(38,10)")
    return j.select(
        *costs.columns,
        "rate_to_usd",
        F.when(ok, amount).alias(f"amount_{target.lower()}"),
        ok.alias("rate_ok"),
    )


def price_asof(usage: DataFrame, book: DataFrame, key: str, time_col: str) -> DataFrame:
    """B-21: latest ``effective_from <= time`` price per usage row (null + flag when none).

    Each price version holds until the next one of its key, so a usage row meets at most
    one, and equal usage rows stay apart.  Of versions with one date the dearest holds.
    """
    w = Window.partitionBy(key).orderBy("effective_from", "unit_price")
    b = book.select(
        F.col(key).alias("__k"), F.col("effective_from").alias("__from"), F.col("unit_price").alias("__price"),
        F.lead("effective_from").over(w).alias("__until"),
    )
    at = F.col(time_col)
    holds = (F.col("__from") <= at) & (F.col("__until").isNull() | (at < F.col("__until")))
    return usage.join(b, (F.col(key) == F.col("__k")) & holds, "left").select(
        *usage.columns,
        F.col("__from").alias("price_effective_from"),
        F.col("__price").alias("unit_price"),
        F.col("__price").isNotNull().alias("priced"),
    )


def reconcile(left: DataFrame, right: DataFrame, key: str, tolerance: float) -> DataFrame:
    """B-13: full outer comparison of two amount columns (``amount`` on both sides)."""
    j = left.select(key, F.col("amount").alias("external_amount")).join(
        right.select(key, F.col("amount").alias("internal_amount")), key, "full"
    )
    diff = (F.col("external_amount") - F.col("internal_amount")).cast(MONEY)
    status = (
        F.when(F.col("internal_amount").isNull(), F.lit("missing_internal"))
        .when(F.col("external_amount").isNull(), F.lit("missing_external"))
        .when(F.abs(diff) > F.lit(tolerance), F.lit("mismatch"))
        .otherwise(F.lit("ok"))
    )
    return j.select(key, "external_amount", "internal_amount", diff.alias("diff"), status.alias("status"))


# ------------------------------------------------------------------ anomalies, budgets
def daily_spine(daily: DataFrame, key: Sequence[str], day_col: str = "day", value: str = "cost") -> DataFrame:
    """Every day from a key's first to its last day, with 0 where the key had no rows.

    Built per key (``sequence`` + ``explode`` of its own bounds), so there is no join of
    keys with days; the spine grows with the time span, not with the data volume.
    """
    bounds = daily.groupBy(*key).agg(F.min(day_col).alias("lo"), F.max(day_col).alias("hi"))
    spine = bounds.select(*key, F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias(day_col))
    zero = F.lit(0).cast(daily.schema[value].dataType)
    return spine.join(daily, [*key, day_col], "left").select(
        *key, F.col(day_col).cast("timestamp_ntz").alias(day_col), F.coalesce(F.col(value), zero).alias(value)
    )


def change_anomalies(series: DataFrame, key: Sequence[str], order: str, value: str, lag_n: int, min_ratio: float, min_delta: float) -> DataFrame:
    """B-28: rows whose value grew by more than ``min_ratio`` x and ``min_delta`` over the
    value ``lag_n`` rows earlier (DoD: 1 day, WoW: 7 days, MoM: 1 month)."""
    w = Window.partitionBy(*key).orderBy(order)
    x = series.withColumn("previous", F.lag(value, lag_n).over(w))
    grew = (F.col(value) > F.col("previous") * F.lit(min_ratio)) & ((F.col(value) - F.col("previous")) >= F.lit(min_delta))
    return x.filter(F.col("previous").isNotNull() & grew).select(
        *key, order, value, "previous", (F.col(value) - F.col("previous")).alias("change")
    )


def budget_crossings(daily: DataFrame, budgets: DataFrame, dims: Sequence[str], thresholds: Sequence[float]) -> DataFrame:
    """B-29: first day in each month the running cost reaches each threshold share of
    the budget.  Running sums are per (dims, month): at most 31 rows a group."""
    d = daily.withColumn("month", month_start(F.col("day")))
    w = Window.partitionBy(*dims, "month").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("mtd", F.sum("cost").over(w)).join(budgets, [*dims, "month"], "inner")
    th = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    x = d.select(*dims, "month", "day", "mtd", "budget", th)
    hit = x.filter(F.col("mtd") >= F.col("budget") * F.col("threshold"))
    return hit.groupBy(*dims, "month", "threshold").agg(F.min("day").alias("crossed_on"))


def streaks(series: DataFrame, key: Sequence[str], factor: float, min_days: int) -> DataFrame:
    """B-28: runs of at least ``min_days`` consecutive days over ``factor`` times the key's mean day.

    ``series``: ``key + day, cost`` without missing days, so a key holds one row a day.
    """
    per_key = Window.partitionBy(*key)
    mean = F.sum(F.col("cost").cast("double")).over(per_key) / F.count("*").over(per_key)
    high = series.withColumn("__mean", mean).filter(F.col("cost").cast("double") > F.col("__mean") * F.lit(factor))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("day"))
    runs = high.withColumn("__run", F.date_sub(F.to_date("day"), nth)).groupBy(*key, "__run").agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("days"),
        F.sum("cost").cast(MONEY).alias("cost"),
    )
    return runs.filter(F.col("days") >= min_days).drop("__run")


# ------------------------------------------------------------------ price book by scope, cost by grain
GLOBAL = "global"


def price_asof_scoped(usage: DataFrame, book: DataFrame, time_col: str = "day") -> DataFrame:
    """B-21 by region and currency: the price version of the usage's own region in force at its time, else that of
    ``global``; prices of another currency never apply.

    ``usage``: ``service_name, region, currency``, the time and a quantity, one row per key; ``book``: ``service_name, region,
    currency, effective_from, unit_price``.  A version holds until the next of its scope (of two with one date, the dearest).
    A usage row asks for at most two scopes, each an equi-join with a date range.
    """
    scope = ["service_name", "region", "currency"]
    w = Window.partitionBy(*scope).orderBy("effective_from", "unit_price")
    b = book.select(F.col("service_name"), F.col("region").alias("__scope"), "currency", "unit_price", F.col("effective_from").alias("__from"),
                    F.lead("effective_from").over(w).alias("__until"))
    asked = usage.withColumn("__scope", F.explode(F.array_distinct(F.array(F.coalesce("region", F.lit(GLOBAL)), F.lit(GLOBAL)))))
    at = F.col(time_col)
    found = asked.join(b, ["service_name", "currency", "__scope"]).filter((F.col("__from") <= at) & (F.col("__until").isNull() | (at < F.col("__until"))))
    key = [*scope, time_col]
    best = found.groupBy(*key).agg(F.min_by(
        F.struct(F.col("__scope").alias("s"), F.col("__from").alias("f"), F.col("unit_price").alias("p")), F.when(F.col("__scope") == GLOBAL, 1).otherwise(0)).alias("__b"))
    named = best.withColumnsRenamed({k: f"__r_{k}" for k in key})
    same = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in key]
    return usage.join(named, same[0] & same[1] & same[2] & same[3], "left").select(*usage.columns, F.col("__b.s").alias("price_scope"), F.col("__b.f").alias("price_effective_from"),
                    F.col("__b.p").alias("unit_price"), F.col("__b.p").isNotNull().alias("priced"))


def cost_grains(lines: DataFrame, dims: Sequence[str], time_col: str = "usage_start_time", amount_col: str = "amount") -> DataFrame:
    """B-24: ``grain, period, dims, cost, lines, adds_up`` for hours, days, months and the whole, from one read.

    Lines are summed by hour first (combined map-side); the coarser grains are grouping sets over those sums.  ``adds_up``:
    the grain's periods sum to the whole of their dimensions.
    """
    at = F.col(time_col)
    hours = lines.groupBy(*dims, F.date_trunc("hour", at).cast("timestamp_ntz").alias("hour")).agg(
        F.sum(F.col(amount_col).cast("decimal(38,12)")).alias("cost"), F.count(F.lit(1)).alias("lines"))
    starts = {g: F.date_trunc(g, "hour").cast("timestamp_ntz") for g in ("day", "month")}
    hours = hours.withColumns(starts)
    d = [F.col(c) for c in dims]
    sets = hours.groupingSets([[*d, F.col(g)] for g in ("hour", "day", "month")] + [d], *d, "hour", "day", "month").agg(
        F.sum("cost").alias("cost"), F.sum("lines").cast("long").alias("lines"),
        F.grouping("hour").alias("no_hour"), F.grouping("day").alias("no_day"), F.grouping("month").alias("no_month"))
    grain = F.when(F.col("no_hour") == 0, "hour").when(F.col("no_day") == 0, "day").when(F.col("no_month") == 0, "month").otherwise("all")
    period = F.coalesce("hour", "day", "month")
    x = sets.select(grain.alias("grain"), period.alias("period"), *dims, "cost", "lines")
    # one row per hour of history and dimension at most, whatever the number of lines
    mine, all_ = Window.partitionBy("grain", *dims), Window.partitionBy(*dims)
    whole = {c: F.max(F.when(F.col("grain") == "all", F.col(c))).over(all_) for c in ("cost", "lines")}
    good = (F.sum("cost").over(mine) == whole["cost"]) & (F.sum("lines").over(mine) == whole["lines"])
    return x.withColumn("adds_up", good).select("grain", "period", *dims, F.col("cost").cast(MONEY).alias("cost"), "lines", "adds_up")


def cost_overview(daily: DataFrame, budgets: DataFrame) -> DataFrame:
    """B-27: one row per currency and month with cost -- cost to the last day seen, linear forecast, budget use, change
    against the month before through the same day of the month, and the dearest service.

    ``daily``: ``currency, service_name, day, cost``.  Everything is made of rows by day and service; the month
    before is an equi-join on (currency, month) of rows by day.
    """
    d = daily.withColumn("month", month_start(F.col("day")))
    by_service = d.groupBy("currency", "month", "service_name").agg(F.sum("cost").alias("cost"), F.max("day").alias("as_of"))
    m = by_service.groupBy("currency", "month").agg(
        F.max("as_of").alias("as_of"), F.sum("cost").cast(MONEY).alias("cost"), F.count("*").alias("services"),
        F.min_by(F.struct("service_name", "cost"), F.struct(-F.col("cost"), "service_name")).alias("top"))
    by_day = d.groupBy("currency", "month", "day").agg(F.sum("cost").alias("p"))
    earlier = by_day.select(F.col("currency").alias("c"), F.add_months("month", 1).cast("timestamp_ntz").alias("m"), F.dayofmonth("day").alias("dom"), "p")
    same = (F.col("currency") == F.col("c")) & (F.col("month") == F.col("m")) & (F.col("dom") <= F.dayofmonth("as_of"))
    before = m.select("currency", "month", "as_of").join(earlier, same).groupBy("currency", "month").agg(F.sum("p").cast(MONEY).alias("previous_cost"))
    x = m.join(before, ["currency", "month"], "left").join(budgets.select("currency", "budget"), "currency", "left")
    forecast = F.col("cost").cast("double") / F.dayofmonth("as_of") * F.dayofmonth(F.last_day("as_of"))
    change = (F.col("cost") - F.col("previous_cost")).cast(MONEY)
    return x.select(
        "currency", "month", "as_of", "cost", forecast.alias("forecast"), "budget",
        ratio(F.col("cost"), F.col("budget")).alias("budget_used"), ratio(forecast, F.col("budget")).alias("budget_forecast"),
        "previous_cost", change.alias("change"), ratio(change, F.col("previous_cost")).alias("change_ratio"),
        F.col("top.service_name").alias("top_service"), F.col("top.cost").cast(MONEY).alias("top_cost"), "services",
    )
