"""Usage inside per-account time windows, and the subscription period that holds an instant (B-1, B-6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usage_in_windows(buckets: DataFrame, windows: DataFrame, key: str, start: str, end: str, out: str = "window_bytes") -> DataFrame:
    """``windows`` (distinct rows) with the bytes of their account's buckets in ``[start, end)``; 0 without any.

    Days that lie wholly in a window come from totals by account and day, which combine before their shuffle.  Only
    a window's first and last day meet its buckets, in an equi-join on account and day, so a hot account is spread
    over its days and no raw bucket is compared with a range over all of its account's rows.
    """
    w = windows.distinct()
    day = F.date_trunc("day", "bucket_start").cast("timestamp_ntz")
    b = buckets.select(F.col(key).alias("__k"), day.alias("__day"), F.col("bucket_start").alias("__at"), F.col("total_bytes").alias("__bytes"))
    next_day = (F.col("__day") + F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz")
    whole = (F.col("__day") >= F.col(start)) & (next_day <= F.col(end))
    inside = w.join(b.groupBy("__k", "__day").agg(F.sum("__bytes").alias("__bytes")), (F.col(key) == F.col("__k")) & whole)
    ends = F.array_distinct(F.array(*[F.date_trunc("day", c).cast("timestamp_ntz") for c in (start, end)]))
    edges = w.withColumn("__day", F.explode(ends)).filter((F.col(start) < F.col(end)) & (F.col("__day") < F.col(end)) & ~whole)
    cut = edges.join(b.withColumnRenamed("__day", "__d"), (F.col(key) == F.col("__k")) & (F.col("__day") == F.col("__d"))
                     & (F.col("__at") >= F.col(start)) & (F.col("__at") < F.col(end)))
    parts = [x.select(*w.columns, F.col("__bytes").cast("long").alias("__bytes")) for x in (w.withColumn("__bytes", F.lit(0)), inside, cut)]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).groupBy(*w.columns).agg(F.sum("__bytes").cast("long").alias(out))


def month_period(anchor: Column, at: Column) -> tuple[Column, Column]:
    """The monthly period, counted from ``anchor``, that holds ``at``.  Each bound is so many whole months after the
    anchor itself, so a subscription of the 31st comes back to the 31st after a short month."""
    months = (F.year(at) * 12 + F.month(at)) - (F.year(anchor) * 12 + F.month(anchor))

    def after(n: Column) -> Column:
        return F.timestamp_add("MONTH", n.cast("int"), anchor).cast("timestamp_ntz")

    k = months - F.when(after(months) > at, 1).otherwise(0)
    return after(k), after(k + 1)


def account_periods(accounts: DataFrame, subscriptions: DataFrame, as_of: str) -> DataFrame:
    """B-1: ``period_start``, ``period_end`` and where they come from: the subscription's own month, or else (none, or
    one that starts later) the calendar month of ``as_of``."""
    at = F.lit(as_of).cast("timestamp_ntz")
    s = subscriptions.filter(F.col("subscription_start") <= at).groupBy("account_uuid").agg(F.max("subscription_start").alias("__anchor"))
    first, last = month_period(F.col("__anchor"), at)
    month = F.date_trunc("month", at).cast("timestamp_ntz")
    known = F.col("__anchor").isNotNull()
    return accounts.join(s, "account_uuid", "left").select(
        *accounts.columns,
        F.when(known, first).otherwise(month).alias("period_start"),
        F.when(known, last).otherwise(F.timestamp_add("MONTH", F.lit(1), month).cast("timestamp_ntz")).alias("period_end"),
        F.when(known, "subscription").otherwise("calendar").alias("period_source"),
    )
