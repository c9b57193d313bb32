"""Resource views: host cost by service, idle resources, inventory against the cloud bill (B-19, B-30, B-32).

Costs and use are reduced to one row per resource and day (or month) first; the windows
over a resource then hold at most one row a day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterwise.operators.allocation import allocate
from meterwise.operators.upsert import first_per_key

SHARE_UNITS = 1_000_000_000


def host_split(hosts: DataFrame, use: DataFrame, keys: list[str], weights: dict[str, int], rule_version: str) -> DataFrame:
    """B-19: split a host's cost over its services by weighted shares of its metrics.

    ``hosts``: ``keys + pool_cents``; ``use``: ``keys + service`` and one column per metric of ``weights``.  A
    metric that no service used gives its weight to the others; a host without any use is split equally.
    Shares sum to 1 and the cents of a host add up exactly.  The cost of a host without a row of use goes to the
    service ``unassigned``.
    """
    w = Window.partitionBy(*keys)
    spare = hosts.join(use.select(*keys).distinct(), keys, "left_anti").select(
        *keys, F.lit("unassigned").alias("service"), *[F.lit(0).cast("long").alias(m) for m in weights]
    )
    use = use.select(*keys, "service", *weights).unionByName(spare)
    x = use.select(*keys, "service", *weights, *[F.sum(m).over(w).alias(f"__t_{m}") for m in weights])
    live = sum((F.when(F.col(f"__t_{m}") > 0, F.lit(v)).otherwise(F.lit(0)) for m, v in weights.items()), F.lit(0))
    part = F.lit(0.0)
    for m, v in weights.items():
        part = part + F.when(
            F.col(f"__t_{m}") > 0, F.lit(float(v)) * F.col(m).cast("double") / F.col(f"__t_{m}").cast("double")
        ).otherwise(F.lit(0.0))
    share = F.when(live > 0, part / live.cast("double")).otherwise(F.lit(1.0) / F.count("*").over(w).cast("double"))
    x = x.select(*keys, "service", share.alias("share"))
    x = x.withColumn("weight", F.floor(F.col("share") * F.lit(float(SHARE_UNITS))).cast("long"))
    cents = allocate(hosts, x, keys, "service").select(*keys, "service", "allocated_cents")
    return x.drop("weight").join(cents, [*keys, "service"]).withColumn("rule_version", F.lit(rule_version))


def idle_stretches(daily: DataFrame, key: list[str], min_days: int) -> DataFrame:
    """B-30: stretches of at least ``min_days`` calendar days in which a resource cost money and was not used.

    ``daily``: ``key + day, cost, used``, one row per key and day.  A stretch runs from a day that cost money
    unused to the last such day before the next use; days without a row neither end nor start one.
    """
    w = Window.partitionBy(*key).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    x = daily.withColumn("__stretch", F.sum(F.when(F.col("used") > 0, 1).otherwise(0)).over(w))
    x = x.filter((F.col("cost") > 0) & (F.coalesce("used", F.lit(0)) == 0))
    g = x.groupBy(*key, "__stretch").agg(
        F.min("day").alias("idle_from"), F.max("day").alias("idle_to"), F.sum("cost").cast("decimal(38,2)").alias("idle_cost")
    )
    days = (F.datediff("idle_to", "idle_from") + 1).cast("long")
    return g.select(*key, "idle_from", "idle_to", days.alias("idle_days"), "idle_cost").filter(F.col("idle_days") >= min_days)


def load_windows(feed: DataFrame, keys: list[str]) -> DataFrame:
    """B-32: an inventory feed in which the first delivery (by ``arrival``) of each window stands; a window is never written twice."""
    return first_per_key(feed, keys, "arrival")


def uncovered_assets(assets: DataFrame, bill: DataFrame) -> DataFrame:
    """B-32: ``assets`` (``resource_id, window_start, ...``) with ``covered``: the cloud bill has this resource on that day,
    so the asset's cost is shown but must not be added to the total."""
    billed = bill.select("resource_id", F.col("day").alias("window_start")).distinct().withColumn("covered", F.lit(True))
    return assets.join(billed, ["resource_id", "window_start"], "left").withColumn("covered", F.coalesce("covered", F.lit(False)))
