"""Vendor cost import (A-C1..A-C5): per-provider normalisers into one fact table.

Input: flattened daily cost lines ``provider, account_id, service_name, region,
usage_start_time, amount, currency``; ``flatten_gcp`` and ``flatten_azure`` make them of the
vendors' nested rows.

Output (common schema): ``provider, account_id, service_name, region,
usage_start_time, usage_end_time, cost_amount DECIMAL(38,12), currency``, one row per
day and key.  Every normaliser is a filter + hash aggregate (partial, map-side).

Provider rules kept from the importer:
* AWS: grouped by service, region, linked account and the metric unit (currency);
  groups whose sum is zero or missing are dropped (A-A2, A-P11);
* GCP: ``SUM(cost)`` by service, region, billing account, currency, zero dropped
  *after* the sum; blank region -> ``global`` (A-A3, A-P12; null too, D10);
* Azure: zero rows dropped *before* the sum, missing category / location ->
  ``Unknown``, summed by service and region (A-A4, A-P11, A-P12).  Currency stays
  part of the key (D10); ``azure_force_usd=True`` reproduces the literal ``USD``.

Window (A-P13): with ``as_of`` only the day ``[midnight(as_of) - 2d, -1d)`` is kept
(T-2, half-open); without it all days are kept, the day being part of the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.functions.ids import uuid5_oid
from meterwise.functions.time import day_start

COST_KEY = ("provider", "account_id", "service_name", "region", "usage_start_time", "currency")
COST_COLS = ("provider", "account_id", "service_name", "region", "usage_start_time", "usage_end_time", "cost_amount", "currency")
MONEY = "decimal(38,12)"  # the stored sum keeps sub-cent amounts; views round once, after their own sums


def t_minus_2_bounds(as_of: str) -> tuple[Column, Column]:
    """A-P13: the half-open T-2 day of ``as_of``."""
    midnight = F.date_trunc("day", F.lit(as_of).cast("timestamp_ntz")).cast("timestamp_ntz")
    return F.date_sub(midnight, 2).cast("timestamp_ntz"), F.date_sub(midnight, 1).cast("timestamp_ntz")


def unified_costs(lines: DataFrame, as_of: str | None = None, azure_force_usd: bool = False) -> DataFrame:
    """A-C1..A-C4: every provider in one frame, by one read and one hash aggregate.

    The provider is part of the key and its rules are conditions on the row, so the
    fact is read once whatever the number of feeds; a missing feed is an empty slice.
    """
    provider = F.col("provider")
    azure = provider == "azure"
    usage_end = (F.col("usage_start_time") + F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz")
    x = lines.filter(provider.isin("aws", "gcp", "azure"))
    if as_of is not None:
        start, end = t_minus_2_bounds(as_of)
        x = x.filter((F.col("usage_start_time") >= start) & (F.col("usage_start_time") < end))
        x = x.filter(~azure | (usage_end <= end))
    # sub-cent lines count: sums, and the test for zero, are at full precision
    amount = F.when(provider == "aws", F.col("amount").try_cast("decimal(38,12)")).otherwise(
        F.col("amount").cast("decimal(38,12)")
    )
    x = x.withColumn("amount", amount).filter(~azure | (F.col("amount").isNotNull() & (F.col("amount") != 0)))
    service = F.when(azure, F.coalesce("service_name", F.lit("Unknown"))).otherwise(F.col("service_name"))
    region = (
        F.when(azure, F.coalesce("region", F.lit("Unknown")))
        .when((provider == "gcp") & (F.coalesce("region", F.lit("")) == ""), F.lit("global"))
        .otherwise(F.col("region"))
    )
    currency = F.when(azure, F.lit("USD")).otherwise(F.col("currency")) if azure_force_usd else F.col("currency")
    g = x.groupBy(
        "provider", "account_id", service.alias("service_name"), region.alias("region"),
        day_start(F.col("usage_start_time")).alias("usage_start_time"), currency.alias("currency"),
    ).agg(F.sum("amount").alias("cost_amount"))
    g = g.filter(azure | (F.col("cost_amount") != 0))
    return g.select(
        "provider", "account_id", "service_name", "region", "usage_start_time",
        usage_end.alias("usage_end_time"), F.col("cost_amount").cast(MONEY).alias("cost_amount"), "currency",
    )


def normalize_aws(lines: DataFrame, as_of: str | None = None) -> DataFrame:
    return unified_costs(lines.filter(F.col("provider") == "aws"), as_of)


def normalize_gcp(lines: DataFrame, as_of: str | None = None) -> DataFrame:
    return unified_costs(lines.filter(F.col("provider") == "gcp"), as_of)


def normalize_azure(lines: DataFrame, as_of: str | None = None, azure_force_usd: bool = False) -> DataFrame:
    return unified_costs(lines.filter(F.col("provider") == "azure"), as_of, azure_force_usd)


def flatten_gcp(export: DataFrame) -> DataFrame:
    """A-A3 input: billing-export rows with nested ``service.description`` and ``location.region``."""
    return export.select(
        F.lit("gcp").alias("provider"),
        F.col("billing_account_id").alias("account_id"),
        F.col("service.description").alias("service_name"),
        F.col("location.region").alias("region"),
        "usage_start_time",
        F.col("cost").alias("amount"),
        "currency",
    )


def flatten_azure(usage: DataFrame) -> DataFrame:
    """A-A4 input: usage details of both kinds.  A legacy row holds its amount in
    ``properties.cost`` and its category in ``properties.meterDetails.meterCategory``, a modern
    one in ``properties.costInBillingCurrency`` and ``properties.meterCategory``.  A row of
    another kind has a null amount, which the normaliser drops as it does a missing cost."""
    legacy, modern = F.col("kind") == "legacy", F.col("kind") == "modern"

    def either(old: str, new: str) -> Column:
        return F.when(legacy, F.col(f"properties.{old}")).when(modern, F.col(f"properties.{new}"))

    return usage.select(
        F.lit("azure").alias("provider"),
        F.col("subscription_id").alias("account_id"),
        either("meterDetails.meterCategory", "meterCategory").alias("service_name"),
        F.col("properties.resourceLocation").alias("region"),
        "usage_start_time",
        either("cost", "costInBillingCurrency").alias("amount"),
        either("billingCurrency", "billingCurrencyCode").alias("currency"),
    )


def cost_id(df_cols: list[str] | None = None) -> Column:
    """Deterministic id of a cost row (the importer used a random id for new rows)."""
    key = F.concat_ws(
        "|", "provider", "account_id", "service_name", "region",
        F.date_format("usage_start_time", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "currency",
    )
    return uuid5_oid(key)
