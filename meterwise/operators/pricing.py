"""A-P8 / A-J2: effective pricing per account.

A profile value wins only when it is positive; each multiplier that is not positive
counts as 1, and so does a non-positive product; a blank rule version falls back to
the configured revision.  Accounts without a profile get the configured defaults.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.config import RatingConfig
from meterwise.functions.text import go_trim

PRICING_COLS = ("included_quota_bytes", "price_per_byte", "multiplier", "pricing_rule_version")


def resolve_pricing(profiles: DataFrame, cfg: RatingConfig) -> DataFrame:
    """Profile rows -> ``account_uuid`` + effective pricing columns."""
    rm = F.when(F.col("region_multiplier") > 0, F.col("region_multiplier")).otherwise(F.lit(1.0))
    lm = F.when(F.col("line_multiplier") > 0, F.col("line_multiplier")).otherwise(F.lit(1.0))
    mult = rm * lm
    version = go_trim(F.col("pricing_rule_version"))
    return profiles.select(
        "account_uuid",
        F.when(F.col("included_quota_bytes") > 0, F.col("included_quota_bytes"))
        .otherwise(F.lit(cfg.included_quota_bytes))
        .cast("long")
        .alias("included_quota_bytes"),
        F.when(F.col("base_price_per_byte") > 0, F.col("base_price_per_byte"))
        .otherwise(F.lit(float(cfg.price_per_byte)))
        .alias("price_per_byte"),
        F.when(mult > 0, mult).otherwise(F.lit(1.0)).alias("multiplier"),
        F.when(F.coalesce(version, F.lit("")) != "", version)
        .otherwise(F.lit(cfg.source_revision))
        .alias("pricing_rule_version"),
    )


def attach_pricing(df: DataFrame, profiles: DataFrame | None, cfg: RatingConfig) -> DataFrame:
    """Left join the effective pricing onto rows keyed by ``account_uuid``.

    Profiles grow with the number of accounts, so no broadcast is forced: the
    planner broadcasts them only when its size estimate is under the threshold.
    """
    defaults = {
        "included_quota_bytes": F.lit(cfg.included_quota_bytes).cast("long"),
        "price_per_byte": F.lit(float(cfg.price_per_byte)),
        "multiplier": F.lit(1.0),
        "pricing_rule_version": F.lit(cfg.source_revision),
    }
    if profiles is None:
        return df.select("*", *[v.alias(k) for k, v in defaults.items()])
    p = resolve_pricing(profiles, cfg)
    j = df.join(p, on="account_uuid", how="left")
    keep = [c for c in df.columns]
    return j.select(*keep, *[F.coalesce(F.col(k), v).alias(k) for k, v in defaults.items()])
