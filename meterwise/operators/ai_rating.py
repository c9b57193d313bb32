"""AI token rating (B-23): input, cached and output tokens priced per model, as of the day of use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("input", "cached", "output")
PER = 1_000_000  # prices are per so many tokens


def daily_tokens(usage: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Tokens by day, model and ``dims``: combined before the shuffle, so a hot project or conversation is one row a
    day and task from here on."""
    day = F.date_trunc("day", "used_at").cast("timestamp_ntz")
    return usage.groupBy(day.alias("day"), "model", *dims).agg(
        *[F.coalesce(F.sum(f"{k}_tokens"), F.lit(0)).cast("long").alias(f"{k}_tokens") for k in KINDS])


def rate_tokens(daily: DataFrame, prices: DataFrame) -> DataFrame:
    """``daily`` with ``cost`` at full precision: each price version holds until the model's next one.  Without a price
    the cost is null and ``priced`` false -- never a silent 0.  A missing cached price is the input price."""
    w = Window.partitionBy("model").orderBy("effective_from")
    p = prices.select(F.col("model").alias("__model"), "effective_from", F.lead("effective_from").over(w).alias("__until"),
                      *[F.col(f"{k}_price") for k in KINDS])
    holds = (F.col("effective_from") <= F.col("day")) & (F.col("__until").isNull() | (F.col("day") < F.col("__until")))
    j = daily.join(p, (F.col("model") == F.col("__model")) & holds, "left")
    price = {"cached": F.coalesce("cached_price", "input_price"), "input": F.col("input_price"), "output": F.col("output_price")}
    total = sum((F.col(f"{k}_tokens").cast("decimal(20,0)") * price[k].cast("decimal(12,6)") for k in KINDS), F.lit(0).cast("decimal(20,0)"))
    return j.select(*daily.columns, (total.cast("decimal(32,6)") / F.lit(PER).cast("decimal(7,0)")).cast("decimal(38,12)").alias("cost"),
                    F.col("effective_from").isNotNull().alias("priced"))


def token_costs(rated: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Cost and tokens by month for every value of each of ``dims``, from one read: ``month, dim, item, ...``."""
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("item")) for d in dims]))
    x = rated.withColumn("__at", each).withColumn("month", F.date_trunc("month", "day").cast("timestamp_ntz"))
    tokens = sum((F.col(f"{k}_tokens") for k in KINDS), F.lit(0))
    return x.groupBy("month", F.col("__at.dim").alias("dim"), F.col("__at.item").alias("item")).agg(
        *[F.sum(f"{k}_tokens").cast("long").alias(f"{k}_tokens") for k in KINDS],
        F.round(F.sum("cost"), 6).cast("decimal(38,6)").alias("cost"),
        F.sum(F.when(F.col("priced"), 0).otherwise(tokens)).cast("long").alias("unpriced_tokens"),
    )
