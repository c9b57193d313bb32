"""Shared-cost allocation (B-18): split a pool over targets by weight, to the cent.

``share = (pool_cents * w) div sum(w)`` per target, exact in 38-digit decimals; the
cents left over go to the target with the largest weight (ties: smallest target id),
so every pool adds up exactly.  A pool is a (pool, month) group with a handful of
targets, so the per-pool windows stay small whatever the data volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def allocate(pools: DataFrame | None, weights: DataFrame, pool_keys: list[str], target: str) -> DataFrame:
    """``pools``: ``pool_keys + pool_cents``; ``weights``: ``pool_keys + target + weight``
    (non-negative integers).  A pool whose weights sum to 0 is split equally.  With ``pools=None`` the
    weights carry their pool's ``pool_cents`` (null: there is none), which saves a second read of the costs.

    Returns ``pool_keys, target, weight, allocated_cents``.
    """
    per_pool = Window.partitionBy(*pool_keys)
    carried = ["pool_cents"] if pools is None else []
    w = weights.select(*pool_keys, target, *carried, F.greatest(F.col("weight"), F.lit(0)).cast("long").alias("weight"))
    w = w.withColumn("__wsum", F.sum("weight").over(per_pool)).withColumn("__n", F.count("*").over(per_pool))
    w = w.withColumn("__eff", F.when(F.col("__wsum") > 0, F.col("weight")).otherwise(F.lit(1)).cast("long"))
    w = w.withColumn("__den", F.when(F.col("__wsum") > 0, F.col("__wsum")).otherwise(F.col("__n")).cast("long"))
    if pools is None:
        j = w.filter(F.col("pool_cents").isNotNull())
    else:
        j = w.join(pools.select(*pool_keys, "pool_cents"), pool_keys, "inner")
    share = F.expr(
        "CAST((CAST(pool_cents AS DECIMAL(38,0)) * CAST(__eff AS DECIMAL(38,0))) div CAST(__den AS DECIMAL(38,0)) AS BIGINT)"
    )
    j = j.withColumn("__share", share)
    first = Window.partitionBy(*pool_keys).orderBy(F.col("__eff").desc(), F.col(target))
    j = j.withColumn("__rk", F.row_number().over(first)).withColumn("__given", F.sum("__share").over(per_pool))
    cents = F.when(F.col("__rk") == 1, F.col("__share") + F.col("pool_cents") - F.col("__given")).otherwise(F.col("__share"))
    return j.select(*pool_keys, target, "weight", cents.cast("long").alias("allocated_cents"))


def choose_rules(pools: DataFrame, rules: DataFrame, keys: list[str], pool_col: str, month_col: str, drafts: bool = False) -> DataFrame:
    """``pools`` with ``rule_id, method`` of the rule in force (null: none).

    ``rules``: ``rule_id, pool, method, priority, effective_from, effective_to, state``; ``pool`` ``*`` stands for every pool.
    Of the rules whose months hold the pool's, the least ``priority`` wins, then the rule of the pool itself, then the
    later start, then the id.  Rules in ``draft`` take part in a simulation only (``drafts``).
    """
    live = rules if drafts else rules.filter(F.col("state") == "active")
    r = live.select(F.col("pool").alias("__pool"), "rule_id", "method", "priority", "effective_from", "effective_to")
    asked = pools.withColumn("__pool", F.explode(F.array(F.col(pool_col), F.lit("*"))))
    month = F.col(month_col)
    in_force = (F.col("effective_from") <= month) & (F.col("effective_to").isNull() | (month < F.col("effective_to")))
    found = asked.join(r, "__pool").filter(in_force)
    rank = F.struct("priority", (F.col("__pool") == "*").alias("general"), (-F.unix_seconds(F.col("effective_from").cast("timestamp"))).alias("start"), "rule_id")
    won = found.groupBy(*keys).agg(F.min_by(F.struct("rule_id", "method"), rank).alias("__won"))
    return pools.join(won, keys, "left").select(*pools.columns, F.col("__won.rule_id").alias("rule_id"), F.col("__won.method").alias("method"))


def cents(amount: Column) -> Column:
    """Whole cents of a sum, rounded once."""
    return F.round(amount * 100, 0).cast("long")


def allocate_by_rules(facts: DataFrame, rules: DataFrame, shares: DataFrame, keys: list[str], pool_col: str, month_col: str, target: str,
                      drafts: bool = False) -> DataFrame:
    """``keys, rule_id, method, target, weight, allocated_cents``: every pool by the rule in force, to the cent.

    ``facts``: one row per ``keys`` and target with ``shared, direct, usage`` (sums; null where there is none).  The pool is
    the sum of ``shared``; targets are those with a ``direct`` cost.  Methods: ``equal``, ``proportional`` (direct cost),
    ``usage``, ``fixed`` and ``custom`` (weights of ``shares``: ``rule_id, target, weight``).  A pool without a rule or without
    a target goes to ``Unallocated``, so what is allocated equals what was shared.
    """
    pools = facts.groupBy(*keys).agg(F.sum("shared").alias("shared"), F.count("direct").alias("targets")).filter(F.col("shared").isNotNull())
    pools = choose_rules(pools.select(*keys, cents(F.col("shared")).alias("pool_cents"), "targets"), rules, keys, pool_col, month_col, drafts)
    served = pools.filter(F.col("rule_id").isNotNull() & (F.col("targets") > 0)).drop("targets")
    w = facts.filter(F.col("direct").isNotNull()).join(served, keys).join(
        shares.select("rule_id", F.col("target").alias(target), F.col("weight").alias("__own")), ["rule_id", target], "left")
    method = F.col("method")
    weight = (F.when(method == "equal", F.lit(1)).when(method == "proportional", cents(F.col("direct"))).when(method == "usage", F.col("usage").cast("long"))
              .otherwise(F.coalesce("__own", F.lit(0))))
    given = allocate(None, w.withColumn("weight", weight.cast("long")), [*keys, "rule_id", "method"], target)
    rest = pools.filter(F.col("rule_id").isNull() | (F.col("targets") == 0)).select(
        *keys, "rule_id", "method", F.lit("Unallocated").alias(target), F.lit(0).cast("long").alias("weight"), F.col("pool_cents").alias("allocated_cents"))
    return given.unionByName(rest)


def allocation_changes(before: DataFrame, after: DataFrame, keys: list[str], target: str) -> DataFrame:
    """What another set of rules changes: ``keys, target, before_rule, after_rule, before_cents, after_cents, change_cents``,
    rows without a change left out.  For a simulation these are its effect; for a closed month that is computed again
    they are the adjustments to post, and the stored allocation stays as it is."""
    def side(df, name):
        return df.select(*keys, target, F.col("rule_id").alias(f"{name}_rule"), F.col("allocated_cents").alias(f"{name}_cents"))

    j = side(before, "before").join(side(after, "after"), [*keys, target], "full")
    j = j.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("before_cents", "after_cents")})
    return j.withColumn("change_cents", F.col("after_cents") - F.col("before_cents")).filter(F.col("change_cents") != 0)


def split_by_share(pools: DataFrame, weights: DataFrame, keys: list[str], target: str) -> DataFrame:
    """:func:`allocate` for pools with any number of targets: ``keys, target, weight, allocated_cents``.

    No window over a pool: totals and the largest target come from aggregates that combine before their shuffle, and a
    target row meets its pool's one row.  A pool whose weights sum to 0, or that has none, goes to ``Unallocated``.
    """
    w = weights.filter(F.col("weight") > 0).select(*keys, target, F.col("weight").cast("decimal(38,0)").alias("weight"))
    totals = w.groupBy(*keys).agg(F.sum("weight").cast("decimal(38,0)").alias("__all"),
                                  F.min_by(target, F.struct(-F.col("weight"), F.col(target))).alias("__largest"))
    p = pools.join(totals, keys, "left")
    j = w.join(p.filter(F.col("__all").isNotNull()), keys)
    j = j.withColumn("__share", F.expr("CAST((CAST(pool_cents AS DECIMAL(38,0)) * weight) div __all AS BIGINT)"))
    rest = j.groupBy(*keys).agg((F.first("pool_cents") - F.sum("__share")).cast("long").alias("__rest"))
    j = j.join(rest, keys)
    share = F.col("__share") + F.when(F.col(target) == F.col("__largest"), F.col("__rest")).otherwise(F.lit(0))
    lone = p.filter(F.col("__all").isNull()).select(*keys, F.lit("Unallocated").alias(target), F.lit(0).cast("long").alias("weight"), F.col("pool_cents").cast("long").alias("allocated_cents"))
    return j.select(*keys, target, F.col("weight").cast("long").alias("weight"), share.cast("long").alias("allocated_cents")).unionByName(lone)
