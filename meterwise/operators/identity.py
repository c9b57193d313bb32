"""Resource identity over time (B-16): names, renames, ends, and the cost that follows them.

A *name row* is one life of a name: ``name, born, died, next_name, next_born``.  A renamed resource's row points to the
row of its next name; a retired one has ``died`` and no successor; a name may be born again for another resource.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterwise.session import materialize

UNALLOCATED = "Unallocated"


def node_of(name: str, born: str) -> Column:
    return F.when(F.col(name).isNotNull(), F.concat_ws("@", F.col(name), F.col(born).cast("string")))


def follow(edges: DataFrame) -> DataFrame:
    """``(node, root, hops, cyclic)`` for rows ``(node, next)``, ``next`` null at the end of a chain.

    Pointer jumping: every round each pointer that has not reached an end is replaced by what it points to, so a chain
    of n takes about log2(n) rounds, each one equi-join; ends take no part any more.  A pointer that still moves after
    as many rounds as the longest chain could need is part of a cycle.
    """
    now = materialize(edges.select(
        "node", F.coalesce("next", "node").alias("root"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("hops"), F.lit(True).alias("moved")))
    for _ in range(now.count().bit_length() + 1):
        far = now.filter("hops > 0").select(F.col("node").alias("root"), F.col("root").alias("far"), F.col("hops").alias("more"))
        now = materialize(now.drop("moved").join(far, "root", "left").select(
            "node", F.coalesce("far", "root").alias("root"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"),
            F.col("far").isNotNull().alias("moved")))
        if now.filter("moved").isEmpty():
            break
    return now.select("node", "root", "hops", F.col("moved").alias("cyclic"))


def resolve_names(names: DataFrame) -> DataFrame:
    """``name, born, until, resource, ended_at, hops, cyclic``: which resource a name means from ``born`` until the name
    is born again.  ``resource`` is its last name."""
    rows = names.select("*", node_of("name", "born").alias("node"), node_of("next_name", "next_born").alias("next"))
    ends = rows.select(F.col("node").alias("root"), F.col("name").alias("resource"), F.col("died").alias("ended_at"))
    chain = follow(rows.select("node", "next")).join(ends, "root", "left")
    life = Window.partitionBy("name").orderBy("born")
    return rows.withColumn("until", F.lead("born").over(life)).join(chain, "node").select(
        "name", "born", "until", "resource", "ended_at", "hops", "cyclic")


def cost_by_resource(lines: DataFrame, names: DataFrame, name_col: str, time_col: str, amount_col: str, keys: list[str]) -> DataFrame:
    """``keys, resource, status, cost, lines, hops``: every line once, so totals are conserved.

    ``status``: ``active``; ``after_end`` (the resource had ended), ``unmapped`` (no such name at that time) and ``cyclic``
    (its renames lead in a circle) go to ``Unallocated``.  Lines are summed per name and time first.
    """
    known = resolve_names(names)
    per_name = lines.groupBy(*keys, F.col(name_col).alias("name"), F.col(time_col).alias("at")).agg(
        F.sum(F.col(amount_col).cast("decimal(38,12)")).alias("cost"), F.count(F.lit(1)).alias("lines"))
    holds = (known["born"] <= per_name["at"]) & (known["until"].isNull() | (per_name["at"] < known["until"]))
    j = per_name.join(known, (per_name["name"] == known["name"]) & holds, "left").drop(known["name"])
    status = (F.when(F.col("born").isNull() | F.col("resource").isNull(), F.lit("unmapped")).when(F.col("cyclic"), F.lit("cyclic"))
              .when(F.col("at") >= F.col("ended_at"), F.lit("after_end")).otherwise(F.lit("active")))
    j = j.withColumn("status", status)
    resource = F.when(F.col("status") == "active", F.col("resource")).otherwise(F.lit(UNALLOCATED))
    return j.groupBy(*keys, resource.alias("resource"), "status").agg(
        F.sum("cost").cast("decimal(38,2)").alias("cost"), F.sum("lines").cast("long").alias("lines"), F.max("hops").alias("hops"))


def cost_by_service(lines: DataFrame, mapping: DataFrame, resource_col: str, time_col: str, amount_col: str, keys: list[str]) -> DataFrame:
    """``keys, service, allocated, line_parts``: each line's cost goes to the services that its resource maps to at that time.

    ``mapping``: rows ``(resource_id, service, effective_from, effective_until)``, the end excluded and null if open; a
    repeated row counts once.  Services that hold at once share evenly at 12 decimals, and the first by name takes what is
    left, so totals are conserved; what maps to none (a null resource too) goes to ``Unallocated``.  Lines are summed per
    resource and time first, so a resource with very many lines meets its services once for each time.  A sum then meets
    the one span that holds its time (:func:`service_spans`) and is split in its own row: no set or window of the lines.
    """
    exact = "decimal(30,12)"
    per = lines.groupBy(*keys, F.col(resource_col).alias("rid"), F.col(time_col).alias("at")).agg(
        F.sum(F.col(amount_col).cast(exact)).cast(exact).alias("cost"), F.count(F.lit(1)).alias("lines"))
    holds = (F.col("since") <= F.col("at")) & (F.col("until").isNull() | (F.col("at") < F.col("until")))
    j = per.join(service_spans(mapping), (F.col("rid") == F.col("of")) & holds, "left")
    n = F.size("services").cast("decimal(7,0)")
    base = (F.col("cost") / n).cast(exact)
    others = (base * (n - 1).cast("decimal(7,0)")).cast(exact)  # cast back: a wider type would cost a decimal
    j = j.select(*keys, "cost", "lines", base.alias("base"), (F.col("cost") - others).cast(exact).alias("rest"),
                 F.posexplode_outer("services").alias("place", "service"))
    share = (F.when(F.col("service").isNull(), F.col("cost")).when(F.col("place") == 0, F.col("rest")).otherwise(F.col("base")))
    return j.groupBy(*keys, F.coalesce("service", F.lit(UNALLOCATED)).alias("service")).agg(
        F.sum(share).cast("decimal(38,12)").alias("allocated"), F.sum("lines").cast("long").alias("line_parts"))


def service_spans(mapping: DataFrame) -> DataFrame:
    """``of, since, until, services``: the spans of a resource's time between changes of its mapping, each with the sorted
    names that hold throughout; ``until`` is null for the last.  Spans of a resource never overlap."""
    known = mapping.filter(F.col("service").isNotNull() & F.col("resource_id").isNotNull() & F.col("effective_from").isNotNull()).select(
        F.col("resource_id").alias("of"), "service", F.col("effective_from").alias("born"), F.col("effective_until").alias("died"))
    changes = known.select("of", F.explode(F.array("born", "died")).alias("since")).filter(F.col("since").isNotNull()).distinct()
    spans = changes.withColumn("until", F.lead("since").over(Window.partitionBy("of").orderBy("since")))
    holds = (F.col("born") <= F.col("since")) & (F.col("died").isNull() | (F.col("since") < F.col("died")))
    # A service's rows that overlap are one claim, so a service never gets two shares of a line.
    return spans.join(known, "of").filter(holds).groupBy("of", "since", "until").agg(
        F.array_sort(F.collect_set("service")).alias("services"))
