"""Connected components of links, as joins and aggregates that shrink towards the smallest node."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import cut


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of ``links``: the smallest node that can be reached.

    Each round reads, for every link, the grandparent of the far end, and lowers the near end and its parent to it;
    long chains halve.  Every step is a keyed aggregate (combined before the shuffle) or an equi-join whose hot keys
    adaptive execution splits, and each round's labels are cut into the shared folder.  Nulls never link.
    """
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u != v")
    edges = cut(pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    label = cut(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("f")))
    total = label.agg(F.sum(F.col("f").cast("decimal(38,0)"))).first()[0]
    while True:
        up = label.select(F.col("u").alias("f"), F.col("f").alias("g"))
        grand = label.join(up, "f").select("u", "f", "g")
        far = edges.join(grand.select(F.col("u").alias("v"), F.col("g")), "v").groupBy("u").agg(F.min("g").alias("m"))
        low = label.join(far, "u")
        lowered = (grand.select("u", F.col("g").alias("f"))
                   .union(low.select("u", F.col("m").alias("f")))
                   .union(low.select(F.col("f").alias("u"), F.col("m").alias("f"))))
        label = cut(lowered.groupBy("u").agg(F.min("f").alias("f")))
        now = label.agg(F.sum(F.col("f").cast("decimal(38,0)"))).first()[0]
        if now == total:  # labels only ever fall, so equal sums mean that none has changed
            return label.select(F.col("u").alias("node"), F.col("f").alias("component"))
        total = now


def local_forest(a, b):
    """A spanning forest of the links ``a[i] - b[i]`` of one task: each node with its smallest node, no loops."""
    import numpy as np

    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = both[: len(a)], both[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = label.copy()
        np.minimum.at(low, u, label[v])
        np.minimum.at(low, v, label[u])
        np.minimum.at(low, label, low.copy())
        low = low[low]
        if (low == label).all():
            break
        label = low
    keep = label != np.arange(len(nodes))
    return nodes[label[keep]], nodes[keep]
