"""Token counts from an exact length histogram."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .scratch import cut
from .tokens import encode
from .words import slices

STRIDE = 1024  # lengths in one part of the histogram


def _lengths(path: str):
    def run(batches):
        for batch in batches:
            for _, texts in slices(batch.column(0)):
                offsets, _ = encode(texts, path)
                length, n = np.unique(np.diff(offsets), return_counts=True)  # map-side: one row per length and batch
                yield pa.RecordBatch.from_arrays([pa.array(length), pa.array(n)], ["length", "n"])
    return run


def length_histogram(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """``(length, n_docs)``: how many whole texts have so many tokens.  A null or empty text has none."""
    found = docs.select(F.col(text_col).alias("text")).mapInArrow(_lengths(tokenizer), "length long, n long")
    return found.groupBy("length").agg(F.sum("n").alias("n_docs"))


def context_totals(histogram: DataFrame) -> DataFrame:
    """For every length that occurs, as a context limit: what a corpus cut at that limit holds.

    ``n_docs`` of that length, ``docs_at_least`` and ``tokens_at_least`` (suffix sums), ``docs_within``,
    ``truncated_tokens`` (every document cut at the limit), ``lost_tokens``, ``total_tokens``, ``quantile`` (share of
    documents no longer than it).  A limit between two lengths has the totals of the next smaller one, plus
    (limit - length) for each longer document.  The sums run over parts of ``STRIDE`` lengths and then over the
    parts, so no task sorts the whole histogram.
    """
    rows = cut(histogram.withColumn("part", F.floor(F.col("length") / STRIDE)))
    parts = rows.groupBy("part").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("length")).alias("t"))
    after = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = parts.select("part", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"),
                         F.sum("d").over(everything).alias("n_all"), F.sum("t").over(everything).alias("t_all"))
    suffix = Window.partitionBy("part").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.join(parts, "part").select(
        "length", "n_docs", "n_all", "t_all",
        (F.col("d_after") + F.sum("n_docs").over(suffix)).alias("docs_at_least"),
        (F.col("t_after") + F.sum(F.col("n_docs") * F.col("length")).over(suffix)).alias("tokens_at_least"))
    cut_tokens = F.col("t_all") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("length")
    return sums.select(
        "length", "n_docs", "docs_at_least", "tokens_at_least",
        (F.col("n_all") - F.col("docs_at_least") + F.col("n_docs")).alias("docs_within"),
        cut_tokens.alias("truncated_tokens"), (F.col("t_all") - cut_tokens).alias("lost_tokens"), F.col("t_all").alias("total_tokens"),
        ((F.col("n_all") - F.col("docs_at_least") + F.col("n_docs")) / F.col("n_all")).alias("quantile"))


def truncated_total(totals: DataFrame, limit: int) -> int:
    """Tokens that documents cut at ``limit`` hold together."""
    below = totals.where(F.col("length") <= limit).orderBy(F.desc("length")).limit(1).first()
    if below is None:
        first = totals.orderBy("length").limit(1).first()
        return 0 if first is None else first["docs_at_least"] * limit
    return below["truncated_tokens"] + (limit - below["length"]) * (below["docs_at_least"] - below["n_docs"])


def length_quantile(totals: DataFrame, q: float) -> int | None:
    """The smallest length that a share ``q`` of documents does not exceed."""
    row = totals.where(F.col("quantile") >= q).orderBy("length").limit(1).first()
    return None if row is None else row["length"]
