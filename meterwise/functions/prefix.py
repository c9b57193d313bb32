"""Ordered windows that do not put one key in one task.

A plain ``sum(x) over (partition by key order by t)`` sends every row of a key to a
single task.  When one account (or one node/account pair) carries a third of all
rows that task is the whole job.  The two-level form below is the classic parallel
prefix sum, written with Spark's own operators:

1. partial per ``(key, chunk)`` summaries -- totals, maxima, the last row -- by a
   hash aggregate that combines map-side;
2. a window over the *chunk summaries* of each key (one row per chunk, e.g. per day
   of history), which carries totals and the last row into the next chunk;
3. join the carry back on ``(key, chunk)`` and finish with a window per
   ``(key, chunk)``.

The input is written to the shared folder first, as steps 1 and 3 both read it.  Only step 3
shuffles the rows, by ``(key, chunk)``, so a hot key spreads over as many tasks as it has
chunks; the join and the final window share that partitioning.
``chunk`` must be monotone in the leading ``order`` column (the day of the time the
rows are ordered by).  With ``chunk=None`` plain windows over the key are used.
A row with a null key or chunk keeps its place in the result, but carries nothing over from other chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterwise.session import materialize

_UNB = Window.unboundedPreceding
_UNF = Window.unboundedFollowing

# frame names: "incl" = rows up to and including the current one, "excl" = rows
# before the current one, "all" = every row of the key.
RunSpec = tuple[Column, str, str]


def _cols(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in names]


def _agg(kind: str):
    return F.sum if kind == "sum" else F.max


def chunked_window(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    chunk: Column | None,
    lags: Sequence[str] = (),
    runs: dict[str, RunSpec] | None = None,
    lag_prefix: str = "prev_",
) -> DataFrame:
    """Add ``prev_<c>`` for every column in ``lags`` (value of the previous row of the
    key, null on its first row) and one column per ``runs`` entry
    ``name -> (value, kind, frame)`` with kind ``"sum"`` (never null, empty = 0) or
    ``"max"`` (null when nothing qualifies)."""
    runs = runs or {}
    base_cols = df.columns
    order_cols = _cols(order)
    tmp = df.select("*", *[expr.alias(f"__v_{n}") for n, (expr, _, _) in runs.items()])

    def finish(name: str, kind: str, value: Column) -> Column:
        return (F.coalesce(value, F.lit(0)) if kind == "sum" else value).alias(name)

    if chunk is None:
        w = Window.partitionBy(*keys).orderBy(*order_cols)
        out = [F.lag(c).over(w).alias(lag_prefix + c) for c in lags]
        for n, (_, kind, frame) in runs.items():
            if frame == "all":
                wf = Window.partitionBy(*keys)
            else:
                wf = w.rowsBetween(_UNB, 0 if frame == "incl" else -1)
            out.append(finish(n, kind, _agg(kind)(f"__v_{n}").over(wf)))
        return tmp.select(*base_cols, *out)

    part = [*keys, "__chunk"]
    # Two branches read the rows: the summaries, combined before their shuffle, and the finishing windows.
    # Written once, the input is computed once, whatever columns either branch needs.
    tmp = materialize(tmp.withColumn("__chunk", chunk))
    summaries = []
    if lags:
        summaries.append(F.max_by(F.struct(*lags), F.struct(*order_cols)).alias("__last"))
    summaries += [_agg(kind)(f"__v_{n}").alias(f"__t_{n}") for n, (_, kind, _) in runs.items()]
    totals = tmp.groupBy(*part).agg(*summaries)

    w_chunks = Window.partitionBy(*keys).orderBy("__chunk")
    carry_cols = []
    if lags:
        carry_cols.append(F.lag("__last").over(w_chunks).alias("__carry"))
    for n, (_, kind, frame) in runs.items():
        wf = Window.partitionBy(*keys) if frame == "all" else w_chunks.rowsBetween(_UNB, -1)
        carry_cols.append(_agg(kind)(f"__t_{n}").over(wf).alias(f"__o_{n}"))
    carry = totals.select(*part, *carry_cols)

    # Explicit: an input already hash-partitioned by the key alone would satisfy the (key, chunk) windows
    # below and silently keep a hot key in one task.
    rows = tmp.repartition(*part)
    joined = rows.join(carry, on=part, how="left")  # left: a row with a null key or time has no carry, but stays
    w = Window.partitionBy(*part).orderBy(*order_cols)
    out = []
    if lags:
        first = F.row_number().over(w) == 1
        out += [
            F.when(first, F.col("__carry")[c]).otherwise(F.lag(c).over(w)).alias(lag_prefix + c) for c in lags
        ]
    for n, (_, kind, frame) in runs.items():
        o = F.col(f"__o_{n}")
        if frame == "all":
            out.append(finish(n, kind, o))
            continue
        r = _agg(kind)(f"__v_{n}").over(w.rowsBetween(_UNB, 0 if frame == "incl" else -1))
        if kind == "sum":
            out.append((F.coalesce(o, F.lit(0)) + F.coalesce(r, F.lit(0))).alias(n))
        else:
            out.append(F.greatest(o, r).alias(n))
    return joined.select(*base_cols, *out)


def chunked_running(df, keys, order, chunk, specs: dict[str, tuple[Column, str, bool]]) -> DataFrame:
    """Running sums/maxima: ``name -> (value, kind, include_current)``."""
    runs = {n: (e, k, "incl" if inc else "excl") for n, (e, k, inc) in specs.items()}
    return chunked_window(df, keys, order, chunk, runs=runs)


def chunked_lag(df, keys, order, chunk, cols: Sequence[str], prefix: str = "prev_") -> DataFrame:
    return chunked_window(df, keys, order, chunk, lags=cols, lag_prefix=prefix)
