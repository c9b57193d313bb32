"""A-U1..A-U3: keyed upsert, insert-if-absent and replay accounting on plain tables.

Parquet has no MERGE, so an upsert is a full outer join of the stored rows with the
batch on the key (both sides unique per key), written back by dynamic partition
overwrite to a staging path and swapped -- never read and overwritten in one job.
Within a batch the latest row per key wins; that dedupe is a partial aggregate
(``max_by``), so a key delivered many times is combined map-side, not in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key: the row with the greatest ``order`` (ties: greatest row)."""
    others = [c for c in df.columns if c not in keys]
    if not others:
        return df.dropDuplicates(list(keys))
    ordering = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order], *others)
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*others), ordering).alias("__row"))
        .select(*keys, *[F.col(f"__row.{c}").alias(c) for c in others])
    )


def keyed_upsert(
    base: DataFrame,
    batch: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column] = (),
    keep: Sequence[str] = (),
    touched_col: str | None = None,
    touched_at: Column | None = None,
) -> DataFrame:
    """``INSERT .. ON CONFLICT (keys) DO UPDATE SET v = EXCLUDED.v`` over DataFrames.

    Columns in ``keep`` (e.g. ``id``, ``created_at``) keep the stored value when the
    key exists.  ``touched_col`` is set to ``touched_at`` on inserted/updated rows.
    The result has ``base``'s columns (plus ``touched_col``).
    """
    keys = list(keys)
    cols = [c for c in base.columns if c not in keys]
    b = latest_per_key(batch, keys, order) if order else batch
    old = base.select(*keys, *[F.col(c).alias(f"__o_{c}") for c in cols], F.lit(True).alias("__in_old"))
    new = b.select(*keys, *[F.col(c).alias(f"__n_{c}") for c in cols if c in b.columns], F.lit(True).alias("__in_new"))
    j = old.join(new, on=keys, how="full")
    in_new = F.coalesce(F.col("__in_new"), F.lit(False))
    in_old = F.coalesce(F.col("__in_old"), F.lit(False))
    out = []
    for c in cols:
        if c not in b.columns or c in keep:
            n = F.col(f"__n_{c}") if c in b.columns else F.lit(None)
            out.append(F.when(in_old, F.col(f"__o_{c}")).otherwise(n).alias(c))
        else:
            out.append(F.when(in_new, F.col(f"__n_{c}")).otherwise(F.col(f"__o_{c}")).alias(c))
    if touched_col:
        prev = F.col(f"__o_{touched_col}") if touched_col in cols else F.lit(None)
        out = [o for o, c in zip(out, cols) if c != touched_col]
        out.append(F.when(in_new, touched_at).otherwise(prev).alias(touched_col))
    return j.select(*keys, *out)


def first_per_key(rows: DataFrame, keys: Sequence[str], arrival: str) -> DataFrame:
    """B-9: the first delivery of each key by ``arrival``; later ones, equal or not, have no effect."""
    rest = [c for c in rows.columns if c not in keys and c != arrival]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), arrival).alias("__first"))
    return first.select(*keys, *[F.col("__first")[c].alias(c) for c in rest])


def with_existed(batch: DataFrame, base: DataFrame, keys: Sequence[str], name: str = "existed") -> DataFrame:
    """A-S8 / A-S10 probe: flag batch rows whose key is already stored."""
    probe = base.select(*keys).distinct().withColumn(name, F.lit(True))
    return batch.join(probe, on=list(keys), how="left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def insert_if_absent(base: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A-U2: only the first insert of a key has an effect (ledger rows are immutable)."""
    fresh = batch.join(base.select(*keys), on=list(keys), how="left_anti")
    return base.unionByName(fresh.select(*base.columns))


def replay_counters(bucket_flags: DataFrame, ledger_flags: DataFrame, processed: DataFrame) -> DataFrame:
    """A-U3: ``processed_samples``, ``written_minutes`` and ``replayed_minutes``.

    As in the service, a replayed minute counts once for its bucket and once more for
    its ledger row.  Inputs carry an ``existed`` flag; one aggregate each.
    """
    u = (
        bucket_flags.select(F.lit("bucket").alias("kind"), F.col("existed"))
        .unionByName(ledger_flags.select(F.lit("ledger").alias("kind"), F.col("existed")))
        .unionByName(processed.select(F.lit("sample").alias("kind"), F.lit(False).alias("existed")))
    )
    return u.agg(
        F.sum(F.when(F.col("kind") == "sample", 1).otherwise(0)).cast("long").alias("processed_samples"),
        F.sum(F.when((F.col("kind") == "bucket") & ~F.col("existed"), 1).otherwise(0)).cast("long").alias("written_minutes"),
        F.sum(F.when(F.col("existed"), 1).otherwise(0)).cast("long").alias("replayed_minutes"),
    )
