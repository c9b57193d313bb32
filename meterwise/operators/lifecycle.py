"""Account lifecycle: arrears scan (A-S13) and suspension sweep (A-T7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.config import ARREARS_SUSPEND_THRESHOLD_DAYS, SUSPEND_SUSPENDED


def arrears_accounts(quota_states: DataFrame) -> DataFrame:
    """A-S13: in arrears and not yet suspended."""
    return quota_states.filter(F.col("arrears") & (F.col("suspend_state") != SUSPEND_SUSPENDED))


def suspension_sweep(quota_states: DataFrame, as_of: str, threshold_days: int = ARREARS_SUSPEND_THRESHOLD_DAYS) -> DataFrame:
    """A-T7: suspend accounts in arrears for at least ``threshold_days`` at ``as_of``.

    A null ``arrears_since`` never escalates and nothing is re-activated.  Only
    ``suspend_state`` changes (D6: the other columns are left as stored).
    """
    cutoff = (F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(threshold_days)} DAYS")).cast("timestamp_ntz")
    due = (
        F.col("arrears")
        & (F.col("suspend_state") != SUSPEND_SUSPENDED)
        & F.col("arrears_since").isNotNull()
        & (F.col("arrears_since") <= cutoff)
    )
    due = F.coalesce(due, F.lit(False))
    return quota_states.withColumn("suspended_now", due).withColumn(
        "suspend_state", F.when(due, F.lit(SUSPEND_SUSPENDED)).otherwise(F.col("suspend_state"))
    )
