"""Job parameters.  The reference reads these from its environment; here they are
plain arguments with the same meaning and defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class RatingConfig:
    """Defaults used when an account has no billing profile / quota row."""

    price_per_byte: float = 0.0
    included_quota_bytes: int = 0
    initial_balance: float = 0.0
    default_region: str = ""
    source_revision: str = ""
    # D2: how several snapshots of one (node, account) in one minute fill the bucket:
    # "sum" adds their deltas (conserves usage), "last" keeps the later delta.
    minute_policy: str = "sum"
    # D12: "full" bills the whole cumulative value of a first-ever sample, "baseline" bills 0.
    first_sample: str = "full"
    # Grain of the two-level running sums that split one hot key over many tasks.
    chunk: str = "day"


# Job cadence constants of the metered service.
COLLECT_INTERVAL_SECONDS = 60
SOURCE_WINDOW_OVERLAP_SECONDS = 120
ARREARS_SUSPEND_THRESHOLD_DAYS = 14
REJECT_EXCERPT_LIMIT = 120
SOURCE_TIMEOUT_DEFAULT_SECONDS = 15

# Ledger row constants.
ENTRY_TYPE_TRAFFIC = "traffic_charge"
RATING_STATUS_RATED = "rated"
THROTTLE_NORMAL = "normal"
THROTTLE_THROTTLED = "throttled"
SUSPEND_ACTIVE = "active"
SUSPEND_SUSPENDED = "suspended"
