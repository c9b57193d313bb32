"""Meter-and-rate job: inbound snapshot entries -> buckets, ledger, state.

One batch covers any number of sources, nodes and accounts at once; there is no
per-source or per-account loop.  Shuffles: the inbound aggregates (map-side
combined), one on (node, account) for deltas, one on (account) for rating; accounts of more
than ``HOT_ROWS`` samples are split by day in both (:mod:`meterwise.functions.prefix`).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.config import RatingConfig
from meterwise.operators import metering, rating
from meterwise.session import materialize

HOT_ROWS = 1_000_000  # samples of one account that one task may still put in order


@dataclass
class MeterResult:
    """The outputs of one run.  Each step is planned when it is first asked for, since the two-level windows write
    their input: who reads only the buckets pays for no rating."""

    quarantine: DataFrame | None
    samples: DataFrame
    profiles: DataFrame | None
    stored_quota: DataFrame | None
    stored_checkpoints: DataFrame | None
    cfg: RatingConfig
    hot: DataFrame | None = None  # accounts that go through two-level windows beside plain ones for all others

    def _by_heat(self, rows: DataFrame, step: Callable[[DataFrame, RatingConfig], DataFrame]) -> DataFrame:
        """``step`` over all rows, by accounts: no account's rows depend on another's."""
        if self.hot is None:
            return step(rows, self.cfg)
        others = step(rows.join(self.hot, "account_uuid", "left_anti"), replace(self.cfg, chunk=None))
        return others.unionByName(step(rows.join(self.hot, "account_uuid", "left_semi"), self.cfg))

    @cached_property
    def deltas(self) -> DataFrame:
        return self._by_heat(self.samples, lambda x, cfg: metering.counter_deltas(x, self.stored_checkpoints, cfg))

    @cached_property
    def buckets(self) -> DataFrame:
        return metering.minute_buckets(self.deltas, self.cfg)

    @cached_property
    def rated(self) -> DataFrame:
        return self._by_heat(self.buckets, lambda x, cfg: rating.rate_buckets(x, self.profiles, self.stored_quota, cfg))

    @property
    def ledger(self) -> DataFrame:
        return rating.ledger_rows(self.rated)

    @property
    def quota_states(self) -> DataFrame:
        return rating.final_quota_states(self.rated)

    @property
    def checkpoints(self) -> DataFrame:
        return metering.latest_checkpoints(self.deltas)


def meter_samples(
    samples: DataFrame,
    profiles: DataFrame | None = None,
    quota_states: DataFrame | None = None,
    checkpoints: DataFrame | None = None,
    cfg: RatingConfig = RatingConfig(),
    quarantine: DataFrame | None = None,
) -> MeterResult:
    return MeterResult(quarantine, samples, profiles, quota_states, checkpoints, cfg)


def meter_inbound(
    inbound: DataFrame,
    profiles: DataFrame | None = None,
    quota_states: DataFrame | None = None,
    checkpoints: DataFrame | None = None,
    cfg: RatingConfig = RatingConfig(),
) -> MeterResult:
    good, bad = metering.validate_samples(inbound)
    samples = materialize(metering.aggregate_inbounds(good))
    return meter_stored(samples, profiles, quota_states, checkpoints, cfg, quarantine=bad)


def meter_stored(
    samples: DataFrame,
    profiles: DataFrame | None = None,
    quota_states: DataFrame | None = None,
    checkpoints: DataFrame | None = None,
    cfg: RatingConfig = RatingConfig(),
    quarantine: DataFrame | None = None,
) -> MeterResult:
    """:func:`meter_samples` for validated samples (no null key or time) that are written already.

    An account whose samples one task can order needs no split by day: plain windows take one shuffle and one sort for
    deltas and epochs, one for all of rating, and write no copy in between.  Only the accounts beyond ``HOT_ROWS``, of
    which there are at most one in that many rows, go through the two-level windows.
    """
    if cfg.chunk is None:
        return meter_samples(samples, profiles, quota_states, checkpoints, cfg, quarantine)
    hot = materialize(samples.groupBy("account_uuid").count().filter(F.col("count") > HOT_ROWS).select("account_uuid"))
    if hot.isEmpty():
        return meter_samples(samples, profiles, quota_states, checkpoints, replace(cfg, chunk=None), quarantine)
    return MeterResult(quarantine, samples, profiles, quota_states, checkpoints, cfg, hot)
