"""Stateful metering (A-T6): the last totals of each (storage node, account) live in the stream's state store.

The same rule as :func:`meterwise.operators.metering.counter_deltas`, applied as samples arrive: deltas against the
last totals, resets and their epochs, copies and late samples told apart.  State is one small row per key; it is
seeded with stored checkpoints, an event-time timer lets the rows of silent keys expire into the output, and a restart
goes on from the stream's checkpoint.  Needs the RocksDB state store (:func:`use_rocksdb`).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from meterwise.config import SOURCE_WINDOW_OVERLAP_SECONDS, RatingConfig
from meterwise.operators import metering
from meterwise.sources.snapshots import flatten
from meterwise.streaming.ingest import CORRUPT, deduplicated, landing_stream

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEYS = ["storage_node_id", "account_uuid"]
ENTRY = [*KEYS, "collected_at", "pos", "inbound_tag", "uplink_bytes_total", "downlink_bytes_total"]
OUT = ("storage_node_id string, account_uuid string, collected_at timestamp, uplink_total long, downlink_total long, delta_up long, "
       "delta_down long, is_first boolean, is_reset boolean, is_duplicate boolean, is_late boolean, reset_epoch long, kind string")
COLUMNS = [c.split()[0] for c in OUT.split(", ")]


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class CounterProcessor(StatefulProcessor):
    """Deltas of one key.  ``idle_seconds``: how long after its last sample a key's state is kept (None: for ever).

    A key whose state has expired starts anew when it returns, and its whole counter would be billed, so the time must
    exceed the longest silence of a node; the expired totals come out as a row of kind ``expired``, which belongs
    into the checkpoint table that seeds the next start.
    """

    def __init__(self, idle_seconds: int | None = None, first_sample: str = "full"):
        self.idle = idle_seconds
        self.first_sample = first_sample

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "seen_us long, up long, down long, epoch long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        self._keep(int(r["seen_us"]), int(r["up"]), int(r["down"]), int(r["epoch"]))

    def _keep(self, seen_us: int, up: int, down: int, epoch: int) -> None:
        self.last.update((seen_us, up, down, epoch))
        if self.idle is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(seen_us // 1000 + self.idle * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        entries = pd.concat(list(rows), ignore_index=True)
        entries["inbound_tag"] = entries["inbound_tag"].fillna("")
        once = entries.groupby(["collected_at", "pos", "inbound_tag"], as_index=False)[["uplink_bytes_total", "downlink_bytes_total"]].max()
        df = once.groupby("collected_at", as_index=False)[["uplink_bytes_total", "downlink_bytes_total"]].sum()
        df.columns = ["collected_at", "uplink_total", "downlink_total"]
        df = df.sort_values(["collected_at", "uplink_total", "downlink_total"], ignore_index=True)
        us = (df["collected_at"].astype("datetime64[us]")).astype("int64")
        state = self.last.get() if self.last.exists() else None
        late = pd.Series(False, index=df.index)
        if state is not None:
            late = pd.Series([(int(t), int(u), int(d)) <= tuple(state[:3]) for t, u, d in zip(us, df["uplink_total"], df["downlink_total"])], index=df.index)
        prev = df[["uplink_total", "downlink_total"]].shift(1)
        fresh = df.index[~late]
        if len(fresh):
            first = fresh[0]
            prev.loc[first] = [state[1], state[2]] if state is not None else [0, 0]
        prev = prev.fillna(0).astype("int64")
        up, down = df["uplink_total"] - prev["uplink_total"], df["downlink_total"] - prev["downlink_total"]
        df["is_first"] = False
        if state is None and len(fresh):
            df.loc[fresh[0], "is_first"] = True
            if self.first_sample == "baseline":
                up.loc[fresh[0]] = down.loc[fresh[0]] = 0
        df["is_late"] = late
        df["is_reset"] = ((up < 0) | (down < 0)) & ~late
        df["is_duplicate"] = False
        df["delta_up"], df["delta_down"] = up.where(~late, 0), down.where(~late, 0)
        epoch = state[3] if state is not None else 0
        df["reset_epoch"] = epoch + df["is_reset"].astype("int64").cumsum()
        if len(fresh):
            end = df.loc[fresh[-1]]
            self._keep(int(us.loc[fresh[-1]]), int(end["uplink_total"]), int(end["downlink_total"]), int(end["reset_epoch"]))
        df["storage_node_id"], df["account_uuid"], df["kind"] = key[0], key[1], "sample"
        yield df[COLUMNS]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.last.exists():
            return
        seen_us, up, down, epoch = self.last.get()
        self.last.clear()
        row = {"storage_node_id": key[0], "account_uuid": key[1], "collected_at": pd.Timestamp(seen_us, unit="us"), "uplink_total": up, "downlink_total": down,
               "delta_up": 0, "delta_down": 0, "is_first": False, "is_reset": False, "is_duplicate": False, "is_late": False, "reset_epoch": epoch, "kind": "expired"}
        yield pd.DataFrame([row])[COLUMNS]

    def close(self) -> None:
        pass


def entries_of(snapshots: DataFrame) -> DataFrame:
    """Valid inbound entries under their storage node and canonical account, with the event time kept as a timestamp."""
    from meterwise.functions.text import storage_node_id

    good, _ = metering.validate_samples(flatten(snapshots, keep=()))
    return good.select(storage_node_id(F.col("env"), F.col("node_id")).alias("storage_node_id"), "account_uuid",
                       F.col("collected_at").cast("timestamp").alias("collected_at"), "pos", "inbound_tag", "uplink_bytes_total", "downlink_bytes_total")


def seeds_of(checkpoints: DataFrame):
    """Stored checkpoints as the initial state."""
    return checkpoints.select(F.col("node_id").alias("storage_node_id"), "account_uuid", F.unix_micros(F.col("last_seen_at").cast("timestamp")).alias("seen_us"),
                              F.col("last_uplink_total").alias("up"), F.col("last_downlink_total").alias("down"),
                              F.coalesce("reset_epoch", F.lit(0)).cast("long").alias("epoch")).groupBy(*KEYS)


def stateful_deltas(entries: DataFrame, checkpoints: DataFrame | None = None, idle: timedelta | None = None, cfg: RatingConfig = RatingConfig()) -> DataFrame:
    """Deltas of a stream of entries (with a watermark on ``collected_at`` where keys expire)."""
    processor = CounterProcessor(None if idle is None else int(idle.total_seconds()), cfg.first_sample)
    return entries.select(*ENTRY).groupBy(*KEYS).transformWithStateInPandas(
        processor, outputStructType=OUT, outputMode="Append", timeMode="None" if idle is None else "EventTime",
        initialState=None if checkpoints is None else seeds_of(checkpoints))


def start_stateful_metering(
    spark: SparkSession,
    landing_dir: str,
    out_dir: str,
    checkpoint_location: str,
    checkpoints: DataFrame | None = None,
    cfg: RatingConfig = RatingConfig(),
    idle: timedelta | None = None,
    max_files_per_trigger: int | None = None,
    overlap_seconds: int = SOURCE_WINDOW_OVERLAP_SECONDS,
    available_now: bool = True,
):
    """Landing JSON -> de-duplication within the watermark -> keyed state -> ``out_dir`` (Parquet, exactly once)."""
    use_rocksdb(spark)
    snapshots = landing_stream(spark, landing_dir, max_files_per_trigger)
    snapshots = deduplicated(snapshots.filter(F.col(CORRUPT).isNull() & F.col("collected_at").isNotNull()).drop(CORRUPT), overlap_seconds)
    out = stateful_deltas(entries_of(snapshots), checkpoints, idle, cfg)
    writer = out.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint_location).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="60 seconds")).start()


def stateful_result(spark: SparkSession, out_dir: str) -> DataFrame:
    """The samples written so far, as ``counter_deltas`` gives them; ``minute_buckets`` takes them as they are."""
    rows = spark.read.parquet(out_dir).filter(F.col("kind") == "sample").drop("kind")
    rows = rows.withColumn("collected_at", F.col("collected_at").cast("timestamp_ntz"))
    return rows.withColumn("billable", ~F.col("is_reset") & ~F.col("is_duplicate") & ~F.col("is_late"))
