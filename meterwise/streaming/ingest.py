"""Push ingest as Structured Streaming (A-T5): landing JSON -> de-duplication -> foreachBatch(meter and rate).

Snapshots that arrive again within the overlap are dropped by the stream itself (A-T4: event-time watermark and
``dropDuplicatesWithinWatermark``, whose state does not grow with history).  Each micro-batch then runs the batch
operators of :mod:`meterwise.plans.metering_job`, seeded with the state that earlier batches left, and writes:

* ``rated/batch_id=N`` -- the rated minutes, from which the ledger, buckets and quota rows are read;
* ``ledger/batch_id=N`` -- ledger rows.  Replayed samples give none.  More usage of a minute that an earlier batch
  has charged gets a row of its own, under an id made from the minute's id and the batch, so
  seed + sum(ledger) = balance;
* ``buckets/batch_id=N`` -- the batch's share of its minute buckets (:func:`current_buckets` adds them up);
* ``quarantine/batch_id=N`` -- rejected entries and lines that are no JSON, with the reason;
* ``late/batch_id=N`` -- samples of snapshots older than the watermark, and samples at or before their checkpoint;
* ``state/`` -- checkpoints and quota rows, as a :class:`~meterwise.streaming.statelog.StateLog`: a batch writes the
  rows that it changed and reads those of the keys that it touches.

Every output is a partition named by the micro-batch id and written with overwrite, so a retried batch replaces
exactly its own files (the batch id is the retry unit); the state's pointer is written last.  The stream's own
progress lives in ``checkpointLocation``; all paths are expected on shared storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterwise.config import REJECT_EXCERPT_LIMIT, SOURCE_WINDOW_OVERLAP_SECONDS, RatingConfig
from meterwise.functions.ids import uuid5_oid
from meterwise.functions.text import excerpt
from meterwise.operators import metering, rating
from meterwise.plans.metering_job import meter_samples
from meterwise.session import materialize
from meterwise.sources.snapshots import REASON_MALFORMED, SNAPSHOT_SCHEMA, flatten
from meterwise.streaming.statelog import StateLog

CORRUPT = "_corrupt_record"
ROUTE = "__route"  # "kept": passed the stream's de-duplication; "raw": as it arrived
STATE_KEYS = {"checkpoints": ["node_id", "account_uuid"], "quota_states": ["account_uuid"]}


def state_log(spark: SparkSession, out_dir: str, **options) -> StateLog:
    return StateLog(spark, f"{out_dir.rstrip('/')}/state", STATE_KEYS, **options)


def current_state(spark: SparkSession, out_dir: str, name: str) -> DataFrame | None:
    """The state table ``name`` after the last committed batch."""
    return state_log(spark, out_dir).read(name, 2**62)


def current_buckets(spark: SparkSession, root: str) -> DataFrame:
    """The minute buckets of all batches: one row per bucket key."""
    rows = spark.read.parquet(f"{root}/buckets")
    sums = [F.sum(c).cast("long").alias(c) for c in ("uplink_bytes", "downlink_bytes", "total_bytes")]
    last = [F.max_by(c, "batch_id").alias(c) for c in ("multiplier", "rating_status", "source_revision")]
    return rows.groupBy(*rating.BUCKET_KEY).agg(*sums, *last)


class MeteringBatchWriter:
    """``foreachBatch`` function: meter, rate and persist one micro-batch."""

    def __init__(self, out_dir: str, profiles: DataFrame | None = None, cfg: RatingConfig = RatingConfig(),
                 overlap_seconds: int = SOURCE_WINDOW_OVERLAP_SECONDS, buckets: int = 8, compact_every: int = 16):
        self.out = out_dir.rstrip("/")
        self.profiles = profiles
        self.cfg = cfg
        self.overlap = overlap_seconds
        self.options = {"buckets": buckets, "compact_every": compact_every}

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        log = state_log(spark, self.out, **self.options)
        mark = log.pointer(batch_id).get("watermark_us")
        if ROUTE in batch.columns:
            batch = materialize(batch)
            raw = batch.filter(F.col(ROUTE) == "raw").drop(ROUTE)
            kept = batch.filter(F.col(ROUTE) == "kept").drop(ROUTE)
        else:  # without the stream's de-duplication
            raw = kept = batch
        if CORRUPT not in raw.columns:
            raw, kept = (x.withColumn(CORRUPT, F.lit(None).cast("string")) for x in (raw, kept))
        well = F.col(CORRUPT).isNull()

        refused, _ = _split(flatten(raw.filter(well).drop(CORRUPT)))
        rejects = refused.select(
            "collected_at", "node_id", "env", "pos", "uuid", "reject_reason", F.lit(None).cast("string").alias("excerpt")
        ).unionByName(raw.filter(~well).select(
            F.col("collected_at").cast("timestamp_ntz").alias("collected_at"), "node_id", "env",
            F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("uuid"),
            F.lit(REASON_MALFORMED).alias("reject_reason"), excerpt(F.col(CORRUPT), REJECT_EXCERPT_LIMIT).alias("excerpt"),
        ))
        self._write(rejects, "quarantine", batch_id)

        _, good = _split(flatten(kept.filter(well).drop(CORRUPT)))
        samples = materialize(metering.aggregate_inbounds(good))
        nodes = samples.select(F.col("storage_node_id").alias("node_id"), "account_uuid")
        ck = log.read("checkpoints", batch_id, touched=nodes)
        qs = log.read("quota_states", batch_id, touched=samples)
        seeds = ck.drop("last_charged_at") if ck is not None else None
        r = meter_samples(samples, self.profiles, qs, seeds, self.cfg)

        late = r.deltas.filter("is_late").select(*samples.columns, F.lit("checkpoint").alias("late_reason"))
        if mark is not None and ROUTE in batch.columns:  # the stream dropped what is not after its watermark
            old = raw.filter(well & (F.unix_micros("collected_at") <= mark)).drop(CORRUPT)
            _, old = _split(flatten(old))
            late = late.unionByName(metering.aggregate_inbounds(old).select(*samples.columns, F.lit("watermark").alias("late_reason")))
        self._write(late, "late", batch_id)

        rated = self._write(r.rated, "rated", batch_id)
        ledger = rating.ledger_rows(rated)
        if ck is not None:
            charged = ck.select("node_id", "account_uuid", F.col("last_charged_at").alias("charged_at"))
            before = rated.select("id", "node_id", "account_uuid").join(charged, ["node_id", "account_uuid"]).select("id", "charged_at")
            again = uuid5_oid(F.concat_ws("|", "id", F.lit(str(batch_id))))
            own = F.when(F.col("bucket_start") <= F.col("charged_at"), again).otherwise(F.col("id"))
            ledger = ledger.join(before, "id", "left").withColumn("id", own).drop("charged_at")
        self._write(ledger, "ledger", batch_id)
        self._write(rating.bucket_rows(rated), "buckets", batch_id)

        charges = rated.groupBy("node_id", "account_uuid").agg(F.max("bucket_start").alias("new_charged"))
        new_ck = r.checkpoints.join(charges, ["node_id", "account_uuid"], "left")
        if ck is not None:
            new_ck = new_ck.join(ck.select("node_id", "account_uuid", F.col("last_charged_at").alias("old_charged")), ["node_id", "account_uuid"], "left")
        else:
            new_ck = new_ck.withColumn("old_charged", F.lit(None).cast("timestamp_ntz"))
        new_ck = new_ck.withColumn("last_charged_at", F.coalesce("new_charged", "old_charged")).drop("new_charged", "old_charged")
        log.write("checkpoints", new_ck, batch_id)
        log.write("quota_states", rating.final_quota_states(rated), batch_id)
        newest = raw.filter(well).agg(F.max(F.unix_micros("collected_at"))).first()[0]  # one scalar
        marks = [m for m in (mark, None if newest is None else newest - self.overlap * 1_000_000) if m is not None]
        log.commit(batch_id, watermark_us=max(marks) if marks else None)

    def _write(self, df: DataFrame, name: str, batch_id: int) -> DataFrame:
        path = f"{self.out}/{name}/batch_id={batch_id}"
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.parquet(path)


def _split(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    good, bad = metering.validate_samples(entries)
    return bad, good


def deduplicated(snapshots: DataFrame, overlap_seconds: int = SOURCE_WINDOW_OVERLAP_SECONDS) -> DataFrame:
    """A-T4 in a stream: snapshots whose equal came within the overlap are dropped, and so are those that are older
    than the newest one by more than the overlap.  The state holds the snapshots of twice the overlap at most."""
    seen = snapshots.withColumn("__body", F.xxhash64(F.to_json("samples"))).withColumn("__body2", F.xxhash64(F.lit(1), F.to_json("samples")))
    return (seen.withWatermark("collected_at", f"{overlap_seconds} seconds")
            .dropDuplicatesWithinWatermark(["collected_at", "node_id", "env", "__body", "__body2"]).drop("__body", "__body2"))


def landing_stream(spark: SparkSession, landing_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Snapshots of a landing folder; a line that is no JSON has only its text in ``CORRUPT``."""
    reader = spark.readStream.schema(T.StructType([*SNAPSHOT_SCHEMA.fields, T.StructField(CORRUPT, T.StringType())]))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return reader.json(landing_dir)


def start_metering_stream(
    spark: SparkSession,
    landing_dir: str,
    out_dir: str,
    checkpoint_location: str,
    profiles: DataFrame | None = None,
    cfg: RatingConfig = RatingConfig(),
    max_files_per_trigger: int | None = None,
    available_now: bool = True,
    overlap_seconds: int = SOURCE_WINDOW_OVERLAP_SECONDS,
    compact_every: int = 16,
):
    """Start the ingest stream over a landing folder of snapshot JSON files.

    A micro-batch holds each snapshot as it arrived and, if the de-duplication lets it pass, once more: so nothing that
    the watermark drops is lost from sight.
    """
    raw = landing_stream(spark, landing_dir, max_files_per_trigger)
    valid = raw.filter(F.col(CORRUPT).isNull() & F.col("collected_at").isNotNull())
    stream = deduplicated(valid, overlap_seconds).withColumn(ROUTE, F.lit("kept")).unionByName(raw.withColumn(ROUTE, F.lit("raw")))
    writer = stream.writeStream.foreachBatch(
        MeteringBatchWriter(out_dir, profiles, cfg, overlap_seconds, compact_every=compact_every)
    ).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="60 seconds")
    return writer.start()
