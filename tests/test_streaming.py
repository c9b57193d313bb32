"""Push ingest through Structured Streaming equals the batch job (A-T5)."""

import json
import os
import tempfile
from dataclasses import replace
from datetime import timedelta

from pyspark.sql import functions as F

from helpers import A, B, checkpoints, inbound
from meterwise.config import RatingConfig
from meterwise.plans.metering_job import meter_inbound
from meterwise.sources.snapshots import flatten, read_landing
from meterwise.streaming.ingest import MeteringBatchWriter, current_buckets, current_state, start_metering_stream, state_log
from meterwise.streaming.stateful import start_stateful_metering, stateful_result

CFG = RatingConfig(price_per_byte=0.5, included_quota_bytes=120, initial_balance=10.0, source_revision="rev")
PLAIN = replace(CFG, chunk=None)  # one window a pass: fewer jobs a micro-batch


def snap(minute, up_a, up_b):
    return {"collected_at": f"2026-07-13T10:{minute:02d}:05Z", "node_id": "jp-node", "env": "prod",
            "samples": [{"uuid": A, "uplink_bytes_total": up_a, "downlink_bytes_total": 1},
                        {"uuid": B, "uplink_bytes_total": up_b, "downlink_bytes_total": 2}]}


def test_stream_equals_batch_with_replayed_file(spark):
    root = tempfile.mkdtemp(prefix="mw-stream-")
    landing = os.path.join(root, "landing")
    os.makedirs(landing)
    files = [[snap(0, 100, 10), snap(1, 150, 20)], [snap(2, 40, 30)], [snap(1, 150, 20), snap(3, 90, 45)]]
    for i, snaps in enumerate(files):  # the third file replays minute 1
        with open(os.path.join(landing, f"f{i}.json"), "w") as fh:
            fh.write("\n".join(json.dumps(s) for s in snaps))
    out = os.path.join(root, "out")
    q = start_metering_stream(spark, landing, out, os.path.join(root, "ckpt"), cfg=CFG, max_files_per_trigger=1)
    q.awaitTermination(300)
    streamed = spark.read.parquet(os.path.join(out, "ledger")).drop("batch_id")
    batch = meter_inbound(flatten(read_landing(spark, landing)), None, None, None, CFG).ledger
    cols = sorted(batch.columns)
    assert sorted(streamed.select(cols).collect()) == sorted(batch.select(cols).collect())
    assert streamed.count() == 7  # A: minutes 0, 1, 3 (minute 2 is a reset); B: minutes 0-3


def test_one_minute_over_two_batches_and_rejects(spark):
    root = tempfile.mkdtemp(prefix="mw-stream-")
    landing = os.path.join(root, "landing")
    os.makedirs(landing)

    def line(second, up, uuid=A):
        return json.dumps({"collected_at": f"2026-07-13T10:00:{second:02d}Z", "node_id": "jp-node", "env": "prod",
                           "samples": [{"uuid": uuid, "uplink_bytes_total": up, "downlink_bytes_total": 0}]})

    files = [[line(5, 200), line(6, 1, "bad")], [line(30, 320), line(5, 200), "{broken"], [line(45, 400)]]
    for i, lines in enumerate(files):
        path = os.path.join(landing, f"f{i}.json")
        with open(path, "w") as fh:
            fh.write("\n".join(lines))
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    out = os.path.join(root, "out")
    start_metering_stream(spark, landing, out, os.path.join(root, "ckpt"), cfg=CFG, max_files_per_trigger=1).awaitTermination(300)
    ledger = spark.read.parquet(f"{out}/ledger").collect()
    state = current_state(spark, out, "quota_states").first()
    assert len({r.id for r in ledger}) == len(ledger) == 3
    assert 10.0 + sum(r.amount_delta for r in ledger) == state.current_balance == 10.0 - 280 * 0.5
    assert [r.total_bytes for r in current_buckets(spark, out).collect()] == [400]
    assert spark.read.parquet(f"{out}/late").count() == 0  # the replay is dropped before metering
    reasons = sorted(r.reject_reason for r in spark.read.parquet(f"{out}/quarantine").collect())
    assert reasons == ["malformed snapshot", "sample uuid is not a valid UUID"]


def put(landing, name, snaps, at):
    path = os.path.join(landing, name)
    with open(path, "w") as fh:
        fh.write("\n".join(json.dumps(s) for s in snaps))
    os.utime(path, (1_700_000_000 + at, 1_700_000_000 + at))


def folders():
    root = tempfile.mkdtemp(prefix="mw-stream-")
    landing = os.path.join(root, "landing")
    os.makedirs(landing)
    return landing, os.path.join(root, "out"), os.path.join(root, "ckpt")


def test_replay_leaves_no_row_old_snapshots_go_to_late_and_state_is_bounded(spark):
    landing, out, ckpt = folders()
    steady = [snap(m, 100 + 10 * m, 20 + m) for m in range(5)]
    for m in range(5):  # every file brings the last two snapshots again
        put(landing, f"f{m:02d}.json", steady[max(0, m - 2):m + 1], m)
    other = {**snap(1, 7, 7), "node_id": "late-node"}  # minutes behind, of a node that has no checkpoint
    put(landing, "f5.json", [other, snap(5, 300, 50)], 5)
    q = start_metering_stream(spark, landing, out, ckpt, cfg=PLAIN, max_files_per_trigger=1, overlap_seconds=120, compact_every=3)
    q.awaitTermination(600)
    progress = [p["stateOperators"][0] for p in q.recentProgress if p["stateOperators"]]
    assert max(p["numRowsTotal"] for p in progress) <= 5  # snapshots of twice the overlap, not of the history
    late = spark.read.parquet(f"{out}/late").collect()
    assert {(r.storage_node_id, r.late_reason) for r in late} == {("prod:late-node", "watermark")} and len(late) == 2
    ledger = spark.read.parquet(f"{out}/ledger").collect()
    assert len({r.id for r in ledger}) == len(ledger) == 2 * 6
    assert sum(r.rated_bytes for r in ledger if r.account_uuid == A) == 300 + 1 - CFG.included_quota_bytes
    log = state_log(spark, out)
    last = log.pointer(2**62)
    assert last["batch_id"] >= 5 and len(last["tables"]["checkpoints"]["deltas"]) <= 3


def test_files_read_per_batch_do_not_grow_with_history(spark):
    _, out, _ = folders()
    write = MeteringBatchWriter(out, None, PLAIN, buckets=2, compact_every=2)
    read = []
    schema = "collected_at timestamp, node_id string, env string, samples array<struct<uuid:string,email:string,inbound_tag:string,uplink_bytes_total:bigint,downlink_bytes_total:bigint>>"
    for n in range(5):
        line = json.dumps(snap(n, 100 + n, 10 + n))
        write(spark.createDataFrame([(line,)], "s string").select(F.from_json("s", schema).alias("s")).select("s.*"), n)
        read.append(len(state_log(spark, out, buckets=2, compact_every=2).read("checkpoints", n + 1).inputFiles()))
    assert max(read) <= 2 * (2 + 1)  # base and two changes, in two buckets
    state = {r.account_uuid: r for r in current_state(spark, out, "checkpoints").collect()}
    assert (state[A].last_uplink_total, state[B].last_uplink_total) == (104, 14)
    # a batch that runs again, as after a lost driver, leaves what it left before
    before = sorted(map(str, current_state(spark, out, "quota_states").collect()))
    line = json.dumps(snap(4, 104, 14))
    write(spark.createDataFrame([(line,)], "s string").select(F.from_json("s", schema).alias("s")).select("s.*"), 4)
    assert sorted(map(str, current_state(spark, out, "quota_states").collect())) == before
    assert spark.read.parquet(f"{out}/ledger").count() == 10


def keyed(rows):
    return sorted((r.storage_node_id, r.account_uuid, r.collected_at, r.uplink_total, r.delta_up, r.delta_down, r.is_first, r.is_reset, r.reset_epoch) for r in rows)


def test_stateful_metering_equals_batch_over_a_restart(spark):
    from meterwise.operators import metering

    landing, out, ckpt = folders()
    snaps = [snap(0, 100, 10), snap(1, 150, 20), snap(2, 40, 30), snap(3, 90, 45), snap(4, 95, 5), snap(5, 99, 6)]
    run = lambda: start_stateful_metering(spark, landing, out, ckpt, cfg=CFG, max_files_per_trigger=1).awaitTermination(300)
    put(landing, "f0.json", snaps[:2], 0)
    put(landing, "f1.json", [snaps[2], snaps[1]], 1)  # a reset, and a replay
    run()
    put(landing, "f2.json", snaps[3:5], 2)
    put(landing, "f3.json", [snaps[5], {**snap(3, 1, 1), "collected_at": "2026-07-13T10:04:01Z"}], 3)  # the second is before the checkpoint
    run()  # goes on from the state store
    got = stateful_result(spark, out)
    want = meter_inbound(flatten(spark.read.schema(read_landing(spark, landing).schema).json([json_file(landing, s) for s in ("f0", "f1", "f2")])), None, None, None, CFG)
    rest = got.filter("not is_late").collect()
    assert keyed(r for r in rest if r.collected_at.minute < 5) == keyed(want.deltas.filter("not is_duplicate").collect())
    assert got.filter("is_late").count() == 2
    late_free = meter_inbound(flatten(spark.createDataFrame([(json.dumps(s),) for s in snaps], "s string").select(
        F.from_json("s", read_landing(spark, landing).schema).alias("s")).select("s.*")), None, None, None, CFG)
    cols = ["bucket_start", "node_id", "account_uuid", "uplink_bytes", "downlink_bytes", "total_bytes"]
    assert sorted(metering.minute_buckets(got, CFG).select(cols).collect()) == sorted(late_free.buckets.select(cols).collect())


def json_file(landing, name):
    return os.path.join(landing, f"{name}.json")


def test_stateful_metering_starts_from_checkpoints_and_expires_silent_keys(spark):
    landing, out, ckpt = folders()
    ck = checkpoints(spark, [("prod:jp-node", A, 90, 1, "2026-07-13 09:59:00", 3), ("prod:old", A, 5, 5, "2026-07-13 09:00:00", 0)])
    put(landing, "f0.json", [snap(0, 100, 10)], 0)
    put(landing, "f1.json", [{**snap(0, 1, 1), "collected_at": "2026-07-13T12:00:00Z", "node_id": "other"}], 1)
    put(landing, "f2.json", [{**snap(0, 2, 2), "collected_at": "2026-07-13T12:01:00Z", "node_id": "other"}], 2)
    start_stateful_metering(spark, landing, out, ckpt, ck, CFG, idle=timedelta(hours=1), max_files_per_trigger=1).awaitTermination(300)
    rows = {(r.storage_node_id, r.account_uuid, r.kind, r.collected_at.minute): r for r in spark.read.parquet(out).collect()}
    first = rows[("prod:jp-node", A, "sample", 0)]
    assert (first.delta_up, first.is_first, first.reset_epoch) == (10, False, 3)
    assert rows[("prod:jp-node", B, "sample", 0)].is_first
    gone = rows[("prod:jp-node", A, "expired", 0)]
    assert (gone.uplink_total, gone.reset_epoch) == (100, 3)
    assert not [k for k in rows if k[0] == "prod:other" and k[2] == "expired"]
