from datetime import datetime

from pyspark.sql import functions as F

A = "11111111-1111-1111-1111-111111111111"
B = "22222222-2222-2222-2222-222222222222"
INBOUND = ("collected_at timestamp_ntz, node_id string, env string, pos int, uuid string, email string, "
           "inbound_tag string, uplink_bytes_total bigint, downlink_bytes_total bigint")
CHECKPOINT = ("node_id string, account_uuid string, last_uplink_total bigint, last_downlink_total bigint, "
              "last_seen_at timestamp_ntz, reset_epoch bigint")


def ts(s):
    return datetime.fromisoformat(s)


def inbound(spark, rows):
    """rows: (time, node, env, [(uuid, email, tag, up, down), ...])"""
    flat = []
    for t, node, env, samples in rows:
        for pos, (u, e, tag, up, down) in enumerate(samples):
            flat.append((ts(t), node, env, pos, u, e, tag, up, down))
    return spark.createDataFrame(flat, INBOUND)


def checkpoints(spark, rows):
    return spark.createDataFrame([(n, a, up, dn, ts(t), ep) for n, a, up, dn, t, ep in rows], CHECKPOINT)
