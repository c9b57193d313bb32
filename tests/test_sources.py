"""Body decoding, excerpt and registry cases (FIXTURES.md F20-F24)."""

import json

from pyspark.sql import functions as F

from helpers import A
from meterwise.sources import fixtures
from meterwise.sources.snapshots import decode_bodies, load_registry

SNAP = {"collected_at": "2026-07-13T10:30:15Z", "node_id": "jp-node", "env": "prod",
        "samples": [{"uuid": A, "email": "", "inbound_tag": "xhttp", "uplink_bytes_total": 100, "downlink_bytes_total": 50},
                    {"uuid": A, "email": "", "inbound_tag": "tcp", "uplink_bytes_total": 30, "downlink_bytes_total": 20}]}


def bodies(spark, items):
    return spark.createDataFrame(list(enumerate(items)), "body_id int, body string")


def test_f20_f21_framings(spark):
    one = json.dumps(SNAP)
    extra = json.dumps({**SNAP, "unknown": 1})
    items = [one, "[" + one + "]", "[" + one + "," + one + "]", one + "\n" + one, extra, one + one]
    good, bad = decode_bodies(bodies(spark, items))
    counts = {r.body_id: r["count"] for r in good.groupBy("body_id").count().collect()}
    assert counts == {0: 1, 1: 1, 2: 2, 3: 2, 4: 1, 5: 2} and bad.count() == 0
    s = good.filter("body_id = 1").select(F.size("samples").alias("n"), F.col("samples")[0]["uplink_bytes_total"].alias("u")).first()
    assert (s.n, s.u) == (2, 100)


def test_f22_rejects(spark):
    items = ["", "   ", "[]", '{"collected_at":', '"just-a-string"']
    good, bad = decode_bodies(bodies(spark, items))
    reasons = {r.body_id: r.reason for r in bad.collect()}
    assert good.count() == 0 and len(reasons) == 5
    assert reasons[0] == reasons[1] == "empty body" and reasons[2] == "empty snapshot array"


def test_f23_excerpt_bound(spark):
    good, bad = decode_bodies(bodies(spark, ["x" * 500]))
    e = bad.first().excerpt
    assert len(e) <= 130 and e.endswith("...")


def test_f24_registry(spark):
    text = json.dumps([{"source_id": " s1 ", "base_url": "http://h:1/ ", "expected_node_id": "jp-node", "timeout_seconds": 0}])
    cfg = spark.createDataFrame([(text, None), (None, "http://legacy/")], "sources_json string, legacy string")
    ok, err = load_registry(cfg, legacy_url_col="legacy")
    rows = sorted(ok.collect(), key=lambda r: r.source_id)
    assert [(r.source_id, r.base_url, r.enabled, r.timeout_seconds) for r in rows] == [
        ("default", "http://legacy", True, 15), ("s1", "http://h:1", True, 15)]
    assert err.count() == 0


def test_text_counter_in_an_array_rejects_the_body(spark):
    bad_snap = json.dumps(SNAP).replace("100", '"abc"')
    good, bad = decode_bodies(bodies(spark, ["[" + bad_snap + "]", "[" + json.dumps(SNAP) + "," + bad_snap + "]"]))
    assert good.count() == 0 and [r.reason for r in bad.collect()] == ["malformed snapshot"] * 2


def test_braces_and_quotes_inside_strings_do_not_split(spark):
    odd = dict(SNAP, samples=[dict(SNAP["samples"][0], email='a} {b"} {\\')])
    one = json.dumps(odd)
    good, bad = decode_bodies(bodies(spark, [one, one + " " + one + "\n" + one]))
    assert bad.count() == 0 and good.count() == 4
    assert {r.e for r in good.select(F.col("samples")[0]["email"].alias("e")).collect()} == {'a} {b"} {\\'}


def test_a_body_is_trimmed_cut_and_parsed_once(spark):
    good, bad = decode_bodies(bodies(spark, [json.dumps(SNAP), "[" + json.dumps(SNAP) + "]", "{", ""]))
    assert sorted(r.body_id for r in good.collect()) == [0, 1] and sorted(r.body_id for r in bad.collect()) == [2, 3]
    for df in (good, bad):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(") == 2 and plan.count("trim(body") == 1  # an array's elements, and a piece


def test_both_inbound_entries_come_from_one_read(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i % 3} 00:00:00", i % 2, 1.5 * i, '{"k": %d}' % i) for i in range(1, 99)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, value double, props string").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    df = fixtures.inbound(spark, str(tmp_path))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    got = df.collect()
    assert len(got) == 196 and [r.uuid for r in got if r.event_id == 97 and r.pos == 1] == ["not-a-uuid"]
