"""Arrears sweep cases (FIXTURES.md F16-F19)."""

from helpers import ts
from meterwise.operators.lifecycle import suspension_sweep

SCHEMA = "account_uuid string, arrears boolean, arrears_since timestamp_ntz, suspend_state string"
NOW = "2026-07-30 00:00:00"


def sweep(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r.account_uuid: r.suspend_state for r in suspension_sweep(df, NOW, 14).collect()}


def test_f16_to_f19(spark):
    got = sweep(spark, [
        ("f16", True, ts("2026-07-15 00:00:00"), "active"),
        ("exact14", True, ts("2026-07-16 00:00:00"), "active"),
        ("f17", True, ts("2026-07-27 00:00:00"), "active"),
        ("f18", True, None, "active"),
        ("f19a", False, None, "active"),
        ("f19b", False, ts("2026-06-30 00:00:00"), "suspended"),
    ])
    assert got == {"f16": "suspended", "exact14": "suspended", "f17": "active", "f18": "active",
                   "f19a": "active", "f19b": "suspended"}
