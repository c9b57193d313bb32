"""Column functions against independent implementations."""

import uuid

from pyspark.sql import functions as F

from meterwise.functions.ids import uuid5_oid
from meterwise.functions.prefix import chunked_window


def test_uuid5_matches_python(spark):
    names = ["2026-07-13T10:30:00Z|prod:jp-node|11111111-1111-1111-1111-111111111111||", "", "ü|日本"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.u for r in df.select(uuid5_oid(F.col("n")).alias("u")).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_OID, n)) for n in names]


def test_two_level_window_equals_plain_on_a_hot_key(spark):
    # one key holds most rows, spread over many days
    rows = [("hot", d * 1000 + i, (d * 7 + i) % 13) for d in range(30) for i in range(40)]
    rows += [(f"k{k}", i, i % 5) for k in range(5) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, t long, v long").withColumn("day", (F.col("t") / 1000).cast("long"))
    runs = {"s_incl": (F.col("v"), "sum", "incl"), "s_excl": (F.col("v"), "sum", "excl"),
            "m_all": (F.col("v"), "max", "all"), "m_incl": (F.col("v"), "max", "incl")}
    a = chunked_window(df, ["k"], ["t"], F.col("day"), lags=["v"], runs=runs)
    b = chunked_window(df, ["k"], ["t"], None, lags=["v"], runs=runs)
    assert sorted(a.collect()) == sorted(b.collect())
