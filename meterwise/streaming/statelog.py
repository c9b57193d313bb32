"""Keyed tables that a stream carries from one micro-batch to the next, as a log of changes with compaction.

Every micro-batch writes only the rows that it changed (``kind=delta/version=N``).  After ``compact_every`` of these
the table's latest rows are written once as a whole (``kind=base/version=N``).  A *pointer*, written last, names the
base and the changes that count after a batch; what no pointer names is not read, so a batch that failed half way
leaves nothing behind, and one that is run again starts from the pointer before it and overwrites its own files.

Reading takes the base and at most ``compact_every`` changes, however long the stream has run, and of these only the
hash buckets of the keys that the batch touches.  All paths are expected on shared storage.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from meterwise.operators.upsert import latest_per_key


class StateLog:
    """The tables under ``root``; ``keys`` gives each table's key columns."""

    def __init__(self, spark: SparkSession, root: str, keys: dict[str, Sequence[str]], buckets: int = 8, compact_every: int = 16):
        self.spark = spark
        self.root = root.rstrip("/")
        self.keys = {name: list(k) for name, k in keys.items()}
        self.buckets = buckets
        self.compact_every = compact_every
        self._written: dict[str, str] = {}
        self._pointers: dict[int, str] = {}  # of the batch at work

    def _bucket(self, name: str, buckets: int):
        return F.pmod(F.xxhash64(*self.keys[name]), F.lit(buckets)).cast("int")

    def pointer(self, before_batch: int) -> dict:
        """What counts after the last committed batch before ``before_batch``.

        Batches follow one another, so that is one file by its name; only the first batch of a new query over an older
        folder looks for it.
        """
        try:
            found = self.spark.read.text(f"{self.root}/commits/{before_batch - 1}", wholetext=True).first()
            return json.loads(found[0])
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
        try:
            lines = self.spark.read.text(f"{self.root}/commits/*", wholetext=True)
            batch = F.get_json_object("value", "$.batch_id").cast("long")
            found = lines.where(batch < before_batch).agg(F.max_by("value", batch)).first()[0]
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            found = None
        return json.loads(found) if found else {"batch_id": None, "buckets": self.buckets, "tables": {}}

    def read(self, name: str, before_batch: int, touched: DataFrame | None = None) -> DataFrame | None:
        """The latest row of each key; with ``touched`` (rows that hold the key columns) of those keys alone.
        None if the table has never been written."""
        at = self.pointer(before_batch)
        table = at["tables"].get(name)
        if table is None:
            return None
        rows = self._rows(name, table)
        if touched is not None:
            wanted = touched.select(*self.keys[name]).distinct()
            hit = [r[0] for r in wanted.select(self._bucket(name, at["buckets"])).distinct().collect()]  # at most ``buckets``
            rows = rows.where(F.col("bucket").isin(hit)).join(wanted, self.keys[name], "left_semi")
        return self._latest(name, rows)

    def _rows(self, name: str, table: dict) -> DataFrame:
        base = f"{self.root}/{name}"
        paths = [f"{base}/kind=delta/version={n}" for n in table["deltas"]]
        if table["base"] is not None:
            paths.append(f"{base}/kind=base/version={table['base']}")
        schema = StructType.fromJson(table["schema"]).add("version", "long").add("bucket", "integer")
        return self.spark.read.schema(schema).option("basePath", base).parquet(*paths)

    def _latest(self, name: str, rows: DataFrame) -> DataFrame:
        return latest_per_key(rows.drop("bucket", "kind"), self.keys[name], ["version"]).drop("version")

    def write(self, name: str, rows: DataFrame, batch_id: int) -> None:
        """The rows that batch ``batch_id`` changed, one for each key.  They count once the batch is committed."""
        buckets = self.pointer(batch_id)["buckets"]
        (rows.withColumn("bucket", self._bucket(name, buckets)).repartition(buckets, "bucket")
         .write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{name}/kind=delta/version={batch_id}"))
        self._written[name] = rows.schema.json()

    def commit(self, batch_id: int, **extra) -> None:
        """Makes what was written count; ``extra`` is kept in the pointer."""
        at = self.pointer(batch_id)
        tables = at["tables"]
        for name, schema in self._written.items():
            table = tables.setdefault(name, {"schema": None, "base": None, "deltas": []})
            table["schema"] = json.loads(schema)
            table["deltas"].append(batch_id)
            if len(table["deltas"]) > self.compact_every:
                whole = self._latest(name, self._rows(name, table))
                (whole.withColumn("bucket", self._bucket(name, at["buckets"])).repartition(at["buckets"], "bucket")
                 .write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{name}/kind=base/version={batch_id}"))
                table["base"], table["deltas"] = batch_id, []
        line = json.dumps({**at, **extra, "batch_id": batch_id, "tables": tables})
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/commits/{batch_id}")
        self._written, self._pointers = {}, {}
