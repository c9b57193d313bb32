"""Sharding by sampled splitters: shards of nearly equal bytes that are ranges of one key order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .line_dedup import NO_ID
from .scratch import cut

RANGES_PER_SHARD = 8  # ranges the splitters aim at, for each shard
DRAWS_PER_RANGE = 32  # expected key samples for each range: 40 shards bring about 10,000 keys to the driver
ROUNDS = 6  # of subdividing
SLACK = 20  # a group of equal texts of at most this part (1/20) of a mean shard is never cut


def _packed(*parts: np.ndarray) -> np.ndarray:
    """(key, id, row) as 24 bytes that sort as the three longs do."""
    both = np.empty((len(parts[0]), len(parts)), ">u8")
    for i, part in enumerate(parts):
        both[:, i] = part.view(np.uint64) ^ np.uint64(1 << 63)
    return both.reshape(-1).view(f"S{8 * len(parts)}")


def _to_range(bounds: np.ndarray):
    def run(batches):
        for batch in batches:
            key = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            at = np.searchsorted(bounds, _packed(*key), side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), *batch.columns], ["range", *batch.schema.names])
    return run


def _draw(rows: DataFrame, per_byte: float, salt: int) -> list:
    """Keys drawn by size: a row comes with probability size * per_byte (1 at most), by a hash and so repeatably.
    Every row has a key of its own, so repeated rows are drawn one by one, and the draws are total * per_byte at most
    (expected)."""
    luck = F.pmod(F.xxhash64("k", "did", "u", F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    return rows.where(luck < F.col("size") * per_byte).select("k", "did", "u", "size").collect()


def _splitters(drawn: list, per_byte: float, ranges: int) -> np.ndarray:
    """Weighted quantiles of the drawn keys."""
    if not drawn:
        return np.zeros(0, "S24")
    key = _packed(*(np.array([r[i] for r in drawn], np.int64) for i in range(3)))
    weight = np.maximum(np.array([r[3] for r in drawn], float), 1 / per_byte)
    order = np.argsort(key, kind="stable")
    share = np.cumsum(weight[order]) / weight.sum()
    at = np.searchsorted(share, np.arange(1, ranges) / ranges)
    return np.unique(key[order][np.minimum(at, len(key) - 1)])


def shard_by_bytes(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text",
                   overhead: int = 16) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``, one row for each row of ``docs``.

    Key order: the text's hash, then the id, then the row, so equal texts lie side by side.  Splitters are
    size-weighted quantiles of drawn keys; records are range-partitioned by them, and ranges that turn out overfull
    are drawn from again and subdivided, so a text that a third of all rows share is split by id, and one row that
    repeats as often is split by row.  Exact bytes of the ranges then place each shard's end: a record goes to the
    shard in which the middle of its bytes lies.  A group of equal texts that an end would cut goes whole to the shard
    in which its own middle lies, if it has at most 1/``SLACK`` of a mean shard; only larger groups are cut.  So any
    shard is within that part of a mean shard, or one record's size if that is more, of the mean.

    Size: UTF-8 bytes of the text (null: none) plus ``overhead``.  A null text is an empty one and has the checksum of
    no bytes; a null id sorts last.  Repeated rows are placed one after the other, and equal rows may swap places when
    the query runs again.  A very long text is one record and is never cut; other columns are not read, whatever their
    names.  An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    given = F.col(id_col).cast("long")
    rows = cut(docs.select(
        F.xxhash64(text).alias("k"), F.coalesce(given, F.lit(NO_ID)).alias("did"), F.monotonically_increasing_id().alias("u"),
        (F.octet_length(text).cast("long") + overhead).alias("size"), F.crc32(text.cast("binary")).cast("long").alias("crc"), given.alias("doc_id")))
    schema = "range int, k long, did long, u long, size long, crc long, doc_id long"
    total = rows.agg(F.sum("size")).first()[0] or 0
    ranges = shards * RANGES_PER_SHARD
    per_byte = ranges * DRAWS_PER_RANGE / max(1, total)
    bounds = _splitters(_draw(rows, per_byte, 0), per_byte, ranges)
    for again in range(1, ROUNDS + 1):
        placed = rows.mapInArrow(_to_range(bounds), schema)
        sizes = sorted(placed.groupBy("range").agg(F.sum("size"), F.count(F.lit(1)), F.max("size")).collect())
        over = [r[0] for r in sizes if r[1] > 2 * total / ranges and r[2] > 1 and r[1] > 2 * r[3]]
        if not over or again == ROUNDS:
            break
        drawn = _draw(placed.where(F.col("range").isin(over)), 4 * per_byte, again)
        more = _splitters(drawn, 4 * per_byte, 4 * len(over) + 1)
        new = np.union1d(bounds, more)
        if len(new) == len(bounds):
            break
        bounds = new
    base, b, n = [], 0, 0
    for r in sizes:
        base.append((r[0], b, n))
        b, n = b + r[1], n + r[2]
    starts = docs.sparkSession.createDataFrame(base or [(0, 0, 0)], "range int, bytes_before long, rows_before long")
    order = Window.partitionBy("range").orderBy("k", "did", "u")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = placed.join(starts, "range").select(
        "k", "doc_id", "size", "crc",
        (F.col("rows_before") + F.row_number().over(order) - 1).alias("row"),
        (F.col("bytes_before") + F.sum("size").over(running)).alias("end"))
    found = cut(found.withColumn("shard", _shard_at(2 * F.col("end") - F.col("size"), shards, total)))
    whole = _kept_whole(found, shards, total)
    moved = F.coalesce(*[F.when(F.col("k") == k, s) for k, s in whole.items()], F.col("shard")) if whole else F.col("shard")
    found = found.withColumn("shard", moved)
    first = found.groupBy("shard").agg(F.min("row").alias("first"))
    return found.join(F.broadcast(first), "shard").select(
        "doc_id", "size", F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _shard_at(twice, shards: int, total: int):
    """The shard that holds a byte, given as twice its position."""
    at = F.floor(twice.cast("decimal(38,0)") * shards / F.lit(2 * max(1, total)).cast("decimal(38,0)"))
    return F.least(F.lit(shards - 1), at).cast("int")


def _kept_whole(found: DataFrame, shards: int, total: int) -> dict[int, int]:
    """``{text hash: shard}`` of the groups that a shard's end cuts and that are small enough to stay whole.

    Groups are ranges of the order, so only the last key of a shard can go on in the next one: at most
    ``shards - 1`` keys, found from one row a shard.
    """
    ends = found.groupBy("shard").agg(F.min_by("k", "row"), F.max_by("k", "row")).sort("shard").collect()
    keys = sorted({a[2] for a, b in zip(ends, ends[1:]) if a[2] == b[1]})
    if not keys:
        return {}
    groups = found.where(F.col("k").isin(keys)).groupBy("k").agg(F.sum("size").alias("bytes"), F.max("end").alias("end"))
    small = groups.where(F.col("bytes") * SLACK * shards <= total)
    return {r[0]: r[1] for r in small.select("k", _shard_at(2 * F.col("end") - F.col("bytes"), shards, total)).collect()}


def write_shards(docs: DataFrame, path: str, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes ``docs`` under ``path``, one folder for each shard."""
    where = shard_by_bytes(docs, shards, id_col, text_col).select(F.col("doc_id").alias("sd"), F.col("text_crc32").alias("sc"), "shard").groupBy("sd", "sc").agg(F.min("shard").alias("shard"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    same = F.col(id_col).eqNullSafe(F.col("sd")) & (F.crc32(text.cast("binary")).cast("long") == F.col("sc"))
    docs.join(where, same).drop("sd", "sc").write.partitionBy("shard").parquet(path)
