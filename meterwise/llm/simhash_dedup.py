"""SimHash near-dedup: fingerprints of word shingles, near ones found with vantage-point trees."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .components import connected_components, local_forest
from .scratch import cut
from .words import give_back

LEAF = 2048  # fingerprints a leaf of the tree should own
MAX_LEVELS = 14  # of the driver's tree; larger leaves are compared in blocks
SAMPLE_PER_LEAF = 16  # fingerprints drawn for each leaf: at most 16 * 2^14 come to the driver
BLOCK = 8192  # owned fingerprints that one group compares with all its queries
CHUNK = 1 << 15  # shingles hashed at once


def _fingerprint(text: bytes, shingle: int) -> int:
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    n = max(1, len(words) - shingle + 1)
    stops = ends[min(shingle, len(words)) - 1:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for a in range(0, n, CHUNK):
        h = np.array([digest(line[i:j], 42) for i, j in zip(starts[a:min(n, a + CHUNK)], stops[a:a + CHUNK])], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def simhash(text: Column, shingle: int = 3) -> Column:
    """64-bit fingerprint (long): a bit is 1 if over half of the text's shingles' XXH64 (seed 42) set it.

    A-Z lower-cased; words split at space and U+0009 to U+000D; repeats count.  Fewer words than ``shingle``: the
    whole sequence is one shingle; none, or a null text: 0.
    """
    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        out = pa.array([_fingerprint(t.as_py() or b"", shingle) for t in texts.cast(pa.binary())], pa.int64())
        give_back()
        return out

    return of(text)


def _build(sample: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and radii of a full tree, in heap order: inside (distance <= radius) is the left child."""
    points, radii = np.zeros((1 << levels) - 1, np.uint64), np.zeros((1 << levels) - 1, np.int64)
    held = {0: sample}
    for node in range(len(points)):
        own = held.pop(node)
        if len(own):
            spread = own[np.linspace(0, len(own) - 1, min(len(own), 8)).astype(int)]
            away = np.bitwise_count(spread[:, None] ^ own[None, :]).astype(np.int64)
            best = int(np.argmax(away.std(axis=1)))  # the candidate that tells its points apart best
            points[node], radii[node] = spread[best], int(np.median(away[best]))
            inside = away[best] <= radii[node]
        else:
            inside = np.zeros(0, bool)
        if 2 * node + 1 < len(points):
            held[2 * node + 1], held[2 * node + 2] = own[inside], own[~inside]
    return points, radii


def _route(points: np.ndarray, radii: np.ndarray, levels: int, near: int):
    """Rows (leaf, fp, own): the leaf that owns a fingerprint, and the leaves it must query beyond a boundary."""
    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            node, own = np.zeros(len(fp), np.int64), np.ones(len(fp), bool)
            for _ in range(levels):
                away = np.bitwise_count(fp ^ points[node]).astype(np.int64)
                r = radii[node]
                inside = away <= r
                # Of two near fingerprints on both sides, the outer one queries the inner side; a guest, whose
                # partner may be on either side, goes wherever the triangle bound lets one be.
                left = np.where(own, inside, away <= r + near)
                right = np.where(own, ~inside, away > r - near)
                guest = own & ~inside & (away <= r + near)
                fp = np.concatenate([fp[left], fp[right], fp[guest]])
                node = np.concatenate([2 * node[left] + 1, 2 * node[right] + 2, 2 * node[guest] + 1])
                own = np.concatenate([own[left], own[right], np.zeros(int(guest.sum()), bool)])
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(fp.view(np.int64)), pa.array(own)], ["leaf", "fp", "own"])
    return run


def _pairs(near: int):
    """Near pairs of one leaf block, as a spanning forest."""
    def run(table: pa.Table) -> pa.Table:
        fp = table.column("fp").combine_chunks().to_numpy(zero_copy_only=False).view(np.uint64)
        own = table.column("own").combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
        mine, a, b = fp[own], [], []
        if len(mine):
            pivot = mine[0]
            mine = mine[np.argsort(np.bitwise_count(mine ^ pivot), kind="stable")]
            away = np.bitwise_count(mine ^ pivot).astype(np.int64)
            far = np.bitwise_count(fp ^ pivot).astype(np.int64)
            for d in np.unique(far):
                lo, hi = np.searchsorted(away, [d - near, d + near + 1])
                asks, some = fp[far == d], mine[lo:hi]
                step = max(1, (1 << 21) // max(1, len(some)))
                for i in range(0, len(asks), step if len(some) else len(asks)):
                    q = asks[i:i + step]
                    x, y = np.nonzero(np.bitwise_count(q[:, None] ^ some[None, :]) <= near)
                    real = q[x] != some[y]
                    x, y = x[real], y[real]
                    if len(x):  # only links that join something new are kept
                        s, t = local_forest(q[x].view(np.int64), some[y].view(np.int64))
                        a.append(s)
                        b.append(t)
        if a:
            a, b = local_forest(np.concatenate(a), np.concatenate(b))
        none = np.zeros(0, np.int64)
        return pa.table({"a": pa.array(a if len(a) else none, pa.int64()), "b": pa.array(b if len(b) else none, pa.int64())})
    return run


def near_links(fingerprints: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links ``(a, b)`` that join all groups of the distinct longs ``fp`` at ``max_bits`` or fewer differing bits.

    Vantage-point tree: the driver builds the top of it from a bounded sample; each fingerprint goes to the leaf
    that owns it, and to those across a boundary that the triangle bound cannot rule out.  In a leaf, the distance
    to one more vantage point prunes again, and what is left is compared exactly.  A leaf with too many rows is
    split into blocks of owners, each of which all queries of the leaf visit.
    """
    n = fingerprints.count()
    levels = min(MAX_LEVELS, max(0, (max(1, n) // LEAF).bit_length()))
    share = min(1.0, SAMPLE_PER_LEAF * (1 << levels) / max(1, n))
    limit = 2 * SAMPLE_PER_LEAF * (1 << levels)
    drawn = fingerprints.where(F.pmod(F.xxhash64("fp", F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20))).limit(limit)
    sample = np.array(sorted(r[0] for r in drawn.select("fp").collect()), dtype=np.int64).view(np.uint64)
    points, radii = _build(sample, levels)
    routed = fingerprints.select("fp").mapInArrow(_route(points, radii, levels, max_bits), "leaf long, fp long, own boolean")
    sizes = routed.where("own").groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = routed.join(sizes, "leaf").withColumn("home", F.when(F.col("own"), F.pmod(F.xxhash64("fp"), "blocks").cast("int")))
    placed = placed.withColumn("block", F.explode(F.sequence(F.coalesce("home", F.lit(0)), F.col("blocks") - 1)))
    placed = placed.select("leaf", "block", "fp", F.coalesce(F.col("home") == F.col("block"), F.lit(False)).alias("own"))
    return placed.groupBy("leaf", "block").applyInArrow(_pairs(max_bits), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    max_bits: int = 2) -> DataFrame:
    """``(id, text_hash, fp, component_fp, component_id)``, one row for each row of ``docs``.

    Documents link if their fingerprints differ in at most ``max_bits`` bits; ``component_id`` is the smallest id that
    links reach (nulls are passed over; null if a group has no other id).  Equal fingerprints are one class before
    any comparison, so thousands of copies cost one row.  Fingerprints are computed once and cut.
    """
    marked = cut(docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"),
                             simhash(F.col(text_col), shingle).alias("fp")))
    classes = cut(marked.groupBy("fp").agg(F.min("id").alias("low")))
    comps = connected_components(near_links(classes, max_bits)).select(F.col("node").alias("fp"), F.col("component").alias("component_fp"))
    named = classes.join(comps, "fp", "left").withColumn("component_fp", F.coalesce("component_fp", "fp"))
    least = named.groupBy("component_fp").agg(F.min("low").alias("component_id"))
    of = named.select("fp", "component_fp").join(least, "component_fp")
    return marked.join(of, "fp").select("id", "text_hash", "fp", "component_fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of the smallest id (a null id only if none other).

    Of repeated rows with that id, one row of the smallest text hash stays.
    """
    found = near_duplicates(docs, id_col, text_col, shingle, max_bits)
    key = lambda i: F.struct(i.isNull().alias("none"), F.coalesce(i, F.lit(0)).alias("id"))
    stay = (found.groupBy("component_fp").agg(F.min(F.struct(key(F.col("id")).alias("k"), F.col("text_hash").alias("h"))).alias("s"))
            .select(F.col("s.k").alias("k"), F.col("s.h").alias("h")).distinct())
    rows = docs.select(F.struct("*").alias("row"), key(F.col(id_col).cast("long")).alias("k"),
                       F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"))
    rank = F.row_number().over(Window.partitionBy("k", "h").orderBy(F.lit(1)))
    return rows.join(stay, ["k", "h"]).withColumn("rank", rank).where("rank = 1").select("row.*")
