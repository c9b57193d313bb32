"""Best-fit packing of token sequences, in rounds over all documents of a size and all gaps at once."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from meterwise.session import materialize

from .tokens import encode
from .words import give_back, slices

PART = 200_000  # rows of one size that are ranked in one group


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for first, texts in slices(batch.column(1)):
                offsets, tokens = encode(texts, path)
                row, piece, start, length, crc = [], [], [], [], []
                for i in range(len(texts)):
                    own = np.append(tokens[offsets[i]:offsets[i + 1]], np.uint32(end_id))
                    for k, a in enumerate(range(0, len(own), capacity)):
                        part = own[a:a + capacity]
                        row.append(first + i)
                        piece.append(k)
                        start.append(a)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])
            give_back()
    return run


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1,
                 capacity: int = 4096) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: whole texts as ids, then ``end_id``, cut only beyond ``capacity``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_pieces(tokenizer, end_id, capacity),
                           "doc_id long, piece int, start long, length long, ids_crc32 long")


def match_classes(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit of whole size classes: ``(first rank, size, in each sequence, first sequence, offset)``, by rank.

    ``counts``: documents of each size.  Documents are ranked by size, largest first, so a class is a run of ranks; gaps
    are runs of sequences with equal room, sorted by that room.  A round matches one class: its documents ask for their
    successor, the smallest gap that holds them; those that want the same run of gaps are told apart by rank, as many
    to a sequence as fit; the gaps are updated, and what found none opens sequences.  That is what best-fit-decreasing
    does one document at a time.

    A round splits at most one run of gaps and opens at most two, and a gap that is matched loses more than half of its
    room, so there are at most about 2 * capacity * log2(capacity) matches, however many documents there are.
    """
    rooms: list[int] = []  # that some gap has, ascending
    runs: dict[int, list[tuple[int, int]]] = {}  # room -> runs of sequences (first, how many)
    out, rank, opened = [], 0, 0

    def give(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in runs:
                runs[room] = []
                insort(rooms, room)
            runs[room].append((first, n))

    def fill(room: int, size: int, first: int, n: int, left: int) -> int:
        """Documents that go to a run of ``n`` gaps; ``left`` of the class still wait."""
        nonlocal rank
        each = room // size
        whole = min(n, left // each)
        if whole:
            out.append((rank, size, each, first, capacity - room))
            give(room - each * size, first, whole)
        some = left - whole * each if whole < n else 0
        if some:  # the last ones share a sequence that keeps room for one more of them
            out.append((rank + whole * each, size, each, first + whole, capacity - room))
            give(room - some * size, first + whole, 1)
        give(room, first + whole + (some > 0), n - whole - (some > 0))
        rank += whole * each + some
        return whole * each + some

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left and (at := bisect_left(rooms, size)) < len(rooms):
            room = rooms[at]
            first, n = runs[room].pop()
            if not runs[room]:
                del runs[room], rooms[at]
            left -= fill(room, size, first, n, left)
        if left:
            n = -(-left // (capacity // size))
            fill(capacity, size, opened, n, left)
            opened += n
    return out


def _places(matches: list[tuple[int, int, int, int, int]]):
    first, size, each, sequence, offset = (np.array(c, np.int64) for c in zip(*matches))

    def run(batches):
        for batch in batches:
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            m = np.searchsorted(first, rank, side="right") - 1
            turn, place = np.divmod(rank - first[m], each[m])
            names = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence[m] + turn), pa.array(offset[m] + place * size[m])],
                                             [*names, "sequence_id", "offset"])
    return run


def _ranked(rows: DataFrame, counts: dict[int, int]) -> DataFrame:
    """``rows`` (length, uid) with ``rank`` from 0, largest first.  A size that many rows share is ranked in parts of about
    ``PART`` rows, whose first ranks come from their counts."""
    parts = rows.sparkSession.createDataFrame([(s, max(1, -(-n // PART))) for s, n in counts.items()], "length long, parts long")
    rows = rows.join(parts, "length").withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts"))).drop("parts")
    larger, at = [], 0
    for s in sorted(counts, reverse=True):
        larger.append((s, at))
        at += counts[s]
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")).join(rows.sparkSession.createDataFrame(larger, "length long, larger long"), "length")
    cells = cells.select("length", "part", (F.col("larger") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("base"))
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy("uid")) - 1
    return rows.withColumn("within", within).join(cells, ["length", "part"]).withColumn("rank", F.col("base") + F.col("within")).drop("part", "within", "base")


def best_fit(items: DataFrame, capacity: int = 4096) -> DataFrame:
    """``items`` (with a ``length`` of 1 to ``capacity``) and, for each row, ``sequence_id`` and ``offset``.

    Rows are written once and counted by length; the rounds of :func:`match_classes` run on these counts (at most
    ``capacity`` of them, whatever the rows); every row is ranked by one window over parts of its length and finds its
    sequence and place from the match that holds its rank.  The result has as many sequences as best-fit-decreasing.

    Repeated rows are packed as often as they occur; ties of length are ranked by where the row was written.  Other
    columns are carried along.
    """
    rows = items.withColumns({"length": F.col("length").cast("long"), "uid": F.monotonically_increasing_id()})
    rows = materialize(rows)
    counts = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}
    schema = T.StructType([*items.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    if not counts:
        return items.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    ranked = _ranked(rows, counts).select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in items.schema.fields], "rank")
    return ranked.mapInArrow(_places(match_classes(counts, capacity)), schema)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1,
         capacity: int = 4096) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null or empty text is the end id alone.  Repeated rows and null ids are packed like any other.  An empty table
    gives no rows.  Texts of any length are read whole, and only pieces over ``capacity`` are cut; other columns of
    ``docs`` are not looked at.
    """
    return best_fit(token_pieces(docs, tokenizer, id_col, text_col, end_id, capacity), capacity)
