"""Substring dedup: runs of words that also occur in an earlier document, found by seed and extend."""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from meterwise.session import materialize

from .line_dedup import NO_ID
from .words import slices, word_codes

SEED_WORDS = 4  # words of an anchor; every window holds (window - SEED_WORDS + 1) of them
HOT, HOT_LEAST = 100_000, 1000  # an anchor is hot beyond 1 / HOT of all anchor rows, and HOT_LEAST of them
LONGEST = 20  # bits for the windows of one run; a longer run is cut
MULT = [pow(0x9E3779B97F4A7C15, 2 * j + 1, 2**64) for j in range(64)]  # odd factors, one for each place in a run


def _runs(h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit value of every run of ``n`` words."""
    size = max(0, len(h) - n + 1)
    out = np.zeros(size, np.uint64)
    for j in range(n):
        out += h[j:j + size] * np.uint64(MULT[j])
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return (out ^ (out >> np.uint64(29))) >> np.uint64(16)  # 48 bits tell seeds apart; matches are compared whole


def _lowest(x: np.ndarray, n: int) -> np.ndarray:
    """The minimum of every ``n`` neighbours."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def _hashes(words: list[bytes]) -> np.ndarray:
    """Two independent 64-bit hashes of every word, as rows."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), ">u8").astype(np.uint64).reshape(-1, 2).T


def _windows(texts: pa.Array, window: int):
    """(text of every whole window, its first word, its lowest anchor, (codes, two hashes of distinct words, word hashes, offsets)) of some texts."""
    offsets, codes, words = word_codes(texts)
    both = _hashes(words)
    h = both[0][codes]
    lengths = np.diff(offsets)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    n = len(codes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), (codes, both, h, offsets)
    low = _lowest(_runs(h, SEED_WORDS), window - SEED_WORDS + 1)
    at = np.flatnonzero(owner[:n] == owner[window - 1:])
    return owner[at], at, low[at], (codes, both, h, offsets)


def _anchors(window: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, texts in slices(batch.column(1)):
                owner, _, low, _ = _windows(texts, window)
                if not len(low):
                    continue
                new = np.ones(len(low), bool)  # neighbouring windows mostly share their anchor
                new[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(low[new].view(np.int64)), pa.array(ids[first + owner[new]])], ["h", "did"])
    return run


def _context(whole: np.ndarray, head: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit value of the windows of every run, in their order."""
    place = np.arange(len(whole)) - np.repeat(head, n)
    factor = np.array(MULT, np.uint64)
    out = np.add.reduceat((whole ^ (whole >> np.uint64(32))) * factor[place % 64] * np.uint64(3) ** (place // 64).astype(np.uint64), head)
    return out + n.astype(np.uint64) * np.uint64(MULT[9])


def _sums(h: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """A 64-bit value of the whole window at each of some places."""
    few = 4 * len(at) < len(h)  # else all windows are summed, without gathering, and then chosen
    size = max(0, len(h) - window + 1)
    out = np.zeros(len(at) if few else size, np.uint64)
    for j in range(window):
        out += (h[at + j] if few else h[j:j + size]) * np.uint64(MULT[20 + j])
    return out if few else out[at]


def _upper(x: np.ndarray) -> pa.Array:
    """The upper half of a hash: a narrower row to shuffle."""
    return pa.array((x >> np.uint64(32)).astype(np.uint32).view(np.int32))


def _runs_of(window: int, hot: np.ndarray, want_hot: bool):
    """Runs of neighbouring windows with one anchor: (anchor, two contexts, document, text, first window, windows).

    Either those of the hot anchors, or all others.
    """
    def run(batches):
        for batch in batches:
            ids, ths = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for first, texts in slices(batch.column(2)):
                owner, at, low, parts = _windows(texts, window)
                if not len(low):
                    continue
                new = np.ones(len(at), bool)
                new[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])  # windows of one text are neighbours
                new[at % ((1 << LONGEST) - 1) == 0] = True
                head = np.flatnonzero(new)
                n = np.diff(np.append(head, len(at)))
                found = np.isin(low[head], hot, invert=not want_hot)
                head, n = head[found], n[found]
                if not len(head):
                    continue
                whole, first_of = at[_spread(head, n)], np.cumsum(n) - n
                codes, both, h, offsets = parts
                c1, c2 = (_context(_sums(x, whole, window), first_of, n) for x in (h, both[1][codes]))
                who = owner[head]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(low[head].view(np.int64)), pa.array(c1.view(np.int64)), _upper(c2), pa.array(ids[first + who]), pa.array(ths[first + who]),
                     pa.array(((at[head] - offsets[who]) << LONGEST) + n)],
                    ["h", "c", "d", "did", "th", "sn"])
    return run


def _spread(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... start + n - 1 of every run."""
    return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _places(sn: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """First windows and numbers of windows."""
    sn = sn.to_numpy(zero_copy_only=False).astype(np.int64)
    return sn >> LONGEST, sn & ((1 << LONGEST) - 1)


def _whole(window: int):
    """Every window of some runs, as a 96-bit value with its document and place."""
    def run(batches):
        for batch in batches:
            ids, ths = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for first, texts in slices(batch.column(2)):
                offsets, codes, words = word_codes(texts)
                h1, h2 = (x[codes] for x in _hashes(words))
                lists = batch.column(3).slice(first, len(texts))
                of = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy(zero_copy_only=False))
                start, n = _places(lists.flatten())
                if not len(of):
                    continue
                at, who = _spread(start + offsets[of], n), np.repeat(of, n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_sums(h1, at, window).view(np.int64)), _upper(_sums(h2, at, window)),
                     pa.array(ids[first + who]), pa.array(ths[first + who]), pa.array(((at - offsets[who]) << LONGEST) + 1)],
                    ["w1", "w2", "did", "th", "sn"])
    return run


def _cover(window: int):
    def run(batches):
        for batch in batches:
            ids = [None if x == NO_ID and th & 1 else x for x, th in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            n_words, n_gone, n_spans, edges, kept = [], [], [], [], []
            for text, runs in zip(batch.column(2), batch.column(3)):
                words = (text.as_py() or "").encode().split()
                n_words.append(len(words))
                if runs.is_valid and len(runs):
                    step = np.zeros(len(words) + 1, np.int64)
                    at, n = _places(runs.values)
                    np.add.at(step, at, 1)
                    np.add.at(step, at + n + window - 1, -1)
                    gone = np.cumsum(step[:-1]) > 0
                    edge = np.flatnonzero(np.diff(gone, prepend=False, append=False))
                    edges.append(edge)
                    n_spans.append(len(edge) // 2)
                    n_gone.append(int(gone.sum()))
                    words = compress(words, (~gone).tolist())
                else:
                    n_spans.append(0)
                    n_gone.append(0)
                kept.append(b" ".join(words))
            edge = np.concatenate([*edges, np.zeros(0, np.int64)]).astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array(edge[::2]), pa.array(edge[1::2])], ["start", "end"])
            spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_spans)]), pa.int32()), spans)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()),
                 spans, pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "spans", "kept_text"])
    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """``(doc_id, n_words, n_removed, spans, kept_text)``, one row for each row of ``docs``.

    A word goes if a run of ``window`` words that covers it also starts in a document with a smaller id; ``spans``
    are the maximal repeats (word numbers, end excluded), judged on the input.

    Seeds: of each window, the lowest of its short word runs is its anchor (winnowing), so two equal windows have
    equal anchors.  Documents are joined on the anchors that at least two of them hold.  Extension both ways: the
    windows around one anchor are a run, compared whole by 96 bits of two hashes beside the anchor; a run that an earlier document also has
    goes at once.  Only the first holders of different runs around one anchor are then compared window by window.
    Overlapping repeats merge to maximal ones.  No pairs of documents are made: anchors, runs and windows keep their
    smallest document, so a passage that a third of all documents share costs a row for each occurrence; the runs
    of such hot anchors are combined before their shuffle, all others meet by anchor.

    A null or empty text has no words; a text under ``window`` words keeps all.  A null id counts as the largest (equal to 2^63-1).
    Rows with equal ids are one document.  Words are split at space and U+0009 to U+000D, and kept words are
    joined by one space.
    """
    if window <= SEED_WORDS or window > 40:
        raise ValueError(f"window must be {SEED_WORDS + 1} to 40 words")
    given = F.col(id_col).cast("long")
    # The last bit of a text's hash says that it has no id, so both joins of texts below shuffle the same columns, once.
    mark = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).bitwiseAND(F.lit(-2)).bitwiseOR(given.isNull().cast("long"))
    keyed = docs.select(F.coalesce(given, F.lit(NO_ID)).alias("did"), mark.alias("th"), F.col(text_col).alias("text"))
    anchors = keyed.select("did", "text").mapInArrow(_anchors(window), "h long, did long")
    shared = materialize(anchors.groupBy("h").agg(F.min("did").alias("a"), F.max("did").alias("b"), F.count(F.lit(1)).alias("n"))
                 .where("a < b").select("h", "n"))
    total = shared.agg(F.sum("n")).first()[0] or 0
    # At most HOT anchors can each have over a HOT-th of all rows, so this set is small however large the corpus is.
    frequent = shared.where(F.col("n") > max(HOT_LEAST, total // HOT)).select("h").collect()
    hot = np.array(sorted(r[0] for r in frequent), np.int64).view(np.uint64)
    schema = "h long, c long, d int, did long, th long, sn long"
    plain = keyed.mapInArrow(_runs_of(window, hot, False), schema).join(shared.select("h"), "h")
    same, near = Window.partitionBy("h", "c", "d"), Window.partitionBy("h")
    plain = plain.withColumn("first", F.min("did").over(same))
    plain = plain.withColumn("various", F.min("first").over(near) < F.max("first").over(near))
    lists = plain.select("did", "th", "sn", "first", "various")
    if len(hot):  # their runs are combined before the shuffle and joined back, which splits
        runs = keyed.mapInArrow(_runs_of(window, hot, True), schema)
        contexts = materialize(runs.groupBy("h", "c", "d").agg(F.min("did").alias("first")))
        various = contexts.groupBy("h").agg((F.min("first") < F.max("first")).alias("various"))
        told = runs.join(contexts.join(various, "h"), ["h", "c", "d"])
        lists = lists.unionByName(told.select("did", "th", "sn", "first", "various"))
    # one list for each text of an id, a set: repeated rows bring nothing new, and neither does another text without an id
    lists = materialize(lists.where("did > first or various").groupBy("did", "th")
                .agg(F.collect_set(F.when(F.col("did") > F.col("first"), F.col("sn"))).alias("copied"),
                     F.collect_set(F.when(F.col("did") <= F.col("first"), F.col("sn"))).alias("heads")))
    heads = lists.where(F.size("heads") > 0).select("did", "th", "heads")
    windows = (keyed.join(heads, ["did", "th"]).select("did", "th", "text", "heads")
               .mapInArrow(_whole(window), "w1 long, w2 int, did long, th long, sn long"))
    firsts = (windows.groupBy("w1", "w2").agg(F.min("did").alias("first"), F.max("did").alias("last"))
              .where("first < last").select("w1", "w2", "first"))
    extended = windows.join(firsts, ["w1", "w2"]).where("did > first").select("did", "th", "sn")
    copied = lists.select("did", "th", F.explode("copied").alias("sn"))
    hits = copied.union(extended).groupBy("did", "th").agg(F.collect_set("sn").alias("runs"))
    return (keyed.join(hits, ["did", "th"], "left").select("did", "th", "text", "runs")
            .mapInArrow(_cover(window), "doc_id long, n_words long, n_removed long, "
                                        "spans array<struct<start:int,end:int>>, kept_text string"))
