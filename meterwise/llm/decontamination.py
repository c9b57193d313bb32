"""Benchmark decontamination: passages query a BM25 index of test items by block-max WAND, matches are verified."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from meterwise.session import materialize

from .words import give_back, ragged, slices, word_codes

K1, B = 1.2, 0.75  # BM25
RETRIEVE = 0.5  # of an item's score against itself
OVERLAP, PART = 0.8, 0.5  # five-word shingles an item must share in all, and its question and its answer each
SHINGLE = 5
BLOCK = 32  # postings under one block maximum
CELLS = 1 << 20  # words of passages, or passages by items, in one table; a worker holds a few such tables
INDEX_BYTES = 8 << 20  # item text that one index holds; a larger benchmark becomes several
WORD = re.compile(r"[^\W_]+")
LEAST_WORDS = SHINGLE  # of an item; shorter ones are found in any text and prove nothing
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
KNOWN = 200_000  # chunks that an index remembers while a task lasts; beyond it, it starts anew


def normal_words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The words up to the last question mark and those after it; without one, all sentences but the last, and it."""
    cut = text.rfind("?") + 1
    if not cut or not normal_words(text[cut:]):
        ends = [m.end() for m in re.finditer(r"[.!?]+\s+", text.rstrip())]
        cut = ends[-1] if ends else 0
    question, answer = normal_words(text[:cut]), normal_words(text[cut:])
    if not question:
        at = max(1, 2 * len(answer) // 3)
        question, answer = answer[:at], answer[at:]
    return question, answer


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    n = min(SHINGLE, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if words else set()


@dataclass(frozen=True)
class Stats:
    """What BM25 knows of all items: how many, their words in all, the longest one's, and in how many each term is."""

    items: int
    words: int
    longest: int
    df: Mapping[str, int]


class ItemIndex:
    """Inverted index of items; a posting's impact is its BM25 part of the item's score against itself (0 to 1)."""

    def __init__(self, items: list[tuple[int, str]], stats: Stats | None = None):
        """``stats``: of all items, where these are a part of them."""
        self.items = [(i, t) for i, t in items if t and len(normal_words(t)) >= LEAST_WORDS]
        words = [normal_words(t) for _, t in self.items]
        stats = stats or Stats(len(words), sum(map(len, words)), max(map(len, words), default=1), Counter(t for w in words for t in set(w)))
        self.longest = stats.longest
        self.parts = [tuple(map(shingles, (w, *_question_and_answer(t)))) for w, (_, t) in zip(words, self.items)]
        mean = max(1.0, stats.words / max(1, stats.items))
        lists: dict[str, list[tuple[int, int]]] = {}
        for k, w in enumerate(words):
            for t in sorted(set(w)):
                lists.setdefault(t, []).append((k, w.count(t)))
        whole = np.zeros(len(words))
        impact = {}
        for t, posts in lists.items():
            df = stats.df[t]
            idf = np.log(1 + (stats.items - df + 0.5) / (df + 0.5))
            impact[t] = [idf * n * (K1 + 1) / (n + K1 * (1 - B + B * len(words[k]) / mean)) for k, n in posts]
            for (k, _), x in zip(posts, impact[t]):
                whole[k] += x
        self.terms = {t: j + 1 for j, t in enumerate(sorted(lists))}  # 0: in no item
        self.docs, self.impacts, self.maxima = [np.zeros(0, int)], [np.zeros(0)], [np.zeros(0)]
        for t in sorted(lists):
            self.docs.append(np.array([k for k, _ in lists[t]]))
            self.impacts.append(np.array([x / whole[k] for (k, _), x in zip(lists[t], impact[t])]))
            self.maxima.append(np.array([self.impacts[-1][a:a + BLOCK].max() for a in range(0, len(lists[t]), BLOCK)]))
        self.postings = [d.tolist() for d in self.docs]
        self.term_max = np.array([m.max() if len(m) else 0.0 for m in self.maxima])
        # Common terms cannot carry an item over the threshold alone: no item gets 0.7 of it from them.
        held = np.zeros(len(words))
        self.rare = np.zeros(len(self.docs), bool)
        for j in sorted(range(1, len(self.docs)), key=lambda j: -len(self.docs[j])):
            now = held.copy()
            now[self.docs[j]] += self.impacts[j]
            if self.rare.any() or now.max() >= RETRIEVE * 0.7:
                self.rare[j] = True
            else:
                held = now
        self.held = held  # what the common terms can add to each item at most
        self.common = float(held.max()) if len(held) else 0.0
        self.passage = int(max(64, 2 * self.longest))  # words; half of it is the step, so an item is whole in one

    def search(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """Items over the threshold for a passage's distinct terms, by block-max WAND."""
        docs, over = self.postings, RETRIEVE - 1e-9
        lists = [(docs[j][0], j, 0) for j in terms.tolist() if j and docs[j]]  # (item at the cursor, term, cursor)
        found = []

        def moved(cursors, to):  # cursors set to the first item from ``to`` on; those at their end go
            out = []
            for _, j, at in cursors:
                at = bisect_left(docs[j], to, at)
                if at < len(docs[j]):
                    out.append((docs[j][at], j, at))
            return out

        while True:
            lists.sort()
            bound, pivot = 0.0, None
            for n, (_, j, _) in enumerate(lists):  # the first item that the lists' maxima let over the threshold
                bound += self.term_max[j]
                if bound >= over:
                    pivot = n
                    break
            if pivot is None:
                return found
            item = lists[pivot][0]
            end = next((n for n in range(pivot, len(lists)) if lists[n][0] > item), len(lists))
            behind = lists[end:]
            tied = moved(lists[:end], item)
            if sum(self.maxima[j][at // BLOCK] for _, j, at in tied) < over:
                # no item of these blocks gets there: go on behind the first block that ends, or at the next list's item
                ends = [docs[j][min(len(docs[j]), (at // BLOCK + 1) * BLOCK) - 1] + 1 for _, j, at in tied] + [x[0] for x in behind[:1]]
                lists = moved(tied, max(min(ends), item + 1)) + behind
                continue
            score = sum(self.impacts[j][at] for x, j, at in tied if x == item)
            lists = moved(tied, item + 1) + behind
            if score >= over:
                found.append((item, score))

    def possible(self, ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which passages ``ids[a:b]`` may hold an item: some item's rare terms in the passage and all of its common ones
        reach the threshold.  A dense table of passages by items, some passages at a time."""
        items, out = len(self.items), np.zeros(len(a), bool)
        sizes = np.array([len(d) for d in self.docs])
        starts = np.cumsum(sizes) - sizes
        docs, impacts = np.concatenate(self.docs).astype(np.int64), np.concatenate(self.impacts)
        some = max(1, min(CELLS // max(1, items), CELLS // int((b - a).max(initial=1))))
        for k in range(0, len(a), some):
            n = b[k:k + some] - a[k:k + some]
            who = np.repeat(np.arange(len(n)), n)
            terms = ids[np.repeat(a[k:k + some] - (np.cumsum(n) - n), n) + np.arange(n.sum())].astype(np.int64)
            rare = self.rare[terms]
            pair = np.unique(who[rare] * len(sizes) + terms[rare])  # a repeated term counts once
            who, terms = pair // len(sizes), pair % len(sizes)
            m = sizes[terms]
            post = np.repeat(starts[terms] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            score = np.bincount(np.repeat(who, m) * items + docs[post], impacts[post], minlength=len(n) * items).reshape(len(n), items)
            out[k:k + some] = (score + self.held >= RETRIEVE - 1e-9).any(axis=1)
        return out

    def verified(self, item: int, words: list[str]) -> tuple[float, float, float]:
        """Share of the item's, its question's and its answer's shingles that a passage has."""
        held: dict[int, set] = {}
        out = []
        for part in self.parts[item]:
            if not part:
                out.append(1.0)
                continue
            n = len(next(iter(part)))
            if n not in held:
                held[n] = {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}
            out.append(len(part & held[n]) / len(part))
        return tuple(out)

    def _distinct_gain(self, ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sum of the rare terms' maxima in each passage, a repeated term once."""
        gain, out = np.where(self.rare, self.term_max, 0), []
        wide = int((b - a).max(initial=1))
        some = max(1, min(2048, CELLS // wide))
        for k in range(0, len(a), some):
            at = a[k:k + some, None] + np.arange(wide)
            terms = np.where(at < b[k:k + some, None], ids[np.minimum(at, len(ids) - 1)], 0)
            terms.sort(axis=1)
            each = gain[terms]
            each[:, 1:][terms[:, 1:] == terms[:, :-1]] = 0
            out.append(each.sum(axis=1))
        return np.concatenate(out) if out else np.zeros(0)

    def matches(self, texts: pa.Array) -> Iterator[tuple[int, int, float, float, float, float]]:
        """(text, item, score, overlap, question overlap, answer overlap) of all verified matches of whole texts."""
        if not self.items:
            return
        known: dict[bytes, bytes] = self.__dict__.setdefault("known", {})
        ids_of = {t.encode(): j.to_bytes(4, "little") for t, j in self.terms.items()}
        none = (0).to_bytes(4, "little")
        size, step = self.passage, self.passage // 2
        for first, part in slices(texts):
            offsets, codes, chunks = word_codes(part)
            pieces = []
            for c in chunks:
                piece = known.get(c)
                if piece is None:
                    word = c.strip(MARKS)
                    if word.isalnum():  # one ASCII word, between marks
                        piece = ids_of.get(word.lower(), none)
                    else:
                        piece = b"".join([ids_of.get(w.encode(), none) for w in normal_words(c.decode())])
                    known[c] = piece
                pieces.append(piece)
            if len(known) > KNOWN:
                known.clear()
            offsets, ids = ragged(offsets, codes, pieces)
            gain = np.where(self.rare[ids], self.term_max[ids], 0)
            before = np.concatenate([[0], np.cumsum(gain)])
            lengths = np.diff(offsets)
            n = np.maximum(1, -(-(lengths - size) // step) + 1)  # passages of each text
            who = np.repeat(np.arange(len(lengths)), n)
            a = offsets[who] + (np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)) * step
            b = np.minimum(a + size, offsets[who + 1])
            hopeful = np.flatnonzero(before[b] - before[a] >= RETRIEVE - self.common - 1e-9)
            hopeful = hopeful[self._distinct_gain(ids, a[hopeful], b[hopeful]) >= RETRIEVE - self.common - 1e-9]
            hopeful = hopeful[self.possible(ids, a[hopeful], b[hopeful])]
            best: dict[tuple[int, int], tuple] = {}
            words_of: dict[int, list[str]] = {}
            for k in hopeful.tolist():
                text, terms = int(who[k]), np.unique(ids[a[k]:b[k]])
                for item, score in self.search(terms):
                    if text not in words_of:
                        words_of = {text: normal_words(" ".join(part[text].as_py().split()))}
                    at = int(a[k] - offsets[text])
                    told = self.verified(item, words_of[text][at:at + size])
                    if told[0] >= OVERLAP and min(told[1:]) >= PART:
                        best[text, item] = max(best.get((text, item), (0.0,) * 4), (score, *told))
            for (text, item), told in sorted(best.items()):
                yield (first + text, item, *told)


def _item_terms(batches):
    for batch in batches:
        words = [(p, normal_words(t)) for p, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
        rows = [(p, w, len(ws), int(k == 0)) for p, ws in words if len(ws) >= LEAST_WORDS for k, w in enumerate(sorted(set(ws)))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["part", "term", "words", "first"])


def build_indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[ItemIndex]:
    """Indexes of at most about ``INDEX_BYTES`` of item text each: one for the usual benchmark, more for a large one.

    Scores do not depend on the parts: document frequencies, the number of items and their mean length are taken over
    all items by Spark, and a part's index gets those of its own terms.
    """
    items = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null").distinct()
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-total // INDEX_BYTES))
    if parts == 1:
        yield ItemIndex(sorted((r[0], r[1]) for r in items.collect()))
        return
    items = items.select(F.pmod(F.xxhash64("i", "t"), F.lit(parts)).cast("int").alias("part"), "i", "t")
    terms = materialize(items.mapInArrow(_item_terms, "part long, term string, words long, first long"))
    whole = terms.where("first = 1").agg(F.count(F.lit(1)), F.sum("words"), F.max("words")).first()
    df = materialize(terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    for p in range(parts):
        own = df.join(terms.where(F.col("part") == p).select("term").distinct(), "term", "left_semi").collect()
        yield ItemIndex(sorted((r[0], r[1]) for r in items.where(F.col("part") == p).select("i", "t").collect()),
                        Stats(whole[0], whole[1] or 0, whole[2] or 1, {r[0]: r[1] for r in own}))


def _matching(index: ItemIndex):
    def run(batches):
        for batch in batches:
            rows = list(index.matches(batch.column(1)))
            if rows:
                text, item, *told = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(text)), pa.array([index.items[k][0] for k in item], pa.int64()), *(pa.array(x, pa.float64()) for x in told)],
                    ["doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap"])
    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, score, overlap, question_overlap, answer_overlap)``: every test item found in a document.

    Every passage of every whole document (windows of twice the longest item's words, half overlapping) is a query;
    all items with at least ``RETRIEVE`` of their own BM25 score come back.  Terms so common that they cannot reach
    the threshold alone are no reason to search: a passage whose rare terms' maxima cannot fill the rest is skipped
    by that bound, which loses nothing.  A match holds if the passage has ``OVERLAP`` of the item's five-word
    shingles, and ``PART`` of its question's and of its answer's.  Words are compared without case and punctuation.

    Null or empty texts match nothing; null items and those of fewer than ``LEAST_WORDS`` words are no items; a null id
    stays null, repeated rows are found each, equal items once, and an empty table gives no rows.  Long texts are read whole; other
    columns are not looked at.  The items are a query set of checked size: beyond ``INDEX_BYTES`` they are indexed in
    several parts, one after the other, each of which reads all rows and writes what it found; scores do not depend on
    the parts.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double"
    out = last = None
    for index in build_indexes(benchmark):
        if last is not None:  # of several parts, each one's matches are written, so that its index can go
            written = materialize(last)
            out = written if out is None else out.unionByName(written)
        last = rows.mapInArrow(_matching(index), schema)
    return last if out is None else out.unionByName(last)


def is_clean(text: Column, index: ItemIndex) -> Column:
    @F.arrow_udf("boolean")
    def of(texts: pa.Array) -> pa.Array:
        clean = np.ones(len(texts), bool)
        clean[[m[0] for m in index.matches(texts)]] = False
        give_back()
        return pa.array(clean)

    return of(text)


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows in which a test item was found."""
    first = True
    for index in build_indexes(benchmark):
        docs = (docs if first else materialize(docs)).where(is_clean(F.col(text_col), index))
        first = False
    return docs
