"""How far the sources of a language differ in their terms: divergences of every pair, and each source's own terms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from meterwise.session import materialize

from .words import slices

BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"  # what is no letter: terms are runs of A-Z, a-z and all beyond ASCII
UNIT = 1_000_000_000  # of a share
CELLS = 50_000  # counts that a shard aims at
TABLE = 1 << 20  # shares that a task holds at once
SAFE = 2**63 // UNIT - 1  # counts up to this keep a share's numerator inside a long


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of every batch: occurrences, and rows that hold the term."""
    for batch in batches:
        lang, source = batch.column(0), batch.column(1)
        for first, texts in slices(batch.column(2)):
            parts = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=BETWEEN)
            terms = pc.list_flatten(parts).dictionary_encode()
            rows = pc.add(pc.cast(pc.list_parent_indices(parts), pa.int64()), pa.scalar(first, pa.int64()))
            places = pa.table({"row": rows, "code": terms.indices})
            empty = pc.index(terms.dictionary, pa.scalar("", terms.dictionary.type)).as_py()
            if empty >= 0:  # at a text's ends
                places = places.filter(pc.not_equal(places["code"], empty))
            by_row = places.group_by(["row", "code"]).aggregate([([], "count_all")])
            by_row = by_row.append_column("lang", lang.take(by_row["row"].combine_chunks())).append_column("source", source.take(by_row["row"].combine_chunks()))
            by_group = by_row.group_by(["lang", "source", "code"]).aggregate([("count_all", "sum"), ("row", "count")])
            if by_group.num_rows:
                term = terms.dictionary.take(by_group["code"].combine_chunks()).cast(pa.string())
                columns = [by_group["lang"], by_group["source"], term, by_group["count_all_sum"], by_group["row_count"]]
                yield from pa.table(columns, names=["lang", "source", "term", "n", "docs"]).combine_chunks().to_batches()


def _share(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / total), exactly."""
    if counts.size and int(counts.max()) >= SAFE:
        return 1 + (UNIT * (counts.astype(object) + 1)) // total.astype(object)
    return 1 + (UNIT * (counts + 1)) // total


def _shard(top: int):
    def run(key, counts: pa.Table, groups: pa.Table) -> pa.Table:
        lang = key[0].as_py()
        order = pc.sort_indices(groups["source"])
        sources = groups["source"].take(order).to_pylist()
        n = groups["n"].take(order).to_numpy()
        v, n_lang = groups["v"][0].as_py(), groups["n_lang"][0].as_py()
        place = {s: i for i, s in enumerate(sources)}
        terms = counts["term"].combine_chunks().dictionary_encode() if counts.num_rows else pa.array([], pa.string()).dictionary_encode()
        code = terms.indices.to_numpy(zero_copy_only=False)
        column = np.array([place[s] for s in counts["source"].to_pylist()], np.int64)
        held = counts["n"].to_numpy()
        names = terms.dictionary.to_pylist()
        total = np.zeros((len(sources), len(sources)), np.int64)
        out: list[tuple[str, str, str, int]] = []
        best: list[list[tuple[int, bytes, str]]] = [[] for _ in sources]
        step = max(1, TABLE // max(1, len(sources)))
        by_code = np.argsort(code, kind="stable")
        for a in range(0, len(names), step):
            some = by_code[np.searchsorted(code[by_code], a):np.searchsorted(code[by_code], a + step)]
            table = np.zeros((min(step, len(names) - a), len(sources)), np.int64)
            table[code[some] - a, column[some]] = held[some]
            p = _share(table, (n + v)[None, :])
            for i in range(len(sources)):
                apart = p[:, i:i + 1] - p
                total[i] += (apart * apart // p).sum(axis=0).astype(np.int64)
            q = _share(table.sum(axis=1), np.array(n_lang + v))[:, None]
            gain = np.where((table > 0) & (p > q), (p - q) * (p - q) // q, -1)
            for i in range(len(sources)):
                own = np.flatnonzero(gain[:, i] >= 0)
                best[i] += [(-int(gain[t, i]), names[a + t].encode(), names[a + t]) for t in own]
                if len(best[i]) > 4 * top:
                    best[i] = sorted(best[i])[:top]
        for i, s in enumerate(sources):
            out += [(s, "pair", other, int(total[i, j])) for j, other in enumerate(sources) if j != i]
            out += [(s, "term", term, -value) for value, _, term in sorted(best[i])[:top]]
        cols = list(zip(*out)) or [(), (), (), ()]
        return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "source": pa.array(cols[0], pa.string()), "part": pa.array(cols[1], pa.string()),
                         "item": pa.array(cols[2], pa.string()), "value": pa.array(cols[3], pa.int64())})
    return run


def source_divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 3,
                      top: int = 200) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` for every group of lang and source that occurs.

    Terms are runs of letters (``BETWEEN`` is what parts them), A-Z lower-cased; a language keeps those that at least
    ``least_docs`` of its rows hold.  A group's share of a term is 1 + floor(UNIT * (n + 1) / (N + V)).  Part ``pair``:
    the sum over all kept terms of floor((p - q)^2 / q) against each other source of the language; part ``term``: the
    ``top`` terms of the group with p > q, q the whole language's share.  Ranks go by value, largest first, then item.

    Arrow kernels count terms by batch; Spark adds the counts up, combined before the shuffle, and writes them once.  A
    language's kept terms are dealt to shards of about ``CELLS`` counts by the term's hash; a shard meets the totals of
    all the language's groups and gives its part of every pair's sum and its own best terms.  All arithmetic is exact.

    Nulls are ''.  A group without terms has its pairs, an empty table gives no rows, repeated rows count as often as
    they occur, and a long text is split like any other (no prefix).  Other columns are not looked at.
    """
    text = {n: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for n, c in (("lang", lang_col), ("source", source_col), ("text", text_col))}
    rows = docs.select(text["lang"], text["source"], text["text"])
    partial = rows.mapInArrow(_counts, "lang string, source string, term string, n long, docs long")
    counts = materialize(partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("cells")).where(F.col("docs") >= least_docs)
    held = materialize(counts.join(kept.select("lang", "term"), ["lang", "term"], "left_semi").select("lang", "source", "term", "n"))
    groups = docs.select(text["lang"], text["source"]).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("rows"))
    by_group = held.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("cells"))
    vocabulary = held.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    sizes = groups.select("lang", "source").join(by_group, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("cells", F.lit(0)).alias("cells"))
    langs = materialize(sizes.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.sum("cells").alias("cells")).join(vocabulary, "lang", "left")
                        .select("lang", "n_lang", F.coalesce("v", F.lit(0)).alias("v"), (F.floor(F.col("cells") / CELLS) + 1).alias("shards")))
    totals = (sizes.drop("cells").join(langs, "lang")
              .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))).drop("shards"))
    dealt = (held.join(langs.select("lang", "shards"), "lang")
             .select("lang", F.pmod(F.xxhash64("term"), F.col("shards")).alias("shard"), "source", "term", "n"))
    parts = dealt.groupBy("lang", "shard").cogroup(totals.groupBy("lang", "shard")).applyInArrow(_shard(top), "lang string, source string, part string, item string, value long")
    saved = materialize(parts)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = saved.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    terms = saved.where("part = 'term'")
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(
        terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))
