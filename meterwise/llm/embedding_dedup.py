"""Embedding near-dedup by NN-descent: a neighbour graph refined through neighbours of neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .components import connected_components, local_forest
from .scratch import cut

NEIGHBOURS = 10  # of each vector in the graph
TREES = 10  # random orders that the first graph is taken from
LEAF = 48  # neighbours in such an order that are compared
ROUNDS = 6  # of refinement at most; a round that improves under SETTLED of the lists is the last
SETTLED = 0.01
AUDIT = 400  # vectors whose links are also found by comparing them with all rows, and as many with a list that holds a non-link
RECALL = 0.99  # mean over the audited vectors; below it, more random orders are added and the graph is refined again
REPAIRS = 5  # each adds twice the orders of the one before; after the last the job fails with the measured recall
SMALL = 64  # members of a group that is compared in one go, with others
TILE = 1024  # members of a dense group that one task compares with as many others


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float32)


def _unit(batches):
    """Unit vectors as bytes; what has no direction (null, zero or non-finite) gives null."""
    for batch in batches:
        out = []
        for v in batch.column(1):
            x = np.array(v.as_py() if v.is_valid else [], dtype=np.float64) if not (v.is_valid and any(e is None for e in v.as_py())) else np.zeros(0)
            top = np.abs(x).max(initial=0.0)
            if len(x) and np.isfinite(top) and top > 0:
                x = x / top
                out.append((x / np.sqrt((x * x).sum())).tobytes())
            else:
                out.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "unit"])


def _vectors(column) -> np.ndarray:
    """A stack of unit vectors of one length, in double precision."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1) if raw else np.zeros((0, 1))


def _top(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    k = min(k, sims.shape[1])
    at = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return np.repeat(np.arange(len(sims)), k), at.ravel()


def _edges(a, b, s):
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float32())], ["a", "b", "s"])


def _order_key(seed: int):
    """A place in a random order: the signs of random projections, the one after the other, then one projection."""
    def run(batches):
        for batch in batches:
            v = _vectors(batch.column(1))
            if not len(v):
                continue
            planes = np.random.default_rng(seed).normal(size=(v.shape[1], 33))
            p = v @ planes
            code = ((p[:, :32] > 0).astype(np.uint64) << np.arange(32, dtype=np.uint64)[::-1]).sum(1, dtype=np.uint64)
            fine = np.clip((p[:, 32] + 6) / 12 * (1 << 30), 0, (1 << 30) - 1).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(((code << np.uint64(30)) | fine).view(np.int64))], ["c", "unit", "g", "place"])
    return run


def _along(batches):
    """The best neighbours of each vector, outside its own group, among those beside it in a sorted partition."""
    rest = None
    for batch in batches:
        c, g = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
        v = _vectors(batch.column(1)).astype(np.float32)
        if rest is not None:  # the end of the last batch meets the start of this one
            c, v, g = (np.concatenate(x) for x in zip(rest, (c, v, g)))
        for a in range(0, len(c), LEAF // 2):
            x, ids, own = v[a:a + LEAF], c[a:a + LEAF], g[a:a + LEAF]
            if len(ids) < 2:
                continue
            sims = x @ x.T
            sims[own[:, None] == own[None, :]] = -2
            i, j = _top(sims, NEIGHBOURS)
            real = sims[i, j] > -2
            i, j = i[real], j[real]
            yield _edges(ids[i], ids[j], sims[i, j])
        rest = (c[-LEAF // 2:], v[-LEAF // 2:], g[-LEAF // 2:])


def _first_graph(vectors: DataFrame, seeds: range) -> DataFrame:
    """Neighbours in several random orders.  Each order is range-partitioned with the id as tie-break, so that a
    dense group spreads over partitions and no bucket can overflow."""
    out = None
    for seed in seeds:
        placed = vectors.mapInArrow(_order_key(seed), "c long, unit binary, g long, place long")
        own = (placed.repartitionByRange("place", "c").sortWithinPartitions("place", "c").select("c", "unit", "g")
               .mapInArrow(_along, "a long, b long, s float"))
        out = own if out is None else out.unionByName(own)
    return out


def _best(edges: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """The ``k`` nearest of each list; the limit is applied before the shuffle too."""
    once = edges.groupBy("a", "b").agg(F.max("s").alias("s"), F.max("old").alias("old"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("s"), "b"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def _local_join(batches):
    """Among the neighbours of each vector: pairs of two groups that are nearer than the farthest neighbour either has."""
    for batch in batches:
        centre = batch.column(0)
        for k in range(0, len(centre), 512):
            lists = batch.column(1).slice(k, 512)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            ids = flat.field("b").to_numpy(zero_copy_only=False)
            bar = flat.field("bar").to_numpy(zero_copy_only=False)
            g = flat.field("g").to_numpy(zero_copy_only=False)
            fresh = flat.field("fresh").to_numpy(zero_copy_only=False).astype(bool)
            v = _vectors(flat.field("unit")).astype(np.float32)
            ends = np.cumsum(sizes)
            a, b, s = [], [], []
            for lo, hi in zip(ends - sizes, ends):
                sims = v[lo:hi] @ v[lo:hi].T
                good = (sims > bar[lo:hi, None]) & (g[lo:hi, None] != g[None, lo:hi]) & (fresh[lo:hi, None] | fresh[None, lo:hi])
                i, j = np.nonzero(good)
                a.append(ids[lo + i])
                b.append(ids[lo + j])
                s.append(sims[i, j])
            if a:
                yield _edges(np.concatenate(a), np.concatenate(b), np.concatenate(s))


def _refine(graph: DataFrame, vectors: DataFrame, total: int, near: DataFrame | None = None) -> DataFrame:
    """Neighbours of neighbours, until hardly a list changes.  ``old`` marks entries that have been joined already.

    ``near``: links that lead to more candidates and are no entries themselves.
    """
    for _ in range(ROUNDS):
        bars = graph.groupBy("a").agg(F.min("s").alias("bar"), F.count(F.lit(1)).alias("n"))
        bars = bars.select("a", F.when(F.col("n") >= NEIGHBOURS, F.col("bar")).otherwise(F.lit(-2.0)).cast("float").alias("bar"))
        back = graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "s", "old")
        nearest = Window.partitionBy("a").orderBy(F.desc("s"), "b")
        back = back.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= NEIGHBOURS).drop("rank")
        both = graph.unionByName(back) if near is None else graph.unionByName(back).unionByName(near)
        both = both.groupBy("a", "b").agg(F.min("old").alias("old"))
        barred = vectors.withColumnRenamed("c", "b").join(bars.withColumnRenamed("a", "b"), "b", "left")
        members = both.join(barred.withColumn("bar", F.coalesce("bar", F.lit(-2.0).cast("float"))), "b")
        groups = members.groupBy("a").agg(F.collect_list(F.struct("b", "bar", "g", (F.col("old") == 0).alias("fresh"), "unit")).alias("near"))
        nearer = groups.where(F.exists("near", lambda x: x["fresh"])).select("a", "near").mapInArrow(_local_join, "a long, b long, s float")
        seen = graph.withColumn("old", F.lit(1))
        graph = cut(_best(seen.unionByName(nearer.withColumn("old", F.lit(0)))))
        if graph.where("old = 0").count() < SETTLED * NEIGHBOURS * max(1, total):
            break
    return graph


def _across(graph: DataFrame, groups: DataFrame, vectors: DataFrame, loose: float) -> DataFrame:
    """``groups`` joined where a link leads from one to another that no list of ``NEIGHBOURS`` entries has room for.

    Such a link has a saturated list (links only) at both ends.  The vectors with saturated lists get lists of their
    nearest neighbours outside their own group, refined like the graph; groups that are linked become one, and the
    lists are made anew outside it, until no link leads out of a group.
    """
    linked = graph.where(F.col("s") >= loose)
    full = linked.groupBy("a").count().where(F.col("count") >= NEIGHBOURS).select(F.col("a").alias("c"))
    own = cut(vectors.select("c", "unit").join(full, "c").join(groups, "c"))
    total, seeds = own.count(), 1 << 20
    if own.select("g").distinct().limit(2).count() < 2:
        return groups
    near = cut(linked.join(own.select(F.col("c").alias("a")), "a").select("a", "b", "s", F.lit(1).alias("old")))
    far = None
    while True:
        edges = _first_graph(own, range(seeds, seeds + TREES)).withColumn("old", F.lit(0))
        seeds += TREES
        ends = own.select(F.col("c").alias("a"), F.col("g").alias("ga")), own.select(F.col("c").alias("b"), F.col("g").alias("gb"))
        if far is not None:
            edges = edges.unionByName(far.join(ends[0], "a").join(ends[1], "b").where("ga != gb").select("a", "b", "s", F.lit(0).alias("old")))
        far = _refine(cut(_best(edges)), own, total, near)
        met = cut(far.where(F.col("s") >= loose).join(ends[0], "a").join(ends[1], "b").select("ga", "gb").distinct())
        if met.isEmpty():
            return groups
        one = cut(connected_components(met, "ga", "gb").select(F.col("node").alias("g"), F.col("component").alias("into")))
        own, groups = (cut(x.join(one, "g", "left").withColumn("g", F.coalesce("into", "g")).select(*x.columns)) for x in (own, groups))


def _audit(sample: list, threshold: float):
    """For each sampled vector: its links in a batch, and how many of them are in its group."""
    ids, own = (np.array([r[k] for r in sample], np.int64) for k in (0, 2))
    v = np.frombuffer(b"".join(bytes(r[1]) for r in sample), np.float64).reshape(len(ids), -1)

    def run(batches):
        for batch in batches:
            c, g, x = *(batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2)), _vectors(batch.column(1))
            n, hit = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            for k in range(0, len(c), 2048):
                i, j = np.nonzero(v @ x[k:k + 2048].T >= threshold)
                other = ids[i] != c[k + j]
                i, j = i[other], j[other]
                n += np.bincount(i, minlength=len(ids))
                hit += np.bincount(i[own[i] == g[k + j]], minlength=len(ids))
            some = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(n[some]), pa.array(hit[some])], ["a", "n", "hit"])
    return run


def _recalls(found: list) -> tuple[float, float]:
    """Mean recall over the vectors of ``(links, links found)``: of all, and of those with ``NEIGHBOURS`` links at most."""
    mean = lambda x: float(np.mean(x)) if x else 1.0
    return mean([hit / n for n, hit in found if n]), mean([hit / n for n, hit in found if 0 < n <= NEIGHBOURS])


def _recall(graph: DataFrame, groups: DataFrame, vectors: DataFrame, total: int, threshold: float) -> float:
    """The lower of both recalls, by comparing a bounded sample with all rows.

    A link is found if both ends are in one group, as a group's blocks are compared exactly.  Half of the sample is
    taken from the vectors whose list holds a non-link, so that a dense group cannot fill it.
    """
    placed = vectors.select("c", "unit").join(groups, "c", "left").select("c", "unit", F.coalesce("g", "c").alias("g"))
    linked = graph.where(F.col("s") >= threshold).groupBy("a").count().where(F.col("count") >= NEIGHBOURS).select(F.col("a").alias("c"))
    sample = {}
    for seed, of in enumerate((placed, placed.join(linked, "c", "left_anti"))):
        share = int(min(1.0, AUDIT / max(1, of.count() if seed else total)) * (1 << 24))
        for r in of.where(F.pmod(F.xxhash64("c", F.lit(seed)), F.lit(1 << 24)) < share).limit(2 * AUDIT).collect():
            sample[r[0]] = r
    if not sample:
        return 1.0
    seen = placed.mapInArrow(_audit(list(sample.values()), threshold), "a long, n long, hit long")
    return min(_recalls([(r[1], r[2]) for r in seen.groupBy("a").agg(F.sum("n"), F.sum("hit")).collect()]))


def _compared(c, w, v, other_c, other_w, other_v, threshold):
    """How many rows each member links with, and links that join all that these links join."""
    i, j = np.nonzero(v @ other_v.T >= threshold)
    real = c[i] != other_c[j]
    i, j = i[real], j[real]
    n = np.bincount(i, other_w[j], minlength=len(c)).astype(np.int64)
    a, b = local_forest(c[i], other_c[j]) if len(i) else (c[:0], c[:0])
    some = n > 0
    return np.concatenate([c[some], a]), np.concatenate([n[some], np.zeros(len(a), np.int64)]), np.concatenate([np.full(int(some.sum()), -1), b])


def _tiles(threshold: float):
    """Exact links of two blocks of one group (``side`` 0 and 1), or of many small groups in full (``side`` 2)."""
    def run(table: pa.Table) -> pa.Table:
        g, c, w, side = (table.column(x).combine_chunks().to_numpy(zero_copy_only=False) for x in ("g", "c", "w", "side"))
        v = _vectors(table.column("unit").combine_chunks())
        if side[0] == 2:
            order = np.argsort(g, kind="stable")
            cuts = [0, *(np.flatnonzero(np.diff(g[order])) + 1).tolist(), len(g)]
            parts = [(order[x:y], order[x:y]) for x, y in zip(cuts, cuts[1:])]
        else:
            parts = [(np.flatnonzero(side == 0), np.flatnonzero(side == 1))]
        found = [_compared(c[x], w[x], v[x], c[y], w[y], v[y], threshold) for x, y in parts]
        out = [np.concatenate(x) for x in zip(*found)]
        return pa.table({"c": pa.array(out[0], pa.int64()), "n": pa.array(out[1], pa.int64()), "b": pa.array(out[2], pa.int64())})
    return run


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                           threshold: float = 0.9) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row for each row of ``vectors``.

    Vectors link at a cosine of ``threshold`` or more, in double precision; a null, zero or non-finite vector, and
    vectors of different lengths, link with nothing.  Equal directions are one class, so copies cost one row; a
    class's copies count in ``n_links``.

    NN-descent: the first graph joins neighbours in several random orders; each round compares the neighbours of
    every vector with each other.  A list whose entries are all links is saturated: it is enlarged to its whole
    group of linked vectors, and its nearest neighbours outside that group are found the same way, which joins groups
    until none is linked with another.  A group's blocks are compared exactly, counting links without writing pairs.
    An audit compares a bounded sample with all rows; if the recall of the mean vector, or of the mean sparsely linked
    one, is too low, further orders are added and the graph is refined again; if that does not help, the job fails.
    Links are then recomputed in double precision, and components follow them.

    Rows with a null id are compared and counted; ``component_id`` passes nulls over.  Repeated ids are rows of
    their own that share an id.
    """
    rows = cut(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).mapInArrow(_unit, "vec_id long, unit binary"))
    classes = cut(rows.where("unit is not null").groupBy("unit").agg(F.count(F.lit(1)).alias("w"), F.min("vec_id").alias("low"))
                  .withColumn("c", F.monotonically_increasing_id()))
    sized = [r[0] for r in classes.select(F.length("unit")).distinct().collect()]
    links, more = None, None
    for size in sorted(sized):
        own = classes.where(F.length("unit") == size)
        found, counts = _links(own, threshold)
        links = found if links is None else links.unionByName(found)
        more = counts if more is None else more.unionByName(counts)
    if links is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    comps = connected_components(links).select(F.col("node").alias("c"), F.col("component").alias("g"))
    named = classes.join(comps, "c", "left").withColumn("g", F.coalesce("g", "c")).join(more, "c", "left")
    least = named.groupBy("g").agg(F.min("low").alias("component_id"))
    told = named.join(least, "g").select("unit", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id")
    out = rows.join(told, "unit", "left")
    component = F.when(F.col("unit").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _links(classes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(links that span all groups, number of linked rows ``n`` of each class) of classes of one length."""
    vectors = cut(classes.select("c", "unit", F.col("c").alias("g")))
    total = vectors.count()
    loose = threshold - 1e-4  # single precision in the graph; links are recomputed
    graph = cut(_best(_first_graph(vectors, range(TREES)).withColumn("old", F.lit(0))))
    graph, orders = _refine(graph, vectors, total), TREES
    for k in range(REPAIRS + 1):
        both = graph.where(F.col("s") >= loose).select("a", "b")
        links = cut(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
        groups = cut(connected_components(links).select(F.col("node").alias("c"), F.col("component").alias("g")))
        groups = _across(graph, groups, vectors, loose)
        recall = _recall(graph, groups, vectors, total, threshold)
        if recall >= RECALL:
            break
        if k == REPAIRS:
            raise RuntimeError(f"near_duplicate_vectors: recall {recall:.4f} of the audited links after {orders} random orders, below {RECALL}")
        for _ in range(2 ** k):
            extra = _first_graph(vectors, range(orders, orders + TREES)).withColumn("old", F.lit(0))
            graph, orders = cut(_best(graph.unionByName(extra))), orders + TREES
        graph = _refine(graph, vectors, total)
    blocks = groups.groupBy("g").agg(F.count(F.lit(1)).alias("m")).withColumn("blocks", F.ceil(F.col("m") / TILE).cast("int"))
    members = groups.join(blocks.where("m > 1"), "g").join(classes.select("c", "unit", "w"), "c")
    few = members.where(F.col("m") <= SMALL)
    bins = max(1, groups.count() // TILE)  # small groups share calls, by a hash
    small = few.select("g", "c", "unit", "w", F.lit(2).alias("side"), F.pmod(F.xxhash64("g"), F.lit(bins)).alias("i"), F.lit(-1).alias("j"), F.lit(-1).cast("long").alias("of"))
    large = members.where(F.col("m") > SMALL).withColumn("own", F.pmod(F.xxhash64("c"), "blocks"))
    asks = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sides = small
    for side, i, j in ((0, "own", "other"), (1, "other", "own")):
        sides = sides.unionByName(asks.select("g", "c", "unit", "w", F.lit(side).alias("side"), F.col(i).cast("long").alias("i"), F.col(j).cast("int").alias("j"), F.col("g").alias("of")))
    told = cut(sides.groupBy("of", "i", "j").applyInArrow(_tiles(threshold), "c long, n long, b long"))
    return told.where("b >= 0").select(F.col("c").alias("a"), "b"), told.where("b < 0").groupBy("c").agg(F.sum("n").alias("n"))
