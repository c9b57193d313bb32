"""Every numbered query against plain Python over the same odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from meterwise.llm import queries as Q

BLANK = " \t\n\x0b\x0c\r"
NO_ID = 2**63 - 1


def rows_of(spark, folder, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/{name}.parquet").select(*columns).collect()]


def result(spark, folder, name):
    return [r.asDict() for r in Q.QUERIES[name](spark, folder).collect()]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert result(spark, empty, name) == []


def test_language_id(spark, odd):
    docs = dict(((i, t), lang) for i, t, lang in rows_of(spark, odd, "documents", "doc_id", "text", "lang"))
    found = result(spark, odd, "op1_language_id")
    assert len(found) == len(rows_of(spark, odd, "documents", "doc_id"))
    for r in found:
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        texts = [t for i, t in docs if i == r["doc_id"]]
        if r["doc_id"] is not None and not any(any(map(str.isalpha, t or "")) for t in texts):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in ("en", "de", "und")


def test_language_id_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.001"
    lang = dict(rows_of(spark, folder, "documents", "doc_id", "lang"))
    held = [r for r in result(spark, folder, "op1_language_id") if r["held_out"]]
    assert held and sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.9 * len(held)


def test_token_counts_and_packing(spark, odd):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(Q.TOKENIZER)
    tok.encode_special_tokens = True
    docs = rows_of(spark, odd, "documents", "doc_id", "text")
    ids = [(i, np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")) for i, t in docs]
    lengths = np.array([len(x) - 1 for _, x in ids])
    for r in result(spark, odd, "op2_token_counts"):
        limit = r["length"]
        assert r["n_docs"] == (lengths == limit).sum() and r["docs_at_least"] == (lengths >= limit).sum()
        assert r["truncated_tokens"] == np.minimum(lengths, limit).sum() and r["total_tokens"] == lengths.sum()
    packed = result(spark, odd, "op6_best_fit_packing")
    want = Counter((i, k, a, len(x[a:a + 4096]), zlib.crc32(x[a:a + 4096].tobytes())) for i, x in ids for k, a in enumerate(range(0, len(x), 4096)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    by = defaultdict(list)
    for r in packed:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spots in by.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) <= -(-sum(len(x) for _, x in ids) // 4096) + 2  # the bound and what no packing can fill


def test_best_fit_is_close_to_the_bound(spark):
    from meterwise.llm.packing import best_fit

    rng = np.random.default_rng(1)
    sizes = np.concatenate([rng.integers(1, 4097, 300), rng.integers(1, 300, 500), [4096] * 5, [64] * 40, [1] * 10]).tolist()
    items = spark.createDataFrame([(int(s), "x") for s in sizes], "length long, uid2 string")
    by = defaultdict(int)
    rows = best_fit(items).collect()
    for r in rows:
        by[r["sequence_id"]] += r["length"]
    assert len(rows) == len(sizes) and max(by.values()) <= 4096
    assert len(by) <= 1.03 * -(-sum(sizes) // 4096) + 1


def test_license_scan(spark, odd):
    from meterwise.llm.license_scan import best_template

    texts = dict(rows_of(spark, odd, "documents", "doc_id", "text"))
    for r in result(spark, odd, "op3_license_scan"):
        assert r["licenses"] == ("mit" if r["doc_id"] == 304 else "")
    assert best_template("Released under the MIT License.") == ("mit", 1.0) and texts[304]


def test_embeddings(spark, odd):
    data = rows_of(spark, odd, "embeddings", "vec_id", "embedding")
    unit = []
    for _, v in data:
        x = np.array(v if v is not None and None not in v else [], float)
        unit.append(x / np.linalg.norm(x) if len(x) and np.isfinite(x).all() and np.linalg.norm(x) > 0 else None)
    link = lambda a, b: a is not None and b is not None and len(a) == len(b) and a @ b >= 0.9
    near = [[j for j in range(len(data)) if j != i and link(unit[i], unit[j])] for i in range(len(data))]
    got = {r["vec_id"]: r for r in result(spark, odd, "op4_embedding_near_dedup")}
    for i, (vec, _) in enumerate(data):
        seen, todo = {i}, [i]
        while todo:
            new = [j for j in near[todo.pop()] if j not in seen]
            seen.update(new)
            todo += new
        low = min((data[j][0] for j in seen if data[j][0] is not None), default=None)
        assert (got[vec]["n_links"], got[vec]["component_id"], got[vec]["kept"]) == (len(near[i]), low, vec is not None and vec == low)


def test_sharding(spark, odd):
    docs = rows_of(spark, odd, "documents", "doc_id", "text")
    got = result(spark, odd, "op5_sharding")
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots, load = defaultdict(list), Counter()
    for r in got:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 40
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) <= sum(load.values()) / 40 + max(r["size"] for r in got)


def test_sharding_keeps_small_groups_whole_and_cuts_large_ones(spark):
    from meterwise.llm.sharding import SLACK, shard_by_bytes

    rng = random.Random(4)
    rows = [(i, f"text {i // 3} " + "x" * (i // 3 % 50)) for i in range(6000)]  # groups of three
    rows += [(None, "the same text of a third of all bytes, without an id") for _ in range(3000)]
    rows += [(2**63 - 1, "largest id"), (None, "largest id"), (None, None)]
    rng.shuffle(rows)
    got = shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), shards=10).collect()
    assert Counter((r["doc_id"], r["text_crc32"]) for r in got) == Counter((i, zlib.crc32((t or "").encode())) for i, t in rows)
    load, spread, size, slots = Counter(), defaultdict(set), Counter(), defaultdict(list)
    for r in got:
        load[r["shard"]] += r["size"]
        size[r["text_crc32"]] += r["size"]
        spread[r["text_crc32"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    mean = sum(load.values()) / 10
    assert all(len(spread[c]) == 1 for c in size if size[c] <= mean / SLACK)
    assert all(abs(load[s] - mean) <= mean / SLACK + 200 for s in range(10))
    assert len(spread[zlib.crc32(rows_text(rows))]) >= 3
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def rows_text(rows) -> bytes:
    """The commonest text."""
    return Counter(t for _, t in rows).most_common(1)[0][0].encode()


def test_line_dedup_gives_the_largest_id_back(spark):
    from meterwise.llm.line_dedup import dedup_lines

    rows = [(2**63 - 1, "a line that no other document holds"), (1, "another line that stands alone")]
    assert {r[0] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1, 2**63 - 1}


def test_contaminated(spark, odd):
    found = {(r["doc_id"], r["item_id"]) for r in result(spark, odd, "op7_benchmark_decontamination")}
    assert found == {(d, i) for d in (2, 400) for i in (1, 4)}


def test_decontamination_finds_what_a_scan_finds(spark):
    folder = "/root/testdata/sf0.001"
    norm = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    items = rows_of(spark, folder, "benchmark", "item_id", "text")
    docs = [(d, norm(t)) for d, t in rows_of(spark, folder, "documents", "doc_id", "text")]
    whole = {(d, i) for d, t in docs for i, x in items if norm(x) in t}
    assert whole <= {(r["doc_id"], r["item_id"]) for r in result(spark, folder, "op7_benchmark_decontamination")}


def test_block_max_wand_scores_like_a_full_scan():
    from meterwise.llm.decontamination import RETRIEVE, ItemIndex, normal_words

    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary, rng.integers(3, 12)))) for i in range(300)]
    index = ItemIndex(items)
    for _ in range(60):
        passage = {str(w) for w in rng.choice(vocabulary, 25)}
        want = {}
        for k, (_, text) in enumerate(index.items):
            score = sum(float(index.impacts[index.terms[t]][list(index.docs[index.terms[t]]).index(k)]) for t in set(normal_words(text)) if t in passage)
            if score >= RETRIEVE:
                want[k] = round(score, 9)
        got = index.search(np.array(sorted(index.terms[w] for w in passage if w in index.terms)))
        assert {k: round(s, 9) for k, s in got} == want


def test_simhash(spark, odd):
    docs = rows_of(spark, odd, "documents", "doc_id", "text")
    prints = []
    for _, t in docs:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sh = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    want = Counter()
    for i, (d, _) in enumerate(docs):
        seen, todo = {i}, [i]
        while todo:
            a = todo.pop()
            new = [j for j in range(len(docs)) if j not in seen and (prints[a] ^ prints[j]).bit_count() <= 2]
            seen.update(new)
            todo += new
        want[d, f"{prints[i]:016x}", min((docs[j][0] for j in seen if docs[j][0] is not None), default=None)] += 1
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in result(spark, odd, "op8_simhash_near_dedup")) == want


def test_vantage_point_tree_finds_all_near_pairs(spark):
    from meterwise.llm import simhash_dedup as S

    rng = np.random.default_rng(8)
    base = rng.integers(-2**63, 2**63, 3000, dtype=np.int64)
    close = base[:300] ^ (np.int64(1) << rng.integers(0, 62, 300)) ^ (np.int64(1) << rng.integers(0, 62, 300))
    chain = [int(base[7]) ^ ((1 << k) - 1) for k in range(0, 20, 2)]
    fps = sorted({*base.tolist(), *close.tolist(), *chain})
    old = S.LEAF, S.BLOCK
    S.LEAF, S.BLOCK = 64, 40
    try:
        links = S.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), 2)
        from meterwise.llm.components import connected_components

        got = {r["node"]: r["component"] for r in connected_components(links).collect()}
    finally:
        S.LEAF, S.BLOCK = old
    u = np.array(fps, np.int64).view(np.uint64)
    label = {f: f for f in fps}
    changed = True
    pairs = [(fps[i], fps[j]) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(u ^ u[i]) <= 2).tolist() if i < j]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    assert got == {f: c for f, c in label.items() if any(f in p for p in pairs)}


def test_line_dedup(spark, odd):
    docs = [(NO_ID if i is None else i, t or "") for i, t in rows_of(spark, odd, "documents", "doc_id", "text")]
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(BLANK))
    held = defaultdict(set)
    for i, t in docs:
        for line in t.split("\n"):
            held[key(line)].add(i)
    want = Counter()
    for i, t in docs:
        lines = t.split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 10 and len(held[key(x)]) >= 2 and i > min(held[key(x)]))]
        want[None if i == NO_ID else i, len(lines), len(lines) - len(kept), sha("\n".join(kept))] += 1
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in result(spark, odd, "op9_line_dedup")) == want


def brute_substrings(docs):
    first = {}
    for i, w in docs:
        for k in range(len(w) - 12):
            g = tuple(w[k:k + 13])
            first[g] = min(i, first.get(g, i))
    want = Counter()
    for i, w in docs:
        gone = {p for k in range(len(w) - 12) if first[tuple(w[k:k + 13])] < i for p in range(k, k + 13)}
        want[None if i == NO_ID else i, len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone))] += 1
    return want


@pytest.mark.parametrize("hot", [False, True])
def test_substring_dedup(spark, odd, hot, monkeypatch):
    from meterwise.llm import substring_dedup as S

    if hot:
        monkeypatch.setattr(S, "HOT_LEAST", 3)  # the passage's anchors take the way of hot ones
    docs = [(NO_ID if i is None else i, words(t)) for i, t in rows_of(spark, odd, "documents", "doc_id", "text")]
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in result(spark, odd, "op10_substring_dedup")) == brute_substrings(docs)


def test_embedding_link_between_dense_groups(spark):
    from meterwise.llm.embedding_dedup import near_duplicate_vectors

    # near copies of x and of y stand off to other sides, so x and y are the only linked pair of the two groups
    rng, n, dims = np.random.default_rng(3), 30, 128
    x, y = np.eye(dims)[0], 0.92 * np.eye(dims)[0] + np.sqrt(1 - 0.92**2) * np.eye(dims)[1]
    rows = [x, y]
    for centre, other in ((x, y), (y, x)):
        away = centre - other * (centre @ other)
        for _ in range(n):
            side = np.concatenate([[0, 0], rng.normal(size=dims - 2)])
            side = 0.12 * side / np.linalg.norm(side) + 0.25 * away / np.linalg.norm(away)
            rows.append(centre + side)
    rows = np.array([r / np.linalg.norm(r) for r in rows])
    links = (rows @ rows.T >= 0.9) & ~np.eye(len(rows), dtype=bool)
    across = links[np.ix_([0, *range(2, 2 + n)], [1, *range(2 + n, 2 + 2 * n)])]
    assert across.sum() == 1 and links[0, 1] and links.sum(1).min() >= n - 1
    table = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in near_duplicate_vectors(table).collect()}
    assert [got[i]["n_links"] for i in range(len(rows))] == links.sum(1).tolist()
    assert {r["component_id"] for r in got.values()} == {0} and [i for i in got if got[i]["kept"]] == [0]


def test_embedding_audit_is_by_vector_and_enforced(spark, monkeypatch):
    from meterwise.llm import embedding_dedup as E

    # 133 vectors of a dense group bring all their links, 10 sparse pairs are missed
    low, sparse = E._recalls([(1000, 1000)] * 133 + [(1, 0)] * 10)
    assert low < E.RECALL and sparse == 0
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.repeat(rng.normal(size=(20, 16)), 2, axis=0) + rng.normal(size=(40, 16)) * 0.01)], "vec_id long, embedding array<double>")
    none = spark.createDataFrame([], "a long, b long, s float")
    monkeypatch.setattr(E, "_first_graph", lambda vectors, seeds: none)
    monkeypatch.setattr(E, "REPAIRS", 1)
    with pytest.raises(RuntimeError, match="recall 0.0000"):
        E.near_duplicate_vectors(rows).collect()


def test_runs_with_half_a_context_hash_in_common_are_no_copies(spark):
    from meterwise.llm.substring_dedup import dedup_substrings

    # one anchor (the first four words), and contexts whose upper 32 bits agree
    texts = ["w314 w166 w397 w846 w302 w316 w136 w975 w539 w923 w731 w456 w279", "w314 w166 w397 w846 w383 w998 w563 w278 w51 w326 w553 w897 w106"]
    got = dedup_substrings(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["n_removed"], r["kept_text"]) for r in got} == {(i, 0, t) for i, t in enumerate(texts)}


def test_texts_without_id_keep_their_own_runs(spark):
    from meterwise.llm.substring_dedup import dedup_substrings

    # two texts without an id whose 32-bit hashes are equal; an earlier document has the first one's passage
    p, q = (" ".join(f"{x}{i}" for i in range(13)) for x in "pq")
    rows = [(1, p), (None, f"{p} 185754"), (None, f"{q} 893"), (None, f"{p} 185754")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert docs.selectExpr("hash(text)").distinct().count() == 2
    got = Counter((r["doc_id"], r["n_removed"], r["kept_text"]) for r in dedup_substrings(docs).collect())
    assert got == Counter([(1, 0, p), (None, 13, "185754"), (None, 13, "185754"), (None, 0, f"{q} 893")])


@pytest.mark.parametrize("size", [1100, 1600, 3000])
def test_long_benchmark_items_are_found_at_every_offset(size):
    import pyarrow as pa

    from meterwise.llm.decontamination import ItemIndex

    item = " ".join(f"i{k}" for k in range(size - 20)) + "? " + " ".join(f"a{k}" for k in range(20))
    index = ItemIndex([(7, item), (8, "a short item? yes it is")])
    offsets = range(0, 2 * size, 97)
    texts = [" ".join(f"d{k}" for k in range(at)) + f" {item} " + " ".join(f"e{k}" for k in range(500)) for at in offsets]
    assert [(text, k) for text, k, *_ in index.matches(pa.array(texts))] == [(n, 0) for n in range(len(texts))]


@pytest.mark.parametrize("low, high", [(1025, 1600), (1025, 2048), (513, 1024)])
def test_smaller_documents_of_a_class_fill_the_gaps_of_its_larger_ones(spark, low, high):
    from bisect import bisect_left, insort

    from meterwise.llm.packing import best_fit

    lengths = np.random.default_rng(1).integers(low, high + 1, 8000).tolist()
    gaps, n = [], 0  # best-fit-decreasing
    for length in sorted(lengths, reverse=True):
        at = bisect_left(gaps, length)
        n += at == len(gaps)
        gap = gaps.pop(at) if at < len(gaps) else 4096
        if gap > length:
            insort(gaps, gap - length)
    packed = best_fit(spark.createDataFrame([(x,) for x in lengths], "length long")).collect()
    load = Counter()
    for r in packed:
        load[r["sequence_id"]] += r["length"]
    assert sorted(r["length"] for r in packed) == sorted(lengths) and max(load.values()) <= 4096
    assert len(load) == n


def test_class_matches_are_best_fit_decreasing_and_few():
    from bisect import bisect_left, insort

    from meterwise.llm.packing import match_classes

    rng = np.random.default_rng(3)
    for capacity, lengths in [(16, rng.integers(1, 17, 200)), (64, rng.integers(1, 30, 500)), (4096, np.minimum(4096, rng.lognormal(6, 1, 3000).astype(int) + 1)),
                              (100, [34] * 7 + [33] * 5 + [1] * 9), (10, [10] * 4), (7, [1])]:
        sizes = sorted((int(x) for x in lengths), reverse=True)
        gaps, n = [], 0
        for length in sizes:
            at = bisect_left(gaps, length)
            n += at == len(gaps)
            gap = gaps.pop(at) if at < len(gaps) else capacity
            if gap > length:
                insort(gaps, gap - length)
        matches = match_classes(Counter(sizes), capacity)
        assert [m[0] for m in matches] == sorted({m[0] for m in matches})
        used = defaultdict(list)
        for rank, size in enumerate(sizes):
            first, of, each, sequence, offset = matches[max(i for i, m in enumerate(matches) if m[0] <= rank)]
            assert of == size
            used[sequence + (rank - first) // each].append((offset + (rank - first) % each * size, size))
        assert len(used) == n
        for spots in used.values():
            at = 0
            for offset, size in sorted(spots):
                assert offset == at
                at += size
            assert at <= capacity
    many = match_classes({s: 10**9 + s for s in range(1, 4097)}, 4096)
    assert len(many) < 2 * 4096 * 12


def test_every_reported_item_is_in_the_document(spark):
    from meterwise.llm.decontamination import OVERLAP, normal_words, shingles

    folder = "/root/testdata/sf0.001"
    items = defaultdict(list)
    for i, t in rows_of(spark, folder, "benchmark", "item_id", "text"):
        items[i].append(t)
    docs = dict(rows_of(spark, folder, "documents", "doc_id", "text"))
    found = result(spark, folder, "op7_benchmark_decontamination")
    assert found
    for r in found:
        held = shingles(normal_words(docs[r["doc_id"]]))
        assert any(len(shingles(normal_words(t)) & held) >= OVERLAP * len(shingles(normal_words(t))) for t in items[r["item_id"]])


def test_scores_do_not_depend_on_the_parts_of_the_benchmark(spark, monkeypatch):
    from meterwise.llm import decontamination as D

    folder = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    one = Counter((r[0], r[1], *(round(x, 9) for x in r[2:])) for r in D.contaminated(docs, items).collect())
    monkeypatch.setattr(D, "INDEX_BYTES", 4000)
    several = Counter((r[0], r[1], *(round(x, 9) for x in r[2:])) for r in D.contaminated(docs, items).collect())
    assert len(list(D.build_indexes(items))) > 1 and several == one


def test_short_items_prove_nothing(spark):
    from meterwise.llm.decontamination import contaminated

    docs = spark.createDataFrame([(1, "the man said is it raining today"), (2, "we add 2 2 apples")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Is it?"), (2, "2 + 2 = ?"), (3, "")], "item_id long, text string")
    assert contaminated(docs, items).collect() == []


def test_language_scores_are_those_of_a_plain_loop(spark):
    """Every window and filter by itself: the filters' largest answers, softmax, and the mean by bytes."""
    from meterwise.llm import language_id as L

    rng = random.Random(3)
    made = lambda s: " ".join("".join(rng.choice(s) for _ in range(rng.randint(2, 7))) for _ in range(60))
    net = L.train([(made("abcde"), "x") for _ in range(30)] + [(made("vwxyz"), "y") for _ in range(30)] + [(made("äöüßé"), "z") for _ in range(30)])

    def plain(text):
        raw = text.lower().encode()
        total, weight = np.zeros(len(net.langs)), 0
        for a in range(0, max(1, len(raw)), L.WINDOW):
            part = raw[a:a + L.WINDOW]
            data = part.ljust(L.WINDOW + max(L.WIDTHS) - 1, b"\0")
            top = np.full(net.conv.shape[1], -np.inf)
            for place in range(L.WINDOW):
                top = np.maximum(top, np.concatenate([net.embed[b] for b in data[place:place + max(L.WIDTHS)]]) @ net.conv)
            z = np.maximum(top + net.bias, 0) @ net.dense + net.offset
            total += np.exp(z - z.max()) / np.exp(z - z.max()).sum() * len(part)
            weight += len(part)
        return total / max(1, weight)

    texts = ["", "12 !", "a", made("abcde"), made("vwxyz") + " " + made("äöüßé"), made("äöüßé") * 5, "x" * L.WINDOW, "Y" * (L.WINDOW + 1), None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(2)
    for r in rows.select("t", L.predict(rows.t, net).alias("p")).collect():
        if not any(map(str.isalpha, r.t or "")):
            assert (r.p.lang_pred, r.p.score) == ("und", 0.0)
            continue
        want = plain(r.t)
        assert r.p.lang_pred == net.langs[int(want.argmax())] and abs(r.p.score - want.max()) < 1e-4


def test_license_scan_equals_plain_dictionaries(spark):
    """Probabilities by words and pairs one at a time, and the confirmation by triples, over whole, cut and made-up notices."""
    from meterwise.llm import license_scan as L

    rng = random.Random(8)
    corpus = [" ".join("".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(3, 40))) for _ in range(150)]
    model = L.train(corpus)
    notices = [t for f in L.FAMILIES for t in L.TEMPLATES[f]]
    paragraphs = corpus[:20] + notices + ["noted: " + t + " (see below)" for t in notices] + [" ".join(t.split()[:len(t.split()) // 2]) for t in notices]
    paragraphs += [t.format("Vanta Sol", 3) for t in L.OTHER_NOTICES] + ["we license this house for a fee", "", "   "]

    def plain(text):
        words = text.encode().split()
        h = [int(L._word_hash(w)) for w in words]
        features = [x % L.DIMS for x in h]
        features += [((a * 0x9E3779B97F4A7C15 + b) % 2**64 >> 20) % L.DIMS for a, b in zip(h, h[1:])]
        if not features:
            return np.eye(len(L.CLASSES))[L.CLASSES.index(L.NONE)]
        z = (sum(model.weights[f].astype(float) for f in features) / len(features) ** 0.5 + model.offset) / model.heat
        return np.exp(z - z.max()) / np.exp(z - z.max()).sum()

    import pyarrow as pa

    p = model.probabilities(pa.array(paragraphs, pa.large_string()))
    assert np.abs(p - np.array([plain(t) for t in paragraphs])).max() < 1e-5
    docs = spark.createDataFrame([(i, "\n".join(paragraphs[i:i + 3])) for i in range(0, len(paragraphs), 3)], "doc_id long, text string")
    got = {r[0]: r for r in docs.mapInArrow(L._scan(model), "doc_id long, n_paragraphs long, licenses array<string>, n_unknown long, score double").collect()}
    families = set()
    for i in range(0, len(paragraphs), 3):
        sure, unknown, score = set(), 0, 0.0
        for t in paragraphs[i:i + 3]:
            q = plain(t)
            if 1 - q[L.CLASSES.index(L.NONE)] < L.SURE:
                continue
            family, share = L.best_template(t)
            if q.max() >= L.SURE and L.CLASSES[int(q.argmax())] == family and share >= L.CONFIRM:
                sure.add(family)
                score = max(score, q.max())
            else:
                unknown += 1
        families |= sure
        r = got[i]
        assert (r.n_paragraphs, r.licenses, r.n_unknown) == (sum(bool(t.strip()) for t in paragraphs[i:i + 3]), sorted(sure), unknown)
        assert abs(r.score - score) < 1e-4
    assert families == set(L.FAMILIES)  # each family's own notice is found


def test_the_largest_id_is_an_id(spark):
    from meterwise.llm.simhash_dedup import keep_one
    from meterwise.llm.substring_dedup import dedup_substrings

    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(NO_ID, text), (None, text), (None, "some other words that nobody else has")], "doc_id long, text string")
    assert sorted(r.doc_id is None for r in keep_one(docs).collect()) == [False, True]
    assert {r.doc_id for r in keep_one(docs).collect()} == {NO_ID, None}
    assert Counter(r.doc_id for r in dedup_substrings(docs).collect()) == {NO_ID: 1, None: 2}
