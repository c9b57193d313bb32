"""The pipeline's stages: what each keeps of odd rows, and the whole run."""

from collections import Counter

import corpus_pipeline as P


def test_stages_on_odd_rows(spark, odd, tmp_path):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    columns = docs.columns
    seen = {}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, odd)
        if k < len(P.STAGES) - 1:
            assert out.columns == columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = docs
    ids = {n: Counter(r["doc_id"] for r in d.select("doc_id").collect()) for n, d in seen.items()}
    assert not {200, 201, 202, 203, 204} & set(ids["language_id"])  # no letters
    assert ids["line_dedup"] == ids["language_id"]
    assert not {121, 122, 123, 124} & set(ids["simhash_near_dedup"]) or ids["simhash_near_dedup"][0] == 1
    assert 400 not in ids["benchmark_decontamination"] and 2 not in ids["benchmark_decontamination"]
    assert set(ids["best_fit_packing"]) == set(ids["benchmark_decontamination"])
    for r in seen["line_dedup"].select("text", "n_chars").collect():
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))


def test_keep_one_keeps_the_smallest_of_a_group(spark, odd):
    from meterwise.llm.simhash_dedup import keep_one, near_duplicates

    docs = spark.read.parquet(f"{odd}/documents.parquet")
    groups = {r["component_fp"] for r in near_duplicates(docs).collect()}
    kept = keep_one(docs).collect()
    assert len(kept) == len(groups) and Counter(r["doc_id"] for r in kept)[0] == 1


def test_stages_on_empty_tables(spark, empty):
    docs = spark.read.parquet(f"{empty}/documents.parquet")
    for _, stage in P.STAGES:
        assert stage(spark, docs, empty).count() == 0


def test_run_is_the_stages_in_order(spark, odd):
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    out = P.run(spark, odd)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0
