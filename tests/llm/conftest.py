import random

import pytest
from pyspark.sql import types as T

CLASH = ["row", "id", "did", "th", "h", "k", "fp", "lines", "gone", "size", "rank", "shard", "component_id", "p", "text_hash", "unit", "c"]


def documents(spark, rows):
    """doc_id, text, lang, source, n_chars and columns that clash with the operators' own names."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                           T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
                          + [T.StructField(c, T.StringType()) for c in CLASH])
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) + ("x",) * len(CLASH) for i, t, lang in rows], schema)


def odd_rows():
    rng = random.Random(5)
    vocabulary = {"en": [f"the{a}{b}" for a in "kmnprst" for b in ("ing", "ough", "ly", "er")], "de": [f"{a}ü{b}" for a in "kmnprst" for b in ("ung", "cht", "sch", "ei")]}
    some = lambda lang, n: " ".join(rng.choice(vocabulary[lang]) for _ in range(n))
    rows = [(i, some(lang, rng.randint(1, 60)) + "\n" + some(lang, 20), lang) for i, lang in enumerate(["en", "de"] * 15)]
    passage = some("en", 50)
    rows += [(100 + i, f"{some('en', 9)}\n{passage}\n{some('en', 7)}", "en") for i in range(6)]  # one passage, one line
    rows += [(120 + i, rows[0][1], "en") for i in range(5)] + [rows[0], rows[1]]  # copies under other ids, repeated rows
    rows += [(200, None, "en"), (201, "", "en"), (202, " \t\n ", "de"), (203, "12 345 !!", None), (204, None, None), (205, "a", "en")]
    rows += [(None, rows[0][1], "en"), (None, None, None), (None, some("de", 30), "de")]
    rows += [(300, some("en", 30), "en"), (300, some("en", 30), "en")]  # two texts under one id
    rows += [(301, some("en", 9000), "en"), (302, "x" * 50_000, "en"), (303, "word " * 3000, "en"), (304, "Released under the MIT License.\nall good", "en")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """A folder of small tables with every odd case."""
    folder = str(tmp_path_factory.mktemp("odd"))
    rows = odd_rows()
    item = rows[2][1].replace("\n", ". ")
    rows.append((400, f"before {item} after", "en"))
    documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, "abc def"), (3, "!!"), (3, ""), (4, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    rng = random.Random(2)
    base = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(40)]
    near = [[x + rng.gauss(0, 0.02) for x in base[0]] for _ in range(20)]
    vectors = base + near + [base[1], base[1], [2 * x for x in base[1]], [0.0] * 16, None, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], []]
    ids = [*range(len(vectors) - 1), None]
    spark.createDataFrame([(i, v, 0, "x", "y", 1) for i, v in zip(ids, vectors)], "vec_id long, embedding array<float>, label int, unit string, c string, n int").write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.fixture(scope="session")
def empty(spark, odd, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "benchmark", "embeddings"):
        spark.read.parquet(f"{odd}/{t}.parquet").where("false").write.parquet(f"{folder}/{t}.parquet")
    return folder
