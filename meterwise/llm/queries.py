"""The numbered queries over the synthetic tables, each a thin digest of its operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from .centroids import cluster_vectors, with_inertia
from .decontamination import contaminated
from .embedding_dedup import near_duplicate_vectors
from .language_id import identify
from .license_scan import scan_licenses
from .line_dedup import dedup_lines
from .packing import pack
from .scratch import ship
from .secret_scan import ALLOW, ALLOW_AFTER, CLASSES, MIXED, PATTERNS, digest, most, scan_secrets, weights
from .sharding import shard_by_bytes
from .simhash_dedup import near_duplicates
from .source_audit import source_divergence
from .substring_dedup import dedup_substrings
from .token_counts import context_totals, length_histogram

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_totals(length_histogram(table(spark, sf_dir, "documents"), TOKENIZER))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.withColumn("licenses", F.array_join("licenses", ","))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"), shards=40)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), TOKENIZER, end_id=1, capacity=4096)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents"), min_chars=10, min_docs=2)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(table(spark, sf_dir, "documents"), window=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))

    def of(*kinds: str):
        return F.filter("secrets", lambda s: s["kind"].isin(*kinds))

    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(digest(of("assign", "access", "hex")).cast("binary"), 256).alias("base_sha256"),
                        digest(F.col("secrets")).alias("spans"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(*cluster_vectors(table(spark, sf_dir, "embeddings"), k=16, rounds=3, seed=1, dimensions=64, scale=64))


def op13_source_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"), least_docs=3, top=200)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_id, op2_token_counts, op3_license_scan, op4_embedding_near_dedup, op5_sharding, op6_best_fit_packing, op7_benchmark_decontamination, op8_simhash_near_dedup, op9_line_dedup, op10_substring_dedup,
                            op11_secret_scan, op12_centroid_clustering, op13_source_divergence_audit)
}

BLANK = r"[\x20\x09-\x0D]"

ORACLE: dict[str, str] = {
    "op9_line_dedup": rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^{BLANK}+', ''), '{BLANK}+$', ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, k.pos, k.line, (s.key IS NOT NULL AND k.doc_id > s.first) AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op10_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
y AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 12), ' ')) AS g FROM x),
f AS (SELECT g, min(doc_id) AS first FROM y GROUP BY g),
c AS (SELECT DISTINCT y.doc_id, unnest(range(y.i, y.i + 13)) AS p FROM y JOIN f USING (g) WHERE y.doc_id > f.first),
p AS (SELECT doc_id, w[i] AS word, i AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
m AS (SELECT p.doc_id, p.word, p.p, c.p IS NOT NULL AS gone FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.p = c.p)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, count(m.p) FILTER (WHERE m.gone)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(m.word, ' ' ORDER BY m.p) FILTER (WHERE NOT m.gone), '')) AS kept_sha256
FROM d LEFT JOIN m ON d.doc_id = m.doc_id GROUP BY d.doc_id, d.w""",
}


def _found(kind: str, no: int, regex: str, keep: str) -> str:
    """All matches of a pattern with their places: running lengths of what lies between them and of themselves."""
    regex = regex.replace("'", "''")
    return f"""{kind} AS (SELECT doc_id, row, '{kind}' AS kind, {no} AS no, label, m,
    sum(length(g) + length(m)) OVER (PARTITION BY row ORDER BY i) AS e,
  FROM (SELECT doc_id, row, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, unnest(range(len(ms))) AS i, right(g, 8) AS label
        FROM (SELECT doc_id, row, regexp_extract_all(text, '{regex}') AS ms, string_split_regex(text, '{regex}') AS gs FROM d) WHERE len(ms) > 0)
  QUALIFY {keep})"""


def _secret_sql() -> str:
    """The scan with every window's counts made anew."""
    assign, access, hexa = PATTERNS
    tables = [_found("assign", 0, assign.regex, f"length(regexp_extract(m, '{assign.regex.replace(chr(39), chr(39) * 2)}', 1)) >= 6"),
              _found("access", 1, "AKIA[A-Z0-9]+", "length(m) >= 20"), _found("hex", 2, "[0-9a-f]+", "length(m) >= 24")]
    spans = ["SELECT doc_id, row, kind, no, e - length(m) AS s, e FROM assign", "SELECT doc_id, row, kind, no, e - length(m), e FROM access",
             "SELECT doc_id, row, kind, no, e - length(m), e FROM hex"]
    allow = "|".join(ALLOW)
    for no, c in enumerate(CLASSES, 3):
        tables.append(_found(c.kind, no, f"[{c.alphabet}]+", f"length(m) >= {c.window} AND regexp_matches(m, '{MIXED}') AND NOT regexp_matches(m, '{allow}') AND NOT regexp_matches(label, '{ALLOW_AFTER}')"))
        tables.append(f"""{c.kind}_w AS (SELECT row, e, i, ch, count(*) AS n FROM (SELECT row, e, i, unnest(string_split(substr(m, i + 1, {c.window}), '')) AS ch
  FROM (SELECT row, e, m, unnest(range(length(m) - {c.window - 1})) AS i FROM {c.kind})) GROUP BY ALL)""")
        tables.append(f"""{c.kind}_h AS (SELECT DISTINCT row, e FROM (SELECT row, e, i FROM {c.kind}_w GROUP BY ALL HAVING sum(({weights(c.window)})[n + 1]) <= {most(c)}))""")
        spans.append(f"SELECT doc_id, row, kind, no, e - length(m), e FROM {c.kind} SEMI JOIN {c.kind}_h USING (row, e)")
    return f"""WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS text FROM documents),
{(',' + chr(10)).join(tables)},
spans AS ({' UNION ALL '.join(spans)}),
t AS (SELECT row, no, s, concat_ws(':', kind, s, e) AS span FROM spans),
a AS (SELECT row, count(*) FILTER (WHERE no = 0) AS n_assign, count(*) FILTER (WHERE no = 1) AS n_access, count(*) FILTER (WHERE no = 2) AS n_hex,
  string_agg(span, ',' ORDER BY s, no) FILTER (WHERE no < 3) AS base, string_agg(span, ',' ORDER BY s, no) AS spans FROM t GROUP BY row)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (row)"""


def _cluster_sql(rounds: int) -> str:
    """Whole distances of all vectors and centroids, component by component."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""dist{r} AS (SELECT x.row, c.k, sum((x.q - c.q) * (x.q - c.q)) AS dist FROM x JOIN c{r} c ON x.d = c.d GROUP BY ALL),
near{r} AS (SELECT row, k, dist FROM dist{r} QUALIFY row_number() OVER (PARTITION BY row ORDER BY dist, k) = 1)""")
        if r < rounds:
            steps.append(f"""sum{r} AS (SELECT k, d, sum(q)::HUGEINT AS s, count(*)::HUGEINT AS n FROM x JOIN near{r} USING (row) GROUP BY ALL),
c{r + 1} AS (SELECT c.k, c.d, coalesce((s - ((s % n) + n) % n) // n, c.q)::HUGEINT AS q FROM c{r} c LEFT JOIN sum{r} USING (k, d))""")
    return f"""WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::HUGEINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
x AS MATERIALIZED (SELECT row, unnest(q) AS q, unnest(range(64)) AS d FROM v),
first AS (SELECT row, row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), q) - 1 AS k FROM v QUALIFY k < 16),
c0 AS (SELECT k, d, q FROM x JOIN first USING (row)),
{(',' + chr(10)).join(steps)},
t AS (SELECT k, sum(dist) AS own FROM near{rounds} GROUP BY k),
h AS (SELECT k, sha256(string_agg(q::VARCHAR, ',' ORDER BY d)) AS hash FROM c{rounds} GROUP BY k)
SELECT vec_id, k::INTEGER AS cluster, dist::BIGINT AS distance, own::BIGINT AS cluster_inertia, (SELECT sum(own) FROM t)::BIGINT AS inertia, hash AS centroid_sha256
FROM v JOIN near{rounds} USING (row) JOIN t USING (k) JOIN h USING (k)"""


ORACLE |= {
    "op11_secret_scan": _secret_sql(),
    "op12_centroid_clustering": _cluster_sql(3),
    "op13_source_divergence_audit": r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT row, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT row) >= 3),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(term)::HUGEINT AS v FROM (SELECT DISTINCT lang FROM d) LEFT JOIN k USING (lang) GROUP BY lang),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS held, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (s.n + v.v) AS p
  FROM s JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
l AS (SELECT k.lang, k.term, 1 + (1000000000 * (sum(c.n) + 1)::HUGEINT) // (any_value(t.n) + any_value(v.v)) AS q
  FROM k JOIN c USING (lang, term) JOIN v USING (lang) JOIN (SELECT lang, sum(n)::HUGEINT AS n FROM s GROUP BY lang) t USING (lang) GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS other, sum((a.p - b.p) * (a.p - b.p) // b.p) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
  ON x.lang = a.lang AND x.source = a.source AND x.other = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, ((p.p - q) * (p.p - q) // q)::BIGINT AS value FROM p JOIN l USING (lang, term) WHERE held > 0 AND p.p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 200""",
}
