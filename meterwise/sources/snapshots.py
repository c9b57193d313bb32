"""Snapshot sources: landing files, pushed bodies, the source registry (A-S1, A-S2, A-S4).

A snapshot is ``collected_at, node_id, env, samples[]`` with cumulative counters per
(uuid, inbound).  Landing files are newline-delimited JSON read with a fixed schema
(no inference); pushed bodies may be one object, a JSON array of objects, or several
concatenated / newline-delimited objects, as the ingest endpoint accepts them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterwise.config import REJECT_EXCERPT_LIMIT, SOURCE_TIMEOUT_DEFAULT_SECONDS
from meterwise.functions.text import excerpt, go_trim

SAMPLE_SCHEMA = T.StructType([
    T.StructField("uuid", T.StringType()),
    T.StructField("email", T.StringType()),
    T.StructField("inbound_tag", T.StringType()),
    T.StructField("uplink_bytes_total", T.LongType()),
    T.StructField("downlink_bytes_total", T.LongType()),
])
SNAPSHOT_SCHEMA = T.StructType([
    T.StructField("collected_at", T.TimestampType()),
    T.StructField("node_id", T.StringType()),
    T.StructField("env", T.StringType()),
    T.StructField("samples", T.ArrayType(SAMPLE_SCHEMA)),
])
REGISTRY_SCHEMA = T.ArrayType(T.StructType([
    T.StructField("source_id", T.StringType()),
    T.StructField("base_url", T.StringType()),
    T.StructField("expected_node_id", T.StringType()),
    T.StructField("expected_env", T.StringType()),
    T.StructField("enabled", T.BooleanType()),
    T.StructField("timeout_seconds", T.IntegerType()),
]))

# Body rejection reasons.
REASON_EMPTY = "empty body"
REASON_EMPTY_ARRAY = "empty snapshot array"
REASON_MALFORMED = "malformed snapshot"


def read_landing(spark: SparkSession, path: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """A-S1: snapshots from newline-delimited JSON files, optionally in the closed window
    ``[since, until]`` (the filter is applied right after the scan)."""
    df = spark.read.schema(SNAPSHOT_SCHEMA).json(path)
    if since is not None:
        df = df.filter(F.col("collected_at") >= F.lit(since).cast("timestamp"))
    if until is not None:
        df = df.filter(F.col("collected_at") <= F.lit(until).cast("timestamp"))
    return df


def flatten(snapshots: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Snapshots -> inbound entries (one row per sample, ``pos`` = index in the array)."""
    x = snapshots.select(
        *keep,
        F.col("collected_at").cast("timestamp_ntz").alias("collected_at"),
        "node_id",
        "env",
        F.posexplode_outer("samples").alias("pos", "s"),
    ).filter(F.col("s").isNotNull())
    return x.select(
        *keep, "collected_at", "node_id", "env", "pos",
        F.col("s.uuid").alias("uuid"),
        F.col("s.email").alias("email"),
        F.col("s.inbound_tag").alias("inbound_tag"),
        F.coalesce(F.col("s.uplink_bytes_total"), F.lit(0)).alias("uplink_bytes_total"),
        F.coalesce(F.col("s.downlink_bytes_total"), F.lit(0)).alias("downlink_bytes_total"),
    )


def _objects(text: Column) -> Column:
    """Concatenated JSON objects -> array of their texts.  Quotes divide the text into parts outside and inside of
    strings by turns; only outside parts are searched for ``} {``.  Escapes and cuts are marked by control characters,
    which no JSON text may hold; a text that holds them is left in one piece."""
    marked = F.replace(F.replace(text, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))
    parts = F.transform(
        F.split(marked, '"', -1),
        lambda p, i: F.when(i % 2 == 0, F.regexp_replace(p, r"\}\s*\{", "}\x03{")).otherwise(p),
    )
    joined = F.replace(F.replace(F.array_join(parts, '"'), F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))
    one = ~text.rlike(r"\}\s*\{") | text.rlike("[\x01-\x03]")  # without a ``} {`` at all there is nothing to cut
    return F.when(one, F.array(text)).otherwise(F.split(joined, "\x03", -1))


def decode_bodies(bodies: DataFrame, id_col: str = "body_id", body_col: str = "body") -> tuple[DataFrame, DataFrame]:
    """A-S2 + A-S3: pushed bodies -> (snapshots, rejects).

    Every body is decoded whole.  An array body is split into its elements, another body
    between its objects (``}``, optional white space, ``{``, outside of strings), and each
    piece is decoded alike.  A body with any piece that does not decode is rejected whole,
    with a reason and a bounded excerpt.
    """
    t = go_trim(F.col(body_col))
    # The bodies' own column and one-element ``explode`` keep Catalyst from copying these expressions into each of
    # their uses, filters among them: a body is trimmed, cut and parsed once.
    b = bodies.select(id_col, F.explode(F.array(t)).alias("__t"))
    is_array = F.substring("__t", 1, 1) == "["
    elements = F.from_json("__t", T.ArrayType(T.StringType()))
    pieces = _objects(F.col("__t"))
    # malformed objects fill the corrupt-record field instead of yielding all-null rows
    probe = T.StructType(SNAPSHOT_SCHEMA.fields + [T.StructField("_corrupt_record", T.StringType())])
    opts = {"columnNameOfCorruptRecord": "_corrupt_record"}

    def parse(p):
        return F.struct((F.substring(p, 1, 1) == "{").alias("object"), F.from_json(p, probe, opts).alias("d"))

    parsed = F.transform(F.when(is_array, elements).otherwise(pieces), parse)
    b = b.select(id_col, "__t", F.explode(F.array(F.when(F.length("__t") > 0, parsed))).alias("__p"))

    def is_bad(p):
        return ~F.coalesce(p["object"] & p["d"]["_corrupt_record"].isNull(), F.lit(False))

    reason = (
        F.when(F.length("__t") == 0, F.lit(REASON_EMPTY))
        .when(F.col("__p").isNull() | F.exists("__p", is_bad), F.lit(REASON_MALFORMED))
        .when(F.size("__p") == 0, F.lit(REASON_EMPTY_ARRAY))
    )
    b = b.withColumn("reason", reason)
    rejects = b.filter(F.col("reason").isNotNull()).select(
        id_col, "reason", excerpt(F.col("__t"), REJECT_EXCERPT_LIMIT).alias("excerpt")
    )
    good = b.filter(F.col("reason").isNull()).select(id_col, F.posexplode("__p").alias("snapshot_index", "snap"))
    return good.select(id_col, "snapshot_index", *[F.col(f"snap.d.{f.name}") for f in SNAPSHOT_SCHEMA.fields]), rejects


def load_registry(config: DataFrame, json_col: str = "sources_json", legacy_url_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A-S4: the exporter source list -> (sources, errors).

    Trimmed fields, ``enabled`` defaults to true, a non-positive timeout becomes the
    default, trailing ``/`` is stripped from the URL; a blank id or URL is an error row.
    With no list but a legacy single URL, that URL becomes source ``default``.
    """
    parsed = config.select(F.from_json(F.col(json_col), REGISTRY_SCHEMA).alias("lst"),
                           *( [go_trim(F.col(legacy_url_col)).alias("legacy")] if legacy_url_col else [F.lit(None).cast("string").alias("legacy")]))
    legacy_row = F.array(F.struct(
        F.lit("default").alias("source_id"), F.col("legacy").alias("base_url"),
        F.lit(None).cast("string").alias("expected_node_id"), F.lit(None).cast("string").alias("expected_env"),
        F.lit(True).alias("enabled"), F.lit(None).cast("int").alias("timeout_seconds"),
    ))
    use = F.when(F.coalesce(F.size("lst"), F.lit(0)) > 0, F.col("lst")).when(
        F.coalesce(F.col("legacy"), F.lit("")) != "", legacy_row
    )
    rows = parsed.select(F.explode_outer(use).alias("s"))
    out = rows.select(
        go_trim(F.col("s.source_id")).alias("source_id"),
        F.regexp_replace(go_trim(F.col("s.base_url")), "/+$", "").alias("base_url"),
        go_trim(F.col("s.expected_node_id")).alias("expected_node_id"),
        go_trim(F.col("s.expected_env")).alias("expected_env"),
        F.coalesce(F.col("s.enabled"), F.lit(True)).alias("enabled"),
        F.when(F.coalesce(F.col("s.timeout_seconds"), F.lit(0)) <= 0, F.lit(SOURCE_TIMEOUT_DEFAULT_SECONDS))
        .otherwise(F.col("s.timeout_seconds")).alias("timeout_seconds"),
    )
    err = (
        F.when(F.col("source_id").isNull() & F.col("base_url").isNull(), F.lit("no exporter sources configured"))
        .when(F.coalesce(F.col("source_id"), F.lit("")) == "", F.lit("exporter source_id is required"))
        .when(F.coalesce(F.col("base_url"), F.lit("")) == "", F.lit("exporter base_url is required"))
    )
    out = out.withColumn("error", err)
    return out.filter(F.col("error").isNull()).drop("error"), out.filter(F.col("error").isNotNull())
