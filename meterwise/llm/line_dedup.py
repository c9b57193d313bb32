"""Line dedup: lines that several documents hold stay only in the first of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

NO_ID = 2**63 - 1  # rows without an id count as one document after all others
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line):
    """The line without blanks at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10,
                min_docs: int = 2) -> DataFrame:
    """``(id, text_hash, n_lines, n_dropped, kept_text)``, one row for each row of ``docs``.

    Explode the normalised lines, hash them to 128 bits, count each hash's distinct documents and its smallest
    one, drop the lines of hashes over the threshold outside that one, and join what stays by position.

    A null or empty text is one empty line.  A null id counts as the largest id.  Repeated rows are one document;
    two texts under one id are too.  Very long texts and lines are taken whole.  Other columns are not read, whatever
    their names.  An empty table gives no rows.  Only hashes, ids and positions are shuffled by line; a hot line is combined
    before its shuffle, and its occurrences only meet the one row of its hash (an inner join that adaptive
    execution splits).  Texts are shuffled once, by id.
    """
    full = _kept(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(id_col).alias("given")), min_chars, min_docs)
    return full.select(
        F.col("given").cast("long").alias("doc_id"),
        F.col("th").alias("text_hash"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_dropped"),
        "kept_text",
    )


def keep_first_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars",
                     min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``docs`` with the texts that ``dedup_lines`` leaves; ``chars_col``, if there, counts their characters anew.
    A null text stays null; the other columns stay as they are, whatever their names."""
    full = _kept(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(text_col).isNull().alias("no_text"),
                             F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row")),
                 min_chars, min_docs)
    text = F.when(~F.col("no_text"), F.col("kept_text"))
    new = {text_col: text, chars_col: F.char_length(text).cast(docs.schema[chars_col].dataType) if chars_col in docs.columns else None}
    return full.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def _kept(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """``(did, th, lines, gone, kept_text)`` and whatever else ``docs`` (id, text, ...) carries."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumns({"did": F.coalesce(F.col("id").cast("long"), F.lit(NO_ID)), "th": F.xxhash64(text), "lines": F.split(text, "\n", -1)}).drop("id", "text")
    keys = (rows.select("did", "th", F.posexplode("lines").alias("pos", "line"))
            .select("did", "th", "pos", line_key(F.col("line")).alias("k"))
            .where(F.char_length("k") >= min_chars)
            .select("did", "th", "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(1), "k").alias("h2")))
    if min_docs == 2:  # at least two documents: the smallest is not the largest
        shared = keys.groupBy("h1", "h2").agg(F.min("did").alias("first"), F.max("did").alias("last")).where("first < last")
    else:
        shared = (keys.select("h1", "h2", "did").distinct().groupBy("h1", "h2")
                  .agg(F.min("did").alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs))
    dropped = (keys.join(shared.select("h1", "h2", "first"), ["h1", "h2"]).where("did > first")
               .groupBy("did", "th").agg(F.collect_set("pos").alias("gone")))
    full = rows.join(dropped, ["did", "th"], "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    return full.withColumn("kept_text", F.array_join(F.transform(stay, lambda p: F.get("lines", p)), "\n"))
