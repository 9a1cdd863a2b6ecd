"""Line dedup, with DataFrame functions alone.

Hashed lines are range-partitioned by (hash, document) and sorted by (hash, document, row,
position) inside each partition.  The first occurrence of a line in each document is then
found while streaming through a partition; as the document is part of the range key, a line
that a third of all documents hold spreads over many partitions.  One row for each (hash,
document) goes on into a count with partial sums.  What comes back is a compressed bitmap of
kept lines for each document, as runs (start, length); texts are only touched by
:func:`apply_keep_runs`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents_of, materialize, quoted, same

#: The white space of a line's key.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """White space off both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_keep_runs(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """Which lines of each document stay.

    Keys (see :func:`line_key`) of ``min_chars`` code points or more, found in ``min_docs``
    documents or more, lose their lines everywhere; with ``keep_first`` the first line by
    (doc_id, text hash, position) stays.  Returns doc_id, text_hash, n_lines, n_dropped,
    keep_runs array<struct<start, length>>, the kept lines as a run-length bitmap, and with
    them text and row (a struct of the input's other columns, for callers that want them; null without any).

    Null or empty text: one empty line, kept.  Rows that repeat a document in full get the
    same runs and count once; rows with one doc_id and other texts are judged apart and count
    as one document.  Null doc_ids count as one document together.  An empty table gives one
    with no rows.
    """
    base = documents_of(docs).withColumn("text_hash", F.xxhash64("text"))
    lines = (
        base.select("doc_id", "text_hash", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
        .withColumn("key", line_key(F.col("line")))
        .where(F.length("key") >= min_chars)
        .select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))
    )
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = lines.repartitionByRange(n, "h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "text_hash", "pos")
    in_doc = Window.partitionBy("h1", "h2", "doc_id").orderBy("text_hash", "pos")
    ordered = materialize(ordered.withColumn("first", F.row_number().over(in_doc) == 1), "lines")
    found = (
        ordered.where("first")
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.min(F.struct("doc_id", "text_hash", "pos")).alias("origin"))
        .where(F.col("n_docs") >= min_docs)
    )
    dropped = ordered.join(materialize(found, "frequent-lines"), ["h1", "h2"])
    if keep_first:
        here = F.struct("doc_id", "text_hash", "pos")
        dropped = dropped.where(~same(here, F.col("origin")))
    lost = dropped.groupBy(F.col("doc_id").alias("lost_id"), F.col("text_hash").alias("lost_hash")).agg(F.sort_array(F.collect_set("pos")).alias("lost"))
    text = F.coalesce(F.col("text"), F.lit(""))
    names = [quoted(c) for c in docs.columns if c not in ("doc_id", "text")]
    others = F.struct(*map(F.col, names)) if names else F.lit(None)
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.size(lines_of(text)).cast("long").alias("n_lines"), text.alias("text"), others.alias("row"))
    joined = sized.join(lost, same(F.col("doc_id"), F.col("lost_id")) & (F.col("text_hash") == F.col("lost_hash")), "left")
    lost_or_none = F.coalesce("lost", F.array().cast("array<int>"))
    return joined.select(
        "doc_id", "text_hash", "n_lines", F.size(lost_or_none).cast("long").alias("n_dropped"),
        keep_runs(lost_or_none, F.col("n_lines").cast("int")).alias("keep_runs"), "row", "text",
    )


def keep_runs(lost: Column, n: Column) -> Column:
    """The gaps between the sorted positions ``lost`` of 0..n-1, as (start, length)."""
    bounds = F.concat(F.array(F.lit(-1)), lost, F.array(n))
    gaps = F.transform(
        F.slice(bounds, 2, F.size(lost) + 1),
        lambda hi, i: F.struct((F.get(bounds, i) + 1).alias("start"), (hi - F.get(bounds, i) - 1).alias("length")),
    )
    return F.filter(gaps, lambda g: g["length"] > 0)


def apply_keep_runs(text: Column, runs: Column) -> Column:
    """The text without the lines outside the runs."""
    lines = lines_of(text)
    return F.array_join(F.flatten(F.transform(runs, lambda r: F.slice(lines, r["start"] + 1, r["length"]))), "\n")


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """``line_keep_runs`` with the kept text beside it, as ``kept_text``."""
    runs = line_keep_runs(docs, min_docs, min_chars, keep_first)
    return runs.withColumn("kept_text", F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(apply_keep_runs(F.col("text"), F.col("keep_runs"))))
