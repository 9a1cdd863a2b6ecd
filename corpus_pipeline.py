"""A corpus pipeline in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet
and read again as the next stage's documents.  All but the last return the columns of
``documents``.

Every row is a document of its own: null texts count as empty, rows with a null doc_id are kept
unless their text is rejected, rows repeated in full share their fate.  Extra columns are carried
whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.llm.bpe import bpe_round_trip
from turnweave.llm.common import materialize, table
from turnweave.llm.contamination import drop_contaminated
from turnweave.llm.line_dedup import line_dedup
from turnweave.llm.near_dedup import keep_representatives
from turnweave.llm.queries import tokenizer_file
from turnweave.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go; without labels of both kinds none does."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more stay at their first place (by doc_id, then text) alone; every document stays, some empty."""
    found = line_dedup(docs, min_docs=10, min_chars=1, keep_first=True)
    named = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return found.select(*(named.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest doc_id; empty texts are in no group and stay."""
    return keep_representatives(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, null and empty items count for nothing."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), size=5, least=0.8)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's tokens and the text that they decode to, as digests; none for a null or empty text."""
    return bpe_round_trip(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("line_dedup", lines), ("near_dedup", near_duplicates), ("decontamination", decontamination), ("bpe", tokens)]

#: SQL can't express the stages.  ``tests/llm/test_pipeline.py`` holds each of them, and ``run``, against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
