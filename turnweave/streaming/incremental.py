"""Incremental runs and live utterances."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.sources.versions import KeyedTable


def run_incremental(spark: SparkSession, source: str, schema: str, op: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str) -> None:
    """``op`` on files of ``source`` that no earlier run has seen, appended to the ``KeyedTable`` under ``out``; rows whose key is there already stay out.

    A batch that is repeated, since a run ended between its write and the stream's own note of
    it, does nothing; a batch that ended before it was whole counts for nothing and comes again.
    Only the keys of the buckets that a batch touches are read.  ``read_incremental`` reads it.
    """
    ledger = KeyedTable(spark, out, [key])
    append = lambda batch, number: ledger.append(op(batch), checkpoint, number)
    stream = spark.readStream.schema(schema).json(source)
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(append).start().awaitTermination()


def read_incremental(spark: SparkSession, out: str, key: str) -> DataFrame:
    """What all whole batches have appended."""
    return KeyedTable(spark, out, [key]).read()


def live_utterances(words: DataFrame, gap: float = 1.2, late: str = "10 seconds") -> DataFrame:
    """Utterances of a word stream (sample_id, ts, start, end, word): a session ends when no word comes for its length and ``gap``.

    Closed sessions come out in append mode; words behind the watermark are dropped.
    """
    length = F.concat(F.ceil((F.greatest(F.col("end") - F.col("start"), F.lit(0.0)) + gap) * 1000).cast("string"), F.lit(" milliseconds"))
    session = F.session_window("ts", length)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "word"))), lambda w: w["word"]), " ")
    return words.withWatermark("ts", late).groupBy("sample_id", session).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_words"), text.alias("text")).drop("session_window")
