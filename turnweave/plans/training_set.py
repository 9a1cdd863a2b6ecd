"""Which rows make up the training set under per-source hour caps, and how many hours that is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.operators.corpus import cap_hours, train_eval_split


def training_set(manifest: DataFrame, hours: DataFrame, seed: int = 42) -> DataFrame:
    """split, dataset (TOTAL for all), entries, hours of the capped and split manifest."""
    split = train_eval_split(cap_hours(manifest, hours, seed), seed)
    by = split.rollup("split", "source").agg(F.count(F.lit(1)).alias("entries"), (F.sum("duration") / 3600).alias("hours"), F.grouping("split").alias("g"), F.grouping("source").alias("h"))
    return by.where("g = 0").select("split", F.when(F.col("h") == 1, "TOTAL").otherwise(F.col("source")).alias("dataset"), "entries", "hours")
