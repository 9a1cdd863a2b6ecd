"""Sinks.  Spark's commit protocol makes each write all or nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.sources.versions import KeyedTable


def write_manifests(manifest: DataFrame, out: str, form: str = "parquet") -> None:
    """K1: train, eval and combined manifests of rows with a column split."""
    for name in ("train", "eval"):
        manifest.where(F.col("split") == name).drop("split").write.mode("overwrite").format(form).save(f"{out}/{name}")
    manifest.write.mode("overwrite").format(form).save(f"{out}/combined")


def save_docs(docs: DataFrame, out: str, key: tuple[str, ...] = ("category", "id")) -> None:
    """K2: each document takes the place of the one with its key, or is added; others stay.  Readers (``load_docs``) see all of a save or nothing of it."""
    KeyedTable(docs.sparkSession, out, list(key)).upsert(docs)


def load_docs(spark: SparkSession, out: str, key: tuple[str, ...] = ("category", "id")) -> DataFrame:
    """K2: the documents of the last whole save."""
    return KeyedTable(spark, out, list(key)).read()


def write_scores(scores: DataFrame, out: str) -> None:
    """K3: a score table as CSV with a header."""
    scores.write.mode("overwrite").option("header", True).csv(out)


def write_filtered(scored: DataFrame, condition: str, columns: list[str], out: str) -> None:
    """K4: the original columns of rows that pass."""
    scored.where(condition).select(*columns).write.mode("overwrite").json(out)
