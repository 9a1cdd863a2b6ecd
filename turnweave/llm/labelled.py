"""A bounded sample of labelled documents, for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents_of


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, trains: Column, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, label, text of at most ``per_class`` labelled documents of each class, and how many rows each class has in all.

    ``trains`` is a condition on doc_id.  Which rows are taken depends on a hash of doc_id
    alone.  A doc_id with both labels, or a null one, or a label other than 0 and 1, is left
    out.  The sample's ids are at most 2 * ``per_class`` rows, so they are broadcast.
    """
    rows = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & trains)
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .where(F.col("label") == F.col("other"))
        .drop("other")
    )
    sizes = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    picked = None
    for value in (0, 1):
        some = rows.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = some if picked is None else picked.union(some)
    ids = docs.sparkSession.createDataFrame(picked.toArrow())
    return documents_of(docs).join(F.broadcast(ids), "doc_id"), sizes
