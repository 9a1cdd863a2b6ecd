"""Apply a user's model over batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply_model(df: DataFrame, fn: Callable[[pd.DataFrame], list], out: str, validate: Callable[[object], bool] = lambda x: x is not None, retries: int = 3) -> DataFrame:
    """Adds ``out`` (string) and error: ``fn`` takes a batch and returns a value a row; values that ``validate`` rejects are asked for again, up to ``retries`` times.

    Rows that have a value in ``out`` already keep it and aren't sent.  A batch whose call fails
    keeps the error's text.
    """
    had = out in df.columns
    schema = df.drop(out, "error").schema.add(out, "string").add("error", "string")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = batch[out] if had else pd.Series([None] * len(batch), index=batch.index, dtype=object)
            batch = batch.drop(columns=[c for c in (out, "error") if c in batch])
            value, error = done.astype(object).where(done.notna(), None), pd.Series([None] * len(batch), index=batch.index, dtype=object)
            for _ in range(retries):
                todo = value.index[value.isna()]
                if not len(todo):
                    break
                try:
                    for i, v in zip(todo, fn(batch.loc[todo]), strict=True):
                        ok = validate(v)
                        value[i], error[i] = (v, None) if ok else (None, "rejected")
                except Exception as e:
                    error[todo] = str(e)
            yield batch.assign(**{out: value, "error": error})

    return df.mapInPandas(work, schema)


def unanswered(df: DataFrame, out: str) -> DataFrame:
    """Rows still without a value."""
    return df.where(F.col(out).isNull())
