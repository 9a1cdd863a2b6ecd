"""Operators of a training-data pipeline over ``documents(doc_id, text, ...)``.

Every operator takes and returns DataFrames.  Inputs may carry any further columns: each
operator selects the columns it needs first, so that extra or clashing names do no harm.
"""
