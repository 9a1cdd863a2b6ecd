"""Balanced brackets of texts that may be JSON in part: a machine over whole batches of bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

SPAN = ArrayType(StructType([StructField("open", IntegerType()), StructField("close", IntegerType()), StructField("level", IntegerType()), StructField("odd", BooleanType())]))
KIND = pa.list_(pa.struct([("open", pa.int32()), ("close", pa.int32()), ("level", pa.int32()), ("odd", pa.bool_())]))


def free_quotes(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Places of the double quotes that no backslash escapes; ``begins`` is true where a text begins."""
    back = np.flatnonzero(data == 0x5C)
    quotes = np.flatnonzero(data == 0x22)
    if not len(back):
        return quotes
    # runs of backslashes within a text; one of odd length escapes the quote behind it
    heads = np.flatnonzero(np.append(True, (np.diff(back) > 1) | begins[back[1:]]))
    ends = np.append(heads[1:], len(back)) - 1
    odd = back[ends[(ends - heads) % 2 == 0]] + 1
    odd = odd[odd < len(data)]
    return quotes[~np.isin(quotes, odd[~begins[odd]])]


def matched(data: np.ndarray, starts: np.ndarray, opening: int, closing: int) -> tuple[np.ndarray, ...]:
    """(text, open, close, level, odd) of all pairs of brackets, by text and open.

    Whether a bracket stands in a string depends on where reading begins: on the parity of the
    quotes between the two.  So brackets behind an even and an odd number of quotes are two
    sequences, and one that is read from a bracket of its own sequence sees the others in
    strings.  Within a sequence and a level of depth, opening and closing brackets alternate,
    whatever is missing before; an opening one is closed by the next on its level.
    """
    begins = np.zeros(len(data) + 1, bool)
    begins[starts] = True
    at = np.flatnonzero((data == opening) | (data == closing))
    text = np.searchsorted(starts, at, side="right") - 1
    quotes = free_quotes(data, begins)
    odd = (np.searchsorted(quotes, at) - np.searchsorted(quotes, starts[text])) % 2
    order = np.lexsort((at, odd, text))
    at, text, odd = at[order], text[order], odd[order]
    up = data[at] == opening
    depth = np.cumsum(np.where(up, 1, -1))
    group = text * 2 + odd
    heads = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(at) else np.zeros(0, np.int64)
    before = np.repeat(depth[heads] - np.where(up[heads], 1, -1), np.diff(np.append(heads, len(at)))) if len(at) else depth
    level = depth - before + ~up
    order = np.lexsort((at, level, group))
    at, text, odd, up, level, group = (x[order] for x in (at, text, odd, up, level, group))
    pair = np.flatnonzero(up[:-1] & ~up[1:] & (group[:-1] == group[1:]) & (level[:-1] == level[1:]))
    found = pair[np.lexsort((at[pair], text[pair]))]
    return text[found], at[found], at[found + 1], level[found], odd[found]


def spans_of(texts: pa.Array, opening: int, closing: int) -> pa.Array:
    texts = pc.fill_null(texts.cast(pa.string()), "")
    _, offsets, held = texts.buffers()
    bounds = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(held, np.uint8)[bounds[0] : bounds[-1]] if held is not None else np.zeros(0, np.uint8)
    starts = bounds[:-1] - bounds[0]
    # of equal starts the last is the text that has bytes
    text, opened, closed, level, odd = matched(data, starts, opening, closing)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters before each byte
    first = chars[starts[text]]
    counts = np.bincount(text, minlength=len(texts))
    fields = [pa.array((chars[x] - first).astype(np.int32)) for x in (opened, closed)] + [pa.array(level.astype(np.int32)), pa.array(odd.astype(bool))]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.StructArray.from_arrays(fields, fields=list(KIND.value_type)))


@F.arrow_udf(SPAN)
def brace_spans(text: pa.Array) -> pa.Array:
    """Places (characters from 0 on) of each { and the } that closes it; level tells nesting among those of one parity of quotes before them (odd)."""
    return spans_of(text, 0x7B, 0x7D)


@F.arrow_udf(SPAN)
def list_spans(text: pa.Array) -> pa.Array:
    """As ``brace_spans``, of [ and ]."""
    return spans_of(text, 0x5B, 0x5D)


def piece(text: Column, span: Column) -> Column:
    """The text of a span, brackets included."""
    return F.substring(text, span["open"] + 1, span["close"] - span["open"] + 1)


def json_objects(text: Column) -> Column:
    """Q4: all JSON objects of a text that aren't part of another, in order, each as its text.

    Reading begins at each { in turn.  What can't be read as an object, because it is broken or
    never closed, is left at its first {, and reading begins again at the next one, so objects
    inside broken ones are found.  Braces and quotes in strings count for nothing.  Null text:
    an empty array.
    """
    state = F.struct(F.lit(-1).alias("end"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        own = piece(text, s)
        taken = (s["open"] > a["end"]) & F.json_object_keys(own).isNotNull()
        return F.struct(F.when(taken, s["close"]).otherwise(a["end"]).alias("end"), F.when(taken, F.concat(a["out"], F.array(own))).otherwise(a["out"]).alias("out"))

    return F.aggregate(brace_spans(text), state, step, lambda a: a["out"])


def object_with_key(text: Column, key: str) -> Column:
    """Q4: the first of ``json_objects`` that has ``key`` itself, as text; null if none has."""
    return F.get(F.filter(json_objects(text), lambda o: F.array_contains(F.json_object_keys(o), key)), F.lit(0))


def first_object(text: Column) -> Column:
    """Q4: the object that begins at the first { of a text without its code fence; null if that isn't closed or isn't JSON."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[^\n]*\n", ""), r"```$", "")
    spans = brace_spans(bare)
    first = F.get(F.filter(spans, lambda s: s["open"] == F.locate("{", bare) - 1), F.lit(0))
    own = piece(bare, first)
    return F.when(F.json_object_keys(own).isNotNull(), own)
