"""What the operators share: the shared folder, and batches of texts in Arrow."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.functions.shared import discard, materialize, shared_dir  # noqa: F401  what the operators take from here

#: Bytes of text that a task works on at once.
BATCH_BYTES = 8 << 20
#: Spark's setting of how many bytes an Arrow batch has at most.
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: A Bloom filter has 2 to this power of bits, if it isn't given another.
FILTER_BITS = 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_of(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` alone; a null text is an empty one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def quoted(name: str) -> str:
    """A column's name as it is, with dots or other marks in it."""
    return "`" + name.replace("`", "``") + "`"


def kept_rows(docs: DataFrame, keep: Callable[[pa.Array], np.ndarray], limit: int = BATCH_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, for whose text ``keep`` (texts to truth values) is true."""
    plain = docs.toDF(*("text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)))
    return over_texts(plain, lambda batch: batch.filter(pa.array(keep(batch.column("text")))), plain.schema, limit).toDF(*docs.columns)


def fold_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def bound_batches(spark: SparkSession) -> None:
    """Rows go to Python ``BATCH_BYTES`` at a time, where the session has no bound of its own: 10,000 texts, Spark's measure, can be any size in the executor and again in the worker."""
    if spark.conf.get(ARROW_BYTES, None) is None:
        spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))


def over_texts(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]], schema: str, limit: int = BATCH_BYTES) -> DataFrame:
    """``mapInArrow`` in pieces of about ``limit`` bytes of the column ``text``, whatever the batch size."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, limit):
            out = work(piece)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out
            piece = out = None

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """What the allocators hold free goes back to the system: workers live on from stage to stage beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def pieces(batches: Iterator[pa.RecordBatch], limit: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes in ``column`` (one row at least).  Free memory is given back behind the last."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
    batch = None
    give_back()


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a batch of texts, as codes into ``uniques``.

    ``starts[i]:starts[i + 1]`` are the words of text i.
    """

    def __init__(self, texts: pa.Array, lower: bool = True) -> None:
        if lower:
            texts = pc.ascii_lower(texts)
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        codes, offsets = coded.indices.to_numpy(), split.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        empty = pc.index(coded.dictionary, "").as_py()
        if empty >= 0:
            kept = codes != empty
            offsets = np.concatenate([[0], np.cumsum(kept)])[offsets]
            codes = codes[kept]
        self.uniques, self.codes, self.starts = coded.dictionary, codes, offsets

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.starts)

    def owners(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.starts) - 1), self.lengths)

    def unique_hashes(self) -> np.ndarray:
        return xxh64(self.uniques)

    def hashes(self) -> np.ndarray:
        return self.unique_hashes()[self.codes]


def xxh64(words: pa.Array) -> np.ndarray:
    """xxHash64 of each string: those under 32 bytes side by side, longer ones by the library."""
    one, two, three, four, five = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, by: x << np.uint64(by) | x >> np.uint64(64 - by)
    words = words.cast(pa.binary())
    _, offsets, held = words.buffers()
    if not len(words) or held is None:
        return np.full(len(words), xxhash.xxh64_intdigest(b""), np.uint64)
    bounds = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.append(np.frombuffer(held, np.uint8)[: bounds[-1]], np.zeros(8, np.uint8))
    at, size = bounds[:-1].copy(), np.diff(bounds)
    left, out = np.where(size < 32, size, 0), five + size.astype(np.uint64)
    lanes = lambda kind, width: np.ndarray(len(data) - width + 1, kind, data, strides=(1,))
    while len(i := np.flatnonzero(left >= 8)):
        lane = lanes("<u8", 8)[at[i]]
        out[i] = turned(out[i] ^ turned(lane * two, 31) * one, 27) * one + four
        at[i] += 8
        left[i] -= 8
    i = np.flatnonzero(left >= 4)
    out[i] = turned(out[i] ^ lanes("<u4", 4)[at[i]].astype(np.uint64) * one, 23) * two + three
    at[i] += 4
    left[i] -= 4
    while len(i := np.flatnonzero(left)):
        out[i] = turned(out[i] ^ data[at[i]].astype(np.uint64) * five, 11) * one
        at[i] += 1
        left[i] -= 1
    out = (out ^ out >> np.uint64(33)) * two
    out = (out ^ out >> np.uint64(29)) * three
    out ^= out >> np.uint64(32)
    for i in np.flatnonzero(size >= 32).tolist():
        out[i] = xxhash.xxh64_intdigest(words[i].as_py())
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing rounds of splitmix64, on 64-bit unsigned numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``size``-word shingles of each text with repeats, and where each text's begin.

    A text with fewer words, but some, has its whole sequence as one shingle.
    """
    hashes, lengths = words.hashes(), words.lengths
    rolled = np.zeros(len(hashes), np.uint64)
    for k in range(size):
        part = np.zeros(len(hashes), np.uint64)
        part[: len(hashes) - k] = hashes[k:]
        rolled = mix(rolled * np.uint64(0x9E3779B97F4A7C15) + part + np.uint64(k + 1))
    count = np.where(lengths >= size, lengths - size + 1, np.minimum(lengths, 1))
    starts = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(starts[-1]) + np.repeat(words.starts[:-1] - starts[:-1], count)
    out = rolled[at]
    for i in np.flatnonzero((lengths > 0) & (lengths < size)):
        own, seed = hashes[words.starts[i] : words.starts[i + 1]], lengths[i : i + 1].astype(np.uint64)
        for k in range(len(own)):
            seed = mix(seed * np.uint64(0x9E3779B97F4A7C15) + own[k : k + 1] + np.uint64(k + 1))
        out[starts[i]] = seed[0]
    return out, starts


def filter_shifts(power: int) -> tuple[int, ...]:
    """A key's places in a filter of 2 ** ``power`` bits are in its own bits from these on."""
    return 0, (64 - power) // 2, 64 - power


def filter_words(keys: DataFrame, power: int = FILTER_BITS) -> DataFrame:
    """word, bits: the 64-bit words of a Bloom filter of the column ``key`` that aren't 0, 2 ** (``power`` - 6) at most."""
    places = F.explode(F.array(*(F.shiftrightunsigned("key", s).bitwiseAND((1 << power) - 1) for s in filter_shifts(power))))
    bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
    return keys.select(places.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def filter_from(words: DataFrame, power: int = FILTER_BITS) -> np.ndarray:
    """The filter of ``filter_words``, as bytes."""
    got, out = words.toArrow(), np.zeros(1 << (power - 6), np.int64)
    out[np.asarray(got["word"])] = np.asarray(got["bits"])
    return out.view(np.uint8)


def filter_of(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of the column ``key``, as bytes: its words are put together by Spark."""
    return filter_from(filter_words(keys))


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter; never false for one that is."""
    found, power = np.ones(len(keys), bool), (8 * len(bits)).bit_length() - 1
    for s in filter_shifts(power):
        place = (keys >> np.uint64(s)) & np.uint64((1 << power) - 1)
        found &= (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)
    return found
