"""Repeated byte strings by merging Burrows-Wheeler transforms.

The transforms are those of the parts of texts that can hold a repeat.  Every 200-byte string is
filed under its smallest 128-byte hash; strings that are equal have equal hashes, so a stretch
of starts whose hash occurs nowhere else holds no repeat, and stretches with one hash can be
compared apart from all others.  Equal stretches are counted and one of each goes on.  A hash
with more than ``WIDE`` kinds of stretches is dealt out over many tasks instead, and each of its
strings is filed once more by a 128-bit hash of all its bytes, which are then counted.

In each partition of hashes, each shard of stretches has its Burrows-Wheeler transform.  The
shards' transforms are merged by refining their interleave: a pass reads the symbols in the
present interleave and deals it out stably by symbol, after which suffixes are in order by one
more symbol.  Where neighbours first part gives their common prefix; after 200 passes, what has
not parted is a repeated interval.  No suffixes are sorted again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_of, materialize, mix, over_texts, same

#: Bytes of stretches in a shard, and in a merge; a partition with more is merged in several
#: rounds by ranges of the hash, which never part strings that are equal.
SHARD_BYTES, MERGE_BYTES = 1 << 20, 8 << 20
#: Longest stretch, in starts.
STRETCH = 4096
#: A hash with more kinds of stretches than this is refiled by whole strings, so no task gathers it.
WIDE = 4096


def grams(data: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """A hash of the ``size`` bytes from each position on: halves are joined, then two that overlap."""
    out, width = mix(data.astype(np.uint64) + np.uint64(seed)), 1
    while width * 2 <= size:
        out = mix(out[:-width] * np.uint64(0x9E3779B97F4A7C15) + out[width:])
        width *= 2
    if width < size:
        out = mix(out[: len(out) - (size - width)] * np.uint64(0xD6E8FEB86659FD93) + out[size - width :])
    return out


def sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    out, width = values, 1
    while width * 2 <= size:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[: len(out) - (size - width)], out[size - width :]) if width < size else out


def stretches(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, end of starts, hash, 1 or more if it may repeat within) of each run of starts filed under one hash."""
    size = max(1, length * 16 // 25)
    gram = grams(data, size)
    least = sliding_least(gram, length - size + 1)
    cut = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    ends = np.append(cut[1:], len(least))
    if (ends - cut).max() > STRETCH:
        cut = np.concatenate([np.arange(a, b, STRETCH) for a, b in zip(cut, ends, strict=True)])
        ends = np.append(cut[1:], len(least))
    # positions that are the smallest of some string; neighbours among them with equal hashes mean a repeat close by
    reach = length - size
    padded = np.concatenate([np.zeros(reach, np.uint64), least, np.zeros(reach, np.uint64)])
    lowest = np.flatnonzero(~sliding_least(~padded, reach + 1) == gram)
    twins = np.concatenate([[0], np.cumsum(gram[lowest[1:]] == gram[lowest[:-1]])])
    first, last = np.searchsorted(lowest, cut), np.searchsorted(lowest, ends + reach) - 1
    weight = 1 + twins[np.maximum(last, first)] - twins[first]
    return cut, ends, least[cut], weight


def describe(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, text_hash, at, n (starts), anchor, c1, c2 (a hash of the stretch's bytes), weight."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        parts = []
        for doc_id, text_hash, text in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), batch.column("text"), strict=True):
            raw = text.as_buffer()
            if raw is None or len(raw) < length:
                continue
            data = memoryview(raw)
            at, ends, anchor, weight = stretches(np.frombuffer(raw, np.uint8), length)
            digest = b"".join(xxhash.xxh3_128_digest(data[a : b + length - 1]) for a, b in zip(at.tolist(), ends.tolist(), strict=True))
            content = np.frombuffer(digest, np.int64).reshape(-1, 2)
            parts.append((np.full(len(at), 0 if doc_id is None else doc_id), np.full(len(at), doc_id is None), np.full(len(at), text_hash), at, ends - at, anchor.view(np.int64), content[:, 0], content[:, 1], weight))
        if parts:
            c = [np.concatenate(x) for x in zip(*parts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64(), mask=c[1]), *(pa.array(x.astype(np.int64)) for x in c[2:])], names=["doc_id", "text_hash", "at", "n", "anchor", "c1", "c2", "weight"])

    rows = documents_of(docs).withColumn("text_hash", F.xxhash64("text"))
    return over_texts(rows, work, "doc_id long, text_hash long, at long, n long, anchor long, c1 long, c2 long, weight long", 4 << 20)


def transform(strings: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(transform, suffix order) of the strings, each with an end mark, as one ring; order by ``depth`` symbols or more.

    Symbols are bytes plus one, and 0 for an end mark: UTF-8 has no byte 255.
    """
    text = np.frombuffer(b"".join(s + b"\xff" for s in strings), np.uint8) + np.uint8(1)
    rank, width, n = np.zeros(len(text), np.int64), 7, len(text)
    for k in range(width):
        rank = rank << 8 | np.roll(text, -k)
    order = np.argsort(rank)
    while True:
        sorted_rank = rank[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(0, sorted_rank[1:] != sorted_rank[:-1]))
        if width >= depth or rank.max() == n - 1:
            return text[order - 1], order
        rank = rank * n + np.roll(rank, -width)
        order = np.argsort(rank)
        width *= 2


def merged_repeats(shards: list[list[bytes]], length: int) -> list[np.ndarray]:
    """For each string of all shards in turn: whether each start's ``length`` bytes occur at another start of any string.

    Only suffixes that begin where a string of ``length`` bytes ends are interleaved, and of
    these only such as still share all symbols read with another: after ``length`` passes they
    have come to the starts of the repeated strings.
    """
    symbols, before, place, start_of, base = [], [], [], [], 0
    for strings in shards:
        read, order = transform(strings, length)
        n, ends = len(order), np.cumsum([len(s) + 1 for s in strings])
        row = np.empty(n, np.int64)
        row[order] = np.arange(n)
        open_ends = np.zeros(n, bool)
        for end, s in zip(ends, strings, strict=True):
            open_ends[end - 1 - max(0, len(s) - length) : end] = len(s) >= length
        symbols.append(read)
        before.append(row[order - 1] + base)
        place.append(np.flatnonzero(open_ends[order]) + base)
        start_of.append(order + base)
        base += n
    symbol, back, at, start = (np.concatenate(x) for x in (symbols, before, place, start_of))
    block = np.zeros(len(at), np.int32)
    for _ in range(length):
        if not len(at):
            break
        read = symbol[at]
        dealt = np.argsort(read, kind="stable")
        at, read, block = back[at[dealt]], read[dealt], block[dealt]
        parts = np.concatenate([[True], (read[1:] != read[:-1]) | (block[1:] != block[:-1]), [True]])
        block = np.cumsum(parts[:-1], dtype=np.int32)
        shared = ~(parts[:-1] & parts[1:])
        at, block = at[shared], block[shared]
    found = np.zeros(base, bool)
    found[start[at]] = True
    out, at = [], 0
    for strings in shards:
        for s in strings:
            out.append(found[at : at + max(0, len(s) - length + 1)])
            at += len(s) + 1
    return out


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def compare(contents: DataFrame, length: int) -> DataFrame:
    """c1, c2, lo, hi, g1, g2: runs of starts, relative to the stretch, that repeat within the partition's stretches; of wide hashes every start, with a hash of its string.

    contents: anchor, wide, c1, c2, body, sorted by the first four; repeated rows count once.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "wide", "c1", "c2", "body")), strict=True):
                if row[:4] == last:
                    continue
                if row[1]:
                    yield strings_of(row)
                else:
                    if size >= MERGE_BYTES and row[0] != last[0]:
                        yield finish(held)
                        held, size = [], 0
                    held.append(row)
                    size += len(row[4])
                last = row[:4]
        if held:
            yield finish(held)

    def batch_of(columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["c1", "c2", "lo", "hi", "g1", "g2"])

    def strings_of(row: tuple) -> pa.RecordBatch:
        data = np.frombuffer(row[4], np.uint8)
        lo = np.arange(len(data) - length + 1)
        return batch_of([np.full(len(lo), row[2]), np.full(len(lo), row[3]), lo, lo + 1, grams(data, length, 3).view(np.int64), grams(data, length, 5).view(np.int64)])

    def finish(rows: list[tuple]) -> pa.RecordBatch:
        shards: list[list[bytes]] = [[]]
        filled = 0
        for r in rows:
            if filled > SHARD_BYTES:
                shards.append([])
                filled = 0
            shards[-1].append(r[4])
            filled += len(r[4]) + 1
        out: list[tuple] = []
        for (_, _, c1, c2, _), flags in zip(rows, merged_repeats(shards, length), strict=True):
            out += [(c1, c2, int(a), int(b), None, None) for a, b in zip(*runs_of(flags), strict=True)]
        return batch_of([[r[k] for r in out] for k in range(6)])

    return contents.mapInArrow(work, "c1 long, c2 long, lo long, hi long, g1 long, g2 long")


def repeated_spans(docs: DataFrame, length: int = 200, wide: int = WIDE) -> DataFrame:
    """doc_id, text_hash, spans array<struct<lo, hi>>: bytes covered by strings of ``length`` bytes that start anywhere else too, for documents that have any.

    Spans are sorted by start and may touch or overlap.
    """
    runs = materialize(describe(docs, length), "stretches")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    anchors = materialize(runs.groupBy("anchor").agg(F.sum("weight").alias("seen")).where("seen > 1").select("anchor"), "anchors")
    hits = materialize(runs.drop("weight").join(anchors, "anchor"), "hits")
    # rows that repeat a document in full occur as often
    contents = materialize(hits.groupBy("anchor", "c1", "c2").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("doc_id", "text_hash", "at", "n")).alias("rep")), "contents")
    whole = contents.where("times > 1").select("c1", "c2", F.lit(0).cast("long").alias("lo"), F.col("rep.n").alias("hi"))
    kinds = contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.max("times").alias("most")).where("kinds > 1 or most = 1").select("anchor", (F.col("kinds") > wide).alias("wide"))
    wanted = contents.join(materialize(kinds, "kinds"), "anchor").select("anchor", "wide", "c1", "c2", "rep.*")
    by_doc = wanted.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(F.collect_list(F.struct("anchor", "wide", "c1", "c2", "at", "n")).alias("parts"))
    texts = documents_of(docs).withColumn("text_hash", F.xxhash64("text"))
    # of rows repeated in full each gives the same bodies; one counts
    cut = texts.join(by_doc, same(F.col("doc_id"), F.col("d")) & (F.col("text_hash") == F.col("h")))
    part = cut.select(F.encode("text", "UTF-8").alias("raw"), F.explode("parts").alias("p")).select("p.anchor", "p.wide", "p.c1", "p.c2", F.substr("raw", F.col("p.at") + 1, F.col("p.n") + length - 1).alias("body"))
    dealt = part.repartition(n, "anchor", F.when(F.col("wide"), F.col("c1"))).sortWithinPartitions("anchor", "wide", "c1", "c2")
    compared = materialize(compare(dealt, length), "compared")
    strings = compared.where("g1 is not null")
    twice = strings.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("g1", "g2")
    runs_found = compared.where("g1 is null").unionByName(strings.join(twice, ["g1", "g2"])).select("c1", "c2", "lo", "hi")
    found = materialize(whole.unionByName(runs_found), "repeats")
    spans = hits.join(found, ["c1", "c2"]).select("doc_id", "text_hash", (F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi") + length - 1).alias("hi"))
    return spans.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("spans"))


def drop_repeats(docs: DataFrame, length: int = 200, wide: int = WIDE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left) of every row of documents.

    Each byte covered by a string of ``length`` bytes that also starts anywhere else, in any
    document, goes; strings are judged on the input.  Null or empty texts have no bytes.
    Repeated rows repeat each other's strings, so they lose all of them; rows with a null doc_id
    count as any other.  An empty table gives no rows.
    """
    spans = repeated_spans(docs, length, wide).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "spans")
    rows = documents_of(docs).withColumn("text_hash", F.xxhash64("text"))
    joined = rows.join(spans, same(F.col("doc_id"), F.col("d")) & (F.col("text_hash") == F.col("h")), "left").select("doc_id", "text", "spans.lo", "spans.hi")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, lo, hi in zip(batch.column("text"), batch.column("lo").to_pylist(), batch.column("hi").to_pylist(), strict=True):
            data = text.as_py().encode()
            kept, at, removed, n = [], 0, 0, 0
            last = -1
            for a, b in zip(lo or [], hi or [], strict=True):
                if a > last:  # not touching what went before
                    n += 1
                    kept.append(data[at:a])
                removed += max(0, b - max(a, last))
                at = last = max(b, last)
            kept.append(data[at:])
            left = b"".join(kept)
            out.append((len(data), removed, n, hashlib.sha256(left).hexdigest(), left))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return over_texts(joined, work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary", 4 << 20)
