"""Token ids in length-delimited binary records, with an offset index.

A data file is a sequence of records, each:

    length   8 bytes, little-endian: bytes of the body
    check    4 bytes: masked CRC-32 of the length field
    body     doc_id (8 bytes, signed; the smallest value stands for null),
             flags (1 byte: 1 if ids have 4 bytes, else 2 bytes), the ids, little-endian
    check    4 bytes: masked CRC-32 of the body
    end      one byte 0x0A

Masking turns a checksum by 15 bits and adds a constant, so that checksums of data which hold
checksums stay useful.  Spark's own text writer writes the framed bytes as they are (with the
end byte as its line separator), so files appear by Spark's commit protocol on any file system
that Spark writes to, and a lost task leaves nothing behind.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnweave.sources.audio import open_file

from .common import Words, documents_of, over_texts, shared_dir

#: Fixed value: added to a turned checksum.
MASK = 0xA282EAD8
NULL_ID = -(1 << 63)
#: Words whose ids a task remembers, about 150 bytes each; bytes of text that it encodes at a time, and most bytes of text in a file.
REMEMBERED, PIECE, FILE_BYTES = 400_000, 4 << 20, 128 << 20
#: Bytes of a file whose wanted records a task reads together.
READ_BYTES = 8 << 20
#: The rules under which texts are encoded by words, as vocabulary files state them.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
SPACE = " \t\n\x0b\x0c\r"
STOPPED = r"[A-Za-zÀ-ÖØ-öø-ÿ][.,]$"
#: Words that are one piece, whatever the case; and what stands between other words, a piece of one token that nothing else gives.
LETTERS, MARK = r"^[A-Za-zÀ-ÖØ-öø-ÿ]+$", "\x01"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, wide: bool) -> bytes:
    """One record without its end byte; ``ids`` have 4 bytes each if wide, else 2."""
    body = struct.pack("<qB", NULL_ID if doc_id is None else doc_id, wide) + ids
    length = struct.pack("<Q", len(body))
    return b"".join((length, struct.pack("<I", masked(length)), body, struct.pack("<I", masked(body))))


def unframe(content: memoryview, at: int = 0) -> Iterator[tuple[int, int | None, np.ndarray]]:
    """(offset, doc_id, ids) of each record from byte ``at`` on; a wrong checksum or length is an error."""
    while at < len(content):
        length, check = struct.unpack_from("<QI", content, at)
        if masked(bytes(content[at : at + 8])) != check:
            raise ValueError(f"damaged length at byte {at}")
        body = bytes(content[at + 12 : at + 12 + length])
        (check,) = struct.unpack_from("<I", content, at + 12 + length)
        if len(body) != length or masked(body) != check:
            raise ValueError(f"damaged record at byte {at}")
        doc_id, wide = struct.unpack_from("<qB", body)
        yield at, None if doc_id == NULL_ID else doc_id, np.frombuffer(body, "<u4" if wide else "<u2", offset=9)
        at += 12 + length + 4 + 1


class WordEncoder:
    """The library's tokenizer with a memory of words.

    With the normaliser ``NORMALIZER`` and the cut ``PRE_TOKENIZER``, no piece holds white space,
    and nothing is composed or lower-cased across it: so the ids of a text are those of its
    words.  In the same way a stop or comma behind a letter always begins a piece, and doesn't
    change the letter.  Only letters of ``STOPPED`` (ASCII and Latin-1), which stay single
    letters when lower-cased, are parted from it, so that most words are known without it too.
    A word of such letters alone is one piece, and the last token of a piece is of a kind of its
    own, so new ones are encoded in one text with nothing but white space between them.
    Files with other rules, or with added tokens that hold white space or reach into it, are
    encoded text by text.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = "<u4" if self.tokenizer.get_vocab_size(True) > 1 << 16 else "<u2"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec["added_tokens"]
        plain = all(t["special"] and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or set(t["content"]) & set(SPACE)) for t in added)
        suffix, mark = spec["model"].get("end_of_word_suffix"), self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.by_word = plain and bool(suffix) and len(mark) == 1 and (spec["normalizer"], spec["pre_tokenizer"]) == (NORMALIZER, PRE_TOKENIZER)
        self.marks = [MARK, *(t["content"] for t in added)]
        if self.by_word:
            vocabulary = self.tokenizer.get_vocab(True)
            self.mark_id, self.last = mark[0], np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
            letters = [c for c in map(chr, range(256)) if re.match(LETTERS, c)]
            self.by_word = self.last[self.tokenizer.encode(" ".join(letters), add_special_tokens=False).ids].sum() == len(letters)
        self.forget()

    def forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.starts, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def learn(self, words: list[str]) -> None:
        """Encode new words: those of letters alone in texts of many, others with ``MARK`` between them, those that hold a mark each by itself."""
        if not words:
            return
        odd: list[str] = []
        if any(map("\n".join(words).__contains__, self.marks)):
            odd = [w for w in words if any(m in w for m in self.marks)]
            words = [w for w in words if w not in set(odd)]
        flat, sizes, order = [], [], []
        letters = pc.match_substring_regex(pa.array(words, pa.string()), LETTERS).to_numpy(zero_copy_only=False).astype(bool).tolist()
        for whole in (True, False):
            group = [w for w, x in zip(words, letters, strict=True) if x == whole]
            for at in range(0, len(group), 10_000):
                some = group[at : at + 10_000]
                (found,) = self.tokenizer.encode_batch_fast([("\n" if whole else f"\n{MARK}\n").join(some)], add_special_tokens=False)
                ids = np.array(found.ids, np.uint32)
                if whole:
                    ends = np.flatnonzero(self.last[ids]) + 1
                    kept = ids
                else:
                    marks = np.flatnonzero(ids == self.mark_id)
                    ends = np.append(marks - np.arange(len(marks)), len(ids) - len(marks))
                    kept = ids[ids != self.mark_id]
                sizes.append(np.diff(ends, prepend=0))
                flat.append(kept)
            order += group
        for found in self.tokenizer.encode_batch_fast(odd, add_special_tokens=False):
            flat.append(np.array(found.ids, np.uint32))
            sizes.append(np.array([len(found.ids)]))
        order += odd
        self.slot |= zip(order, range(len(self.slot), len(self.slot) + len(order)), strict=True)
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.concatenate(sizes))])
        self.flat = np.concatenate([self.flat, *flat])

    def slots(self, words: pa.Array) -> np.ndarray:
        """Where the ids of each of these different words are."""
        names = words.to_pylist()
        known = self.slot.get
        found = np.array([known(w, -1) for w in names], np.int64)
        new = np.flatnonzero(found < 0)
        self.learn(unknown := [names[i] for i in new.tolist()])
        found[new] = [self.slot[w] for w in unknown]
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin)."""
        if not self.by_word:
            found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate(found), np.concatenate([[0], np.cumsum([len(x) for x in found])])
        if len(self.slot) > REMEMBERED:
            self.forget()
        words = Words(texts, lower=False)
        stopped = pc.match_substring_regex(words.uniques, STOPPED)
        base = pc.if_else(stopped, pc.utf8_slice_codeunits(words.uniques, 0, -1), words.uniques).dictionary_encode()
        last = pc.if_else(stopped, pc.utf8_slice_codeunits(words.uniques, -1), pa.scalar("")).dictionary_encode()
        pair = np.stack([self.slots(x.dictionary)[x.indices.to_numpy()] for x in (base, last)], 1)[words.codes].ravel()
        starts, sizes = self.starts[pair], np.diff(self.starts)[pair]
        ends = np.cumsum(sizes)
        ids = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)]
        return ids, np.concatenate([[0], ends])[2 * words.starts]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_token_records(docs: DataFrame, tokenizer_path: str, out: str, end_id: int = 1, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode, append ``end_id``, write to ``out``/data in ascending doc_id order; returns ``read_index``.

    Documents are range-partitioned by (doc_id, text hash), one file each in that order, nulls
    first.  There are as many files as shuffle partitions (fewer if they would hold less than
    a sixteenth of ``file_bytes`` of text), and more where a file would hold more than
    ``file_bytes``.  Null or empty text: a record with ``end_id`` alone.  Repeated rows are
    written each.  No rows: no records.
    """
    spark = docs.sparkSession
    rows = documents_of(docs)
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    n = max(1, -(-size // file_bytes), min(int(spark.conf.get("spark.sql.shuffle.partitions")), 16 * size // file_bytes))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        e = encoder(tokenizer_path)
        ids, starts = e.encode(batch.column("text"))
        # the end id goes behind each text
        raw = np.insert(ids, starts[1:], end_id).astype(e.kind).tobytes()
        width = np.dtype(e.kind).itemsize
        bounds = ((starts + np.arange(len(starts))) * width).tolist()
        framed = [frame(i, raw[a:b], width == 4) for i, a, b in zip(batch.column("doc_id").to_pylist(), bounds, bounds[1:], strict=False)]
        return pa.RecordBatch.from_arrays([pa.array(framed, pa.binary())], names=["record"])

    key = ["doc_id", F.xxhash64("text")]
    ordered = rows.repartitionByRange(n, *key).sortWithinPartitions(*key)
    over_texts(ordered, work, "record binary", PIECE).select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").text(f"{out}/data")
    read_records(spark, out).write.parquet(f"{out}/index")
    return read_index(spark, out)


def read_records(spark: SparkSession, out: str) -> DataFrame:
    """file, offset, doc_id, n_tokens, n_before (ids before it in its file), ids_crc32 (as 32-bit), for each record of the files, all of it checked."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, before = [], 0
                for at, doc_id, ids in unframe(memoryview(content.as_buffer())):
                    rows.append((at, doc_id, len(ids), before, zlib.crc32(ids.astype("<u4").tobytes())))
                    before += len(ids)
                    if len(rows) == 10_000:
                        yield out_batch(path, rows)
                        rows = []
                yield out_batch(path, rows)

    def out_batch(path: str, rows: list[tuple]) -> pa.RecordBatch:
        columns = [[path] * len(rows), *([r[k] for r in rows] for k in range(5))]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 0 else pa.int64()) for k, c in enumerate(columns)], names=["file", "offset", "doc_id", "n_tokens", "n_before", "ids_crc32"])

    files = spark.read.format("binaryFile").load(f"{out}/data").where(F.col("length") > 0).select("path", "content")
    return files.mapInArrow(work, "file string, offset long, doc_id long, n_tokens long, n_before long, ids_crc32 long")


def read_index(spark: SparkSession, out: str) -> DataFrame:
    """The offset index, made by reading the data back: a row of ``read_records`` for each record."""
    return spark.read.parquet(f"{out}/index")


def read_at(spark: SparkSession, out: str, wanted: DataFrame) -> DataFrame:
    """file, offset, doc_id, ids of the records at ``wanted`` (file, offset; rows of the index, in any order; repeated ones count once).

    Only files that hold a wanted record are opened, and in them only those records are read, by
    seeking to their offsets.  A file with many wanted records is read by several tasks.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, offsets in zip(batch.column("file").to_pylist(), batch.column("offsets").to_pylist(), strict=True):
                with open_file(path) as f:
                    rows = [(path, *record_at(f, at)) for at in offsets]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())))], names=["file", "offset", "doc_id", "ids"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stretch = F.floor(F.col("offset") / READ_BYTES)
    of_file = wanted.select("file", "offset").repartition(n, "file", stretch).groupBy("file", stretch).agg(F.sort_array(F.collect_set("offset")).alias("offsets"))
    return of_file.select("file", "offsets").mapInArrow(work, "file string, offset long, doc_id long, ids array<long>")


def record_at(f: BinaryIO, at: int) -> tuple[int, int | None, np.ndarray]:
    """(offset, doc_id, ids) of the record at byte ``at`` of a file."""
    f.seek(at)
    head = f.read(12)
    length, check = struct.unpack("<QI", head)
    if masked(head[:8]) != check:
        raise ValueError(f"damaged length at byte {at}")
    _, doc_id, ids = next(unframe(memoryview(head + f.read(length + 4))))
    return at, doc_id, ids


def with_starts(index: DataFrame) -> DataFrame:
    """Adds start: the ids of all records before it.  Sums for whole files are one row a file."""
    files = index.groupBy("file").agg(F.sum("n_tokens").alias("in_file"))
    part = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    order = Window.orderBy(part, "file").rowsBetween(Window.unboundedPreceding, -1)
    before = files.select("file", F.coalesce(F.sum("in_file").over(order), F.lit(0)).alias("files_before"))
    return index.join(before, "file").withColumn("start", F.col("files_before") + F.col("n_before")).drop("files_before")


def token_records(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Write all documents to a new folder under the shared one and read them back: doc_id, start, n_tokens, ids_crc32.

    Rows are as in :func:`write_token_records`; repeated rows have a record each, one behind
    the other.
    """
    spark = docs.sparkSession
    out = f"{shared_dir(spark)}/turnweave/records-{uuid.uuid4().hex}"
    return with_starts(write_token_records(docs, tokenizer_path, out, end_id)).select("doc_id", "start", "n_tokens", "ids_crc32")
