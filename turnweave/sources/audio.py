"""Frames of PCM files, read by ranges of bytes, so that one long file is dealt out over many tasks."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession


class Sound(NamedTuple):
    channels: int
    rate: int
    offset: int  # of the first sample, in bytes
    length: int  # of all samples, in bytes


def open_file(path: str) -> pa.NativeFile:
    """A file of any store that Arrow knows, open for reads at any place."""
    store, name = pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return store.open_input_file(name)


def header_of(f: BinaryIO, size: int) -> Sound:
    """The chunks of a RIFF file up to its samples; a length that the header leaves open, or that the file doesn't have, ends with the file."""
    if (head := f.read(12))[:4] not in (b"RIFF", b"RF64") or head[8:] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, kind = 12, None
    while at + 8 <= size:
        f.seek(at)
        name, length = struct.unpack("<4sI", f.read(8))
        if name == b"fmt ":
            _, channels, rate, _, _, bits = struct.unpack("<HHIIHH", f.read(16))
            if bits != 16:
                raise ValueError(f"{bits} bits a sample; 16 are wanted")
            kind = channels, rate
        if name == b"data":
            if kind is None:
                raise ValueError("samples before their format")
            held = size - at - 8
            return Sound(*kind, at + 8, held if length in (0, 0xFFFFFFFF) else min(length, held))
        at += 8 + length + length % 2
    raise ValueError("no samples")


def frames_of(samples: np.ndarray, size: int, quiet: float, first: int = 0) -> dict[str, np.ndarray]:
    """Per channel and frame of ``size`` samples: RMS, samples, samples under ``quiet``.  samples: one row a moment, one column a channel."""
    data, at = samples / 32768.0, np.arange(0, len(samples), size)
    channels, n = data.shape[1], np.diff(np.append(at, len(data)))
    rms = np.sqrt(np.add.reduceat(data**2, at) / n[:, None])
    low = np.add.reduceat((np.abs(data) < quiet).astype(np.int64), at)
    index = np.arange(first, first + len(at))
    return {"channel": np.repeat(np.arange(channels), len(at)), "frame_idx": np.tile(index, channels), "rms": rms.T.ravel(), "n": np.tile(n, channels), "n_quiet": low.T.ravel()}


def audio_frames(spark: SparkSession, root: str, frame_ms: int = 30, quiet: float = 0.01, range_bytes: int = 32 << 20) -> DataFrame:
    """The frame table of the 16-bit PCM files under ``root``: path, channel, frame_idx, rms, n, n_quiet.

    Tasks read the headers of the files, and give ranges of about ``range_bytes`` that begin and
    end with a frame (one frame at least).  These are dealt out anew, and each is read by itself,
    so neither a file's length nor its 2 GB matter.  A file without samples has no frames, one
    that isn't such a file is an error that names it.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", True).load(root).select("path", "length")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                try:
                    with open_file(path) as f:
                        sound = header_of(f, size)
                except ValueError as e:
                    raise ValueError(f"{path}: {e}") from e
                moment, frame = 2 * sound.channels, max(1, sound.rate * frame_ms // 1000)
                step = max(1, range_bytes // (moment * frame)) * frame  # moments
                begins = np.arange(0, sound.length // moment, step)
                counts = np.minimum(step, sound.length // moment - begins)
                one = lambda v, n=len(begins): np.full(n, v, np.int64)
                columns = [pa.array([path] * len(begins), pa.string()), *(pa.array(c.astype(np.int64)) for c in (sound.offset + begins * moment, counts, begins // frame, one(sound.channels), one(frame)))]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "at", "moments", "first", "channels", "frame"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with open_file(r["path"]) as f:
                    f.seek(r["at"])
                    samples = np.frombuffer(f.read(r["moments"] * r["channels"] * 2), "<i2").reshape(-1, r["channels"])
                found = frames_of(samples, r["frame"], quiet, r["first"])
                kinds = {"channel": pa.int32(), "frame_idx": pa.int32(), "rms": pa.float64(), "n": pa.int64(), "n_quiet": pa.int64()}
                yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * len(found["n"]), pa.string()), *(pa.array(found[k], kind) for k, kind in kinds.items())], names=["path", *kinds])

    # by number: rows of ranges are small, and would be put together by their own size
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = files.mapInArrow(ranges, "path string, at long, moments long, first long, channels long, frame long").repartition(parts, "path", "first")
    return dealt.mapInArrow(read, "path string, channel int, frame_idx int, rms double, n long, n_quiet long")


def write_audio(samples: DataFrame, out: str, rate: int) -> None:
    """One mono file of 16-bit PCM for each name, <out>/<name>.wav, of samples (name, idx, value) in order of idx.

    Files are written as their samples come by, sorted, so a name may have any number of them;
    the header leaves the length open.  A task that is repeated writes its files anew.
    """
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 0xFFFFFFFF, b"WAVE", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16, b"data", 0xFFFFFFFF)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        for batch in batches:
            names, data = batch.column("name").to_pylist(), batch.column("value").to_numpy().astype("<i2")
            bounds = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for a, b in zip(bounds, bounds[1:], strict=False):
                if a == b:
                    continue
                if names[a] != name:
                    if f is not None:
                        f.close()
                    name = names[a]
                    store, path = pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", f"{out}/{name}.wav"))
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    f = store.open_output_stream(path)
                    f.write(head)
                    yield pa.RecordBatch.from_arrays([pa.array([name], pa.string())], names=["name"])
                f.write(data[a:b].tobytes())
        if f is not None:
            f.close()

    rows = samples.select("name", "idx", "value").repartition("name").sortWithinPartitions("name", "idx")
    rows.select("name", "value").mapInArrow(write, "name string").count()
