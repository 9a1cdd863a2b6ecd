"""Quality classifier: a factorisation machine.

Features of a text: hashed words, and its structure statistics, each in ten bins.  A machine of
``rank`` factors gives every pair of features an interaction, the inner product of their
factors; the sum over all pairs is half of (square of sums - sum of squares), linear in the
number of features.  It is fitted on a bounded sample of labelled rows and scores every row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, documents_of, fold_of, over_texts
from .labelled import labelled_sample
from .quality_rules import repeated, text_stats

#: Hashed words; bins of each statistic.
HASHED, BINS = 4096, 10


def structure(texts: pa.Array) -> np.ndarray:
    """Ratios of each text, each in [0, 1) or a logarithm over 16."""
    s = {k: v.astype(float) for k, v in text_stats(texts).items()}
    words, chars, lines = np.maximum(s["n_words"], 1), np.maximum(s["n_chars"], 1), np.maximum(s["n_lines"], 1)
    return np.stack([
        np.log2(s["n_words"] + 1) / 20, np.log2(s["n_chars"] + 1) / 24, s["word_chars"] / words / 16, s["n_symbols"] / chars * 4, s["n_dup_lines"] / lines,
        s["n_repeat_words"] / words, s["n_distinct"] / words, s["n_digits"] / chars * 2, s["n_upper"] / chars * 2, np.log2(words / lines) / 8,
    ], axis=1)


STRUCTURE = 10
WIDTH = HASHED + STRUCTURE * BINS


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(indices, values, starts): each text's distinct hashed words, scaled to length 1 in all, and its bins."""
    words = Words(texts)
    slots = (words.unique_hashes() % np.uint64(HASHED)).astype(np.int64)[words.codes] if len(words.codes) else np.zeros(0, np.int64)
    owners = words.owners()
    first = repeated(slots, owners)[1] if len(slots) else np.zeros(0, bool)
    n = len(words.starts) - 1
    slots, owners = slots[first], owners[first]
    size = np.bincount(owners, minlength=n)
    bins = np.clip((structure(texts) * BINS).astype(np.int64), 0, BINS - 1) + HASHED + np.arange(STRUCTURE) * BINS
    counts = size + STRUCTURE
    starts = np.concatenate([[0], np.cumsum(counts)])
    index, value = np.empty(starts[-1], np.int64), np.empty(starts[-1])
    at = np.arange(len(slots)) + STRUCTURE * owners
    index[at], value[at] = slots, 1 / np.sqrt(np.maximum(size, 1))[owners]
    tail = (starts[1:, None] - STRUCTURE + np.arange(STRUCTURE)).ravel()
    index[tail], value[tail] = bins.ravel(), 1 / np.sqrt(STRUCTURE)
    return index, value, starts


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def parts(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The margin of each row, and its sums of factors.  Every row has features."""
        scaled = self.factors[index] * value[:, None]
        sums = np.add.reduceat(scaled, starts[:-1])
        squares = np.add.reduceat((scaled**2).sum(1), starts[:-1])
        return self.bias + np.add.reduceat(self.linear[index] * value, starts[:-1]) + ((sums**2).sum(1) - squares) / 2, sums

    def score(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.parts(index, value, starts)[0], -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], shares: dict[int, float], rank: int, epochs: int, rate: float, decay: float, batch: int = 128) -> Machine:
    """Adagrad on log loss; ``shares`` weighs the classes back to their share among all labelled rows."""
    random = np.random.default_rng(0)
    m = Machine(0.0, np.zeros(WIDTH), random.normal(0, 0.05, (WIDTH, rank)))
    seen_linear, seen_factors, seen_bias = np.full(WIDTH, 1e-6), np.full((WIDTH, rank), 1e-6), 1e-6
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for at in range(0, len(rows), batch):
            some = [rows[i] for i in order[at : at + batch]]
            index, value = np.concatenate([r[0] for r in some]), np.concatenate([r[1] for r in some])
            lengths = np.array([len(r[0]) for r in some])
            starts = np.concatenate([[0], np.cumsum(lengths)])
            y = np.array([r[2] for r in some])
            margin, sums = m.parts(index, value, starts)
            slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) * np.array([shares[v] for v in y]) / len(some)
            each = np.repeat(slope, lengths) * value
            used, back = np.unique(index, return_inverse=True)
            g = np.bincount(back, each) + decay * m.linear[used]
            pull = each[:, None] * (np.repeat(sums, lengths, axis=0) - m.factors[index] * value[:, None])
            gf = np.stack([np.bincount(back, pull[:, k]) for k in range(rank)], 1) + decay * m.factors[used]
            seen_linear[used] += g**2
            seen_factors[used] += gf**2
            seen_bias += slope.sum() ** 2
            m.linear[used] -= rate * g / np.sqrt(seen_linear[used])
            m.factors[used] -= rate * gf / np.sqrt(seen_factors[used])
            m.bias -= rate * slope.sum() / np.sqrt(seen_bias)
    return m


def fit_machine(docs: DataFrame, labels: DataFrame, folds: int, held: int, per_class: int, rank: int, epochs: int, rate: float, decay: float) -> Machine | None:
    """Fits on the driver, on the hashed features of at most 2 * per_class rows; None where a class has no rows."""
    sample, sizes = labelled_sample(docs, labels, "quality", fold_of(F.col("doc_id"), folds) != held, per_class)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        index, value, starts = features(batch.column("text"))
        lists = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(x)) for x in (index.astype(np.int32), value.astype(np.float32))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *lists], names=["doc_id", "label", "index", "value"])

    if min(sizes.get(0, 0), sizes.get(1, 0)) == 0:
        return None
    found = over_texts(sample.select("doc_id", "label", "text"), work, "doc_id long, label int, index array<int>, value array<float>").toArrow()
    rows = sorted(((i, y, x.tobytes(), v.tobytes()) for i, y, x, v in zip(found["doc_id"].to_pylist(), found["label"].to_pylist(), (x.values.to_numpy() for x in found["index"]), (x.values.to_numpy() for x in found["value"]), strict=True)))
    taken = {k: sum(r[1] == k for r in rows) for k in (0, 1)}
    if not all(taken.values()):
        return None
    shares = {k: sizes[k] / taken[k] * len(rows) / sum(sizes.values()) for k in (0, 1)}
    return train([(np.frombuffer(x, np.int32).astype(np.int64), np.frombuffer(v, np.float32).astype(float), y) for _, y, x, v in rows], shares, rank, epochs, rate, decay)


def quality_scores(
    docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, threshold: float = 0.5, per_class: int = 3000, rank: int = 8, epochs: int = 12, rate: float = 0.1, decay: float = 1e-5
) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of documents.

    ``per_class`` bounds the labelled rows that the machine is fitted on.  Null or empty texts
    score by their statistics.  Repeated rows score alike, and a null doc_id, which isn't among
    the labelled rows, as any other.  Without labelled rows of both classes every score is 0.5.
    An empty table gives no rows.
    """
    machine = fit_machine(docs, labels, folds, held, per_class, rank, epochs, rate, decay)
    shipped = docs.sparkSession.sparkContext.broadcast(machine)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = np.full(batch.num_rows, 0.5) if shipped.value is None else shipped.value.score(*features(batch.column("text")))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    scored = over_texts(documents_of(docs), work, "doc_id long, score double")
    return scored.select("doc_id", (fold_of(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
