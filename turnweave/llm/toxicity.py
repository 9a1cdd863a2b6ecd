"""Toxicity by nearest labelled examples.

Texts are TF-IDF vectors of length 1 over all their words.  A word weighs
(1 + log tf) * idf * relevance: idf is counted over all documents; relevance is the
log-likelihood ratio of the word's presence and the label among the examples, 0 for words that
no example has.  No word is left out, and the norm of a text is exact without a join.  The
examples' inverted index keeps, for each word, its postings in blocks of examples and the
largest weight in each block.  A query's bound for a block is the sum of its weights times
those maxima; blocks are opened from the highest bound down until the next bound cannot beat
the k-th best cosine, so the nearest examples are exact.  Votes, weighted by squared cosine and
class share, are calibrated on the examples themselves, each left out in turn.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, documents_of, fold_of, kept_rows, over_texts
from .labelled import labelled_sample
from .suffix_tree_lm import find

#: Taken off both ends of a word.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def terms_of(texts: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owners, terms, counts), sorted by owner and term: hashes of words, or positions in sorted ``wanted`` of those that are there."""
    words = Words(texts)
    bare = pc.ascii_trim(words.uniques, PUNCTUATION).dictionary_encode()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, bare.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(bare.dictionary))
    every = np.unique(hashes) if wanted is None else wanted
    at = find(every, hashes)
    at[pc.equal(pc.binary_length(bare.dictionary), 0).to_numpy(zero_copy_only=False).astype(bool)] = -1
    term = at[bare.indices.to_numpy()][words.codes] if len(words.codes) else np.zeros(0, np.int64)
    kept = term >= 0
    keys, counts = np.unique((words.owners()[kept].astype(np.int64) << 32) | term[kept], return_counts=True)
    terms = keys & 0xFFFFFFFF
    return keys >> 32, every[terms] if wanted is None else terms, counts


@dataclass
class Index:
    """Examples by blocks.  Postings are ordered by (term, block)."""

    terms: np.ndarray
    scale: np.ndarray  # idf times relevance
    ids: np.ndarray
    labels: np.ndarray
    weights: np.ndarray  # of votes
    block: int
    starts: np.ndarray  # of each (term, block) among the postings
    example: np.ndarray
    value: np.ndarray
    most: np.ndarray  # term x block: largest value
    nearest: int
    prior: float = 0.0
    curve: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.array([0.0, 1.0]), np.array([0.0, 1.0])))
    opened: int = 0

    def vectors(self, owners: np.ndarray, terms: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of each row's terms and their weights, of length 1."""
        raw = (1 + np.log(counts)) * self.scale[terms]
        norm = np.sqrt(np.bincount(owners, raw**2, n))
        return np.searchsorted(owners, np.arange(n + 1)), raw / np.maximum(norm, 1e-12)[owners]

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of highest cosine (ties: smaller position) with cosine over 0, and the cosines."""
        bounds = weights @ self.most[terms]
        order, blocks = np.argsort(-bounds, kind="stable"), self.most.shape[1]
        best, least = (np.zeros(0, np.int64), np.zeros(0)), 0.0
        for b in order:
            if bounds[b] <= 0 or len(best[0]) == k and bounds[b] < least - 1e-12:
                break
            self.opened += 1
            at = terms * blocks + b
            lo, hi = self.starts[at], self.starts[at + 1]
            size = hi - lo
            where = np.arange(size.sum()) + np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
            sums = np.bincount(self.example[where] - b * self.block, self.value[where] * np.repeat(weights, size), self.block)
            found = np.flatnonzero(sums > 0)
            found = found[found + b * self.block != leave]
            ids, cosines = np.concatenate([best[0], found + b * self.block]), np.concatenate([best[1], sums[found]])
            top = np.lexsort((ids, -cosines))[:k]
            best = ids[top], cosines[top]
            least = best[1][-1] if len(top) == k else 0.0
        return best

    def vote(self, found: np.ndarray, cosines: np.ndarray) -> float:
        pull = cosines**2 * self.weights[found]
        return float((pull @ self.labels[found] + 0.05 * self.prior) / (pull.sum() + 0.05))

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, *self.curve)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted monotone fit by pooling neighbours, as points of a curve."""
    pools: list[list[float]] = []
    for i in np.argsort(x, kind="stable"):
        pools.append([y[i] * w[i], w[i], x[i] * w[i]])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    p = np.array(pools)
    return p[:, 2] / p[:, 1], p[:, 0] / p[:, 1]


def relevance(toxic: np.ndarray, docs: np.ndarray, n_toxic: int, n: int) -> np.ndarray:
    """Log-likelihood ratio of a word's presence (in ``docs`` of n examples, ``toxic`` of n_toxic toxic ones) and the label."""

    def part(k: np.ndarray, m: int) -> np.ndarray:
        rate = docs / n
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(k > 0, k * np.log(k / (m * rate)), 0) + np.where(k < m, (m - k) * np.log((m - k) / (m * (1 - rate))), 0)

    return np.maximum(part(toxic, n_toxic) + part(docs - toxic, n - n_toxic), 0)


def example_terms(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All words of the examples (sorted hashes) and their relevance.  Bounded, as the examples are."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        owners, terms, _ = terms_of(batch.column("text"))
        return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(np.asarray(batch.column("label"))[owners])], names=["term", "label"])

    seen = over_texts(sample.select("label", "text"), work, "term long, label int").groupBy("term").agg(F.sum("label").alias("toxic"), F.count(F.lit(1)).alias("docs")).toArrow()
    n = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    terms = np.asarray(seen["term"]).astype(np.int64).view(np.uint64)
    order = np.argsort(terms)
    return terms[order], relevance(np.asarray(seen["toxic"]).astype(float), np.asarray(seen["docs"]).astype(float), n.get(1, 0), sum(n.values()))[order]


def document_frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many of all documents each of these words occurs, and how many documents there are."""
    shipped = docs.sparkSession.sparkContext.broadcast(terms)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, found, _ = terms_of(batch.column("text"), shipped.value)
        n = np.bincount(found, minlength=len(shipped.value))
        at = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(n[at], batch.num_rows))], names=["term", "n"])

    rows = over_texts(documents_of(docs).select("text"), work, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out, n = np.zeros(len(terms) + 1, np.int64), np.asarray(rows["n"])
    out[np.asarray(rows["term"])] = n
    return out[:-1], int(out[-1])


def build_index(docs: DataFrame, labels: DataFrame, folds: int, held: int, per_class: int, block: int, nearest: int) -> Index | None:
    """The example index, on at most 2 * per_class rows; None where a class has no rows."""
    sample, sizes = labelled_sample(docs, labels, "toxic", fold_of(F.col("doc_id"), folds) != held, per_class)
    if min(sizes.get(0, 0), sizes.get(1, 0)) == 0 or len({r.label for r in sample.select("label").distinct().collect()}) < 2:
        return None
    terms, tells = example_terms(sample)
    df, n_docs = document_frequencies(docs, terms)
    scale = (np.log((n_docs + 1) / (df + 1)) + 1) * tells

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        owners, found, counts = terms_of(batch.column("text"), terms)
        starts = pa.array(np.searchsorted(owners, np.arange(batch.num_rows + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(starts, pa.array(x.astype(np.int32))) for x in (found, counts)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *lists], names=["doc_id", "label", "term", "n"])

    rows = over_texts(sample.select("doc_id", "label", "text"), work, "doc_id long, label int, term array<int>, n array<int>").toArrow().to_pylist()
    # neighbours of a block should be alike: by label, then by their heaviest term
    rows.sort(key=lambda r: (r["label"], max(((scale[t], t) for t in r["term"]), default=(0, 0)), r["doc_id"]))
    n, size = len(rows), [len(r["term"]) for r in rows]
    owners = np.repeat(np.arange(n), size)
    term, count = (np.array([x for r in rows for x in r[k]], np.int64) for k in ("term", "n"))
    y = np.array([r["label"] for r in rows])
    blocks = -(-n // block)
    share = {k: sizes[k] / (y == k).sum() for k in (0, 1)}
    weights = np.array([share[v] for v in y]) / share[0]
    index = Index(terms, scale, np.array([r["doc_id"] for r in rows]), y, weights, block, np.zeros(0), np.zeros(0), np.zeros(0), np.zeros((len(terms), blocks)), nearest)
    starts, value = index.vectors(owners, term, count, n)
    slot = term * blocks + owners // block
    order = np.lexsort((owners, slot))
    index.starts = np.searchsorted(slot[order], np.arange(len(terms) * blocks + 1))
    index.example, index.value = owners[order], value[order]
    np.maximum.at(index.most, (term, owners // block), value)
    index.prior = float(weights @ y / weights.sum())
    raw = np.array([index.vote(*index.search(term[a:b], value[a:b], nearest, i)) for i, (a, b) in enumerate(zip(starts, starts[1:], strict=False))])
    index.curve = isotonic(raw, y.astype(float), weights)
    return index


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = 0.3, per_class: int = 2000, block: int = 256, nearest: int = 16
) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (nearest examples' doc_ids) and similarity for every row of documents.

    ``per_class`` bounds the labelled examples.  Texts without a word of any example, also null
    and empty ones, have no neighbours and score as the calibrated share of toxic labels.  Of
    equal cosines the example that comes first in the index is nearer.  A labelled row that is
    an example finds itself as the nearest one, so its score says nothing of the method: only
    held-out rows do.  The calibration leaves each example out of its own vote.  Repeated rows
    score alike.  Without labels of both classes every score is 0.  An empty table gives one with no
    rows.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(build_index(docs, labels, folds, held, per_class, block, nearest))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores, near, cosine = score_batch(shipped.value, batch.column("text"))
        columns = [batch.column("doc_id"), pa.array(scores), pa.array(near, pa.list_(pa.int64())), pa.array(cosine, pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "evidence", "similarity"])

    scored = over_texts(documents_of(docs), work, "doc_id long, score double, evidence array<long>, similarity array<double>")
    return scored.select(
        "doc_id", (fold_of(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence", "similarity",
    )


def score_batch(index: Index | None, texts: pa.Array) -> tuple[np.ndarray, list[list[int]], list[list[float]]]:
    """Scores, nearest examples' doc_ids and their cosines."""
    n = len(texts)
    raw, near, cosine = np.zeros(n), [[]] * n, [[]] * n
    if index is None:
        return raw, near, cosine
    owners, terms, counts = terms_of(texts, index.terms)
    starts, weights = index.vectors(owners, terms, counts, n)
    for i, (a, b) in enumerate(zip(starts, starts[1:], strict=False)):
        found, cosines = index.search(terms[a:b], weights[a:b], index.nearest)
        raw[i] = index.vote(found, cosines)
        near[i], cosine[i] = index.ids[found].tolist(), cosines.tolist()
    return index.calibrated(raw), near, cosine


def drop_toxic(
    docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = 0.3, per_class: int = 2000, block: int = 256, nearest: int = 16
) -> DataFrame:
    """The rows of documents, all columns, that score under ``threshold``; decided row by row, without a shuffle.

    Null and empty texts and repeated rows are judged by their scores (see
    :func:`toxicity_scores`), null doc_ids as any other; without labels of both classes all rows
    stay.  Extra columns are carried, whatever their names.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(build_index(docs, labels, folds, held, per_class, block, nearest))
    return kept_rows(docs, lambda texts: score_batch(shipped.value, texts)[0] < threshold)
