"""Benchmark decontamination by SimHash windows.

For each item length, the windows of so many words of a document get a 64-bit SimHash over the
occurrences of their five-word shingles: the second time that a shingle comes is another element
than the first, so that sets of occurrences have the Jaccard similarity of the weighted shingles.
A document with fewer words is one window as a whole.  Item fingerprints lie in a multi-index: five blocks of bits, each listing under
every block value the items whose own value differs in ``reach`` bits of the block at most.  The
reaches add up to the radius less four, so two fingerprints within the radius are within reach
in one block at least, and none is missed.  What the index gives is compared by Hamming
distance, then by exact weighted Jaccard similarity of the shingles.

A window of similarity 0.8 has a cosine of 0.89 with its item over occurrences, whatever its
repeats, and differs from it in about 10 bits, with a deviation below 3; the radius of 20 is a
chance bound, met but for one in ten thousand.  Unrelated items differ in
about 32 bits: a third of them are in reach of some block, and hardly any within the radius.

Windows that hold too few shingles of any item to reach the similarity get no fingerprint;
that bound is exact.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, documents_of, kept_rows, mix, over_texts
from .suffix_tree_lm import find

#: Bits of each block of a fingerprint, from the lowest on.
WIDTHS = (13, 13, 13, 13, 12)
#: Shingles of windows with repeats that are looked at together.
REPEATS = 1 << 17
#: Bytes of items that are broadcast at once; a larger benchmark is handled in several passes.
ITEM_BYTES = 2 << 20
#: Bytes of text that a task looks through at once.
BATCH = 2 << 20


def rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each position on, for positions that have so many."""
    n = max(0, len(hashes) - size + 1)
    out = np.full(n, np.uint64(size))
    for k in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n])
    return out


def bits_of(shingles: np.ndarray) -> np.ndarray:
    """64 signs of each shingle's hash."""
    return np.unpackbits(mix(shingles).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


def fingerprints(shingles: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """SimHash of the ``width`` shingles from each start on, by their occurrences: what comes again in a window is an element of its own each time.

    Sums run over the shingles as if each came once; windows in which some come again, get the
    difference for those occurrences.
    """
    bits = bits_of(shingles)
    sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
    found = sums[starts + width] - sums[starts]
    n = len(shingles)
    order = np.argsort(shingles, kind="stable")
    new = np.append(True, shingles[order][1:] != shingles[order][:-1])
    if not new.all():
        heads = np.flatnonzero(new)
        group, rank, following = np.empty(n, np.int64), np.empty(n, np.int64), np.full(n, n)
        group[order] = np.cumsum(new) - 1
        rank[order] = np.arange(n) - np.repeat(heads, np.diff(np.append(heads, n)))
        following[order[:-1][~new[1:]]] = order[1:][~new[1:]]
        again = np.minimum.accumulate(following[::-1])[::-1]  # from each place on, where something comes again first
        windows, places = np.flatnonzero(again[starts] < starts + width), group[order] * (n + 1) + order
        step = max(1, REPEATS // width)
        for k in range(0, len(windows), step):
            own = windows[k : k + step]
            at = starts[own][:, None] + np.arange(width)
            earlier = np.searchsorted(places, group[at] * (n + 1) + starts[own][:, None]) - heads[group[at]]  # before the window
            time = rank[at] - earlier
            w, p = np.nonzero(time)
            at = at[w, p]
            element = shingles[at] + time[w, p].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
            first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
            found[own[w[first]]] += np.add.reduceat(bits_of(element) - bits[at], first, axis=0)
    return np.packbits(found > 0, axis=1).view(np.uint64).ravel()


def similarity(a: dict[int, int], b: dict[int, int]) -> float:
    """Weighted Jaccard: sum of smaller weights over sum of larger ones."""
    both = sum(min(n, b.get(k, 0)) for k, n in a.items())
    return both / (sum(a.values()) + sum(b.values()) - both)


def weights_of(shingles: np.ndarray) -> dict[int, int]:
    keys, n = np.unique(shingles, return_counts=True)
    return dict(zip(keys.tolist(), n.tolist(), strict=True))


class MultiIndex:
    """Fingerprints by the values of their blocks, each under all values within reach of its own."""

    def __init__(self, prints: np.ndarray, radius: int) -> None:
        self.prints, self.radius, self.lists = prints, radius, []
        spread, more = divmod(radius - len(WIDTHS) + 1, len(WIDTHS))
        for b, (values, width) in enumerate(zip(self.blocks(prints), WIDTHS, strict=True)):
            flips = np.arange(1 << width)
            flips = flips[np.bitwise_count(flips) <= spread + (b < more)]
            listed = (values[:, None] ^ flips).ravel()
            order = np.argsort(listed, kind="stable")
            self.lists.append((np.searchsorted(listed[order], np.arange((1 << width) + 1)), (order // max(1, len(flips))).astype(np.int32)))

    @staticmethod
    def blocks(prints: np.ndarray) -> list[np.ndarray]:
        shifts = np.cumsum((0, *WIDTHS[:-1]))
        return [(prints >> np.uint64(s)).astype(np.int64) & ((1 << w) - 1) for s, w in zip(shifts.tolist(), WIDTHS, strict=True)]

    def in_reach(self, print_: np.uint64) -> np.ndarray:
        """The fingerprints in reach of some block: all within the radius, and some more."""
        found = [items[starts[v] : starts[v + 1]] for v, (starts, items) in zip((int(x[0]) for x in self.blocks(np.array([print_]))), self.lists, strict=True)]
        return np.unique(np.concatenate(found))

    def near_many(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among ``prints``, fingerprint) of all pairs within the radius, in order."""
        found, n = [], max(1, len(self.prints))
        for values, (starts, items) in zip(self.blocks(prints), self.lists, strict=True):
            low, size = starts[values], starts[values + 1] - starts[values]
            place = np.repeat(np.arange(len(prints)), size)
            item = items[np.arange(len(place)) + np.repeat(low - np.cumsum(size) + size, size)]
            close = np.bitwise_count(self.prints[item] ^ prints[place]) <= self.radius
            found.append(place[close] * n + item[close])
        pairs = np.unique(np.concatenate(found))
        return pairs // n, pairs % n

    def near(self, print_: np.uint64) -> np.ndarray:
        """The fingerprints within the radius of one."""
        return self.near_many(np.array([print_]))[1]


class Items:
    """A block of benchmark items: fingerprints in the multi-index, and lengths."""

    def __init__(self, rows: list[tuple[int, str]], size: int, least: float, radius: int) -> None:
        self.size, self.least = size, least
        words = Words(pa.array([t for _, t in rows], pa.string()))
        hashes = words.hashes()
        self.weights: list[dict[int, int]] = []
        self.ids: list[list[int]] = []
        by_words: dict[bytes, int] = {}
        self.of_length: dict[int, list[int]] = defaultdict(list)
        prints = []
        for i, (item_id, _) in enumerate(rows):
            own = hashes[words.starts[i] : words.starts[i + 1]]
            if not len(own):
                continue
            at = by_words.setdefault(own.tobytes(), len(self.ids))
            if at < len(self.ids):
                self.ids[at].append(item_id)
                continue
            s = rolled(own, min(size, len(own)))
            self.ids.append([item_id])
            self.weights.append(weights_of(s))
            prints.append(fingerprints(s, np.array([0]), len(s))[0])
            self.of_length[len(own)].append(at)
        self.index = MultiIndex(np.array(prints, np.uint64), radius)
        self.length = np.zeros(len(prints), np.int64)
        for n, at in self.of_length.items():
            self.length[at] = n
        self.known = {k: np.array(sorted({h for n, at in self.of_length.items() if min(size, n) == k for i in at for h in self.weights[i]}), np.uint64) for k in {min(size, n) for n in self.of_length}}

    def matches(self, hashes: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(item, best similarity, first word of that window, its words) for one text's words, with hits checked already."""
        best: dict[int, tuple[float, int, int]] = {}
        for size, known in self.known.items():
            s = rolled(hashes, size)
            hits = np.concatenate([[0], np.cumsum(find(known, s) >= 0)])
            if not hits[-1]:
                continue
            for n in (n for n in self.of_length if min(self.size, n) == size):
                wanted = n - size + 1
                width = min(wanted, len(s))  # all of a document that is shorter than the item
                if width < wanted * self.least - 1e-9:
                    continue
                # Jaccard of ``least`` needs so many common shingles, whatever the two sizes
                starts = np.flatnonzero(hits[width:] - hits[: len(hits) - width] >= (width + wanted) * self.least / (1 + self.least) - 1e-9)
                if not len(starts):
                    continue
                place, item = self.index.near_many(fingerprints(s, starts, width))
                same_length = self.length[item] == n
                own: dict[int, dict[int, int]] = {}
                for k, i in zip(place[same_length].tolist(), item[same_length].tolist(), strict=True):
                    start = int(starts[k])
                    if k not in own:
                        own[k] = weights_of(s[start : start + width])
                    if (j := similarity(own[k], self.weights[i])) >= self.least - 1e-12 and j > best.get(i, (0, 0))[0]:
                        best[i] = j, start, min(n, len(hashes))
        return [(i, *found) for i, found in sorted(best.items())]

    def search(self, texts: pa.Array) -> Iterator[tuple[int, list[tuple[int, float, int, int]]]]:
        """(position of the text, matches) for texts with any."""
        words = Words(texts)
        hashes, owners, some = words.hashes(), words.owners(), np.zeros(len(texts), bool)
        for size, known in self.known.items():
            s = rolled(hashes, size)
            at = np.flatnonzero(find(known, s) >= 0)
            some[owners[at][owners[at] == owners[at + size - 1]]] = True
        for i in np.flatnonzero(some):
            if found := self.matches(hashes[words.starts[i] : words.starts[i + 1]]):
                yield int(i), found


def item_blocks(benchmark: DataFrame, size: int, least: float, radius: int) -> Iterator[Items]:
    """The benchmark in blocks of bounded size."""
    rows, held = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        rows.append((r.item_id, r.text))
        held += len(r.text)
        if held > ITEM_BYTES:
            yield Items(rows, size, least, radius)
            rows, held = [], 0
    yield Items(rows, size, least, radius)


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = 5, least: float = 0.8, radius: int = 20) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words: the best window of each document for each item it holds.

    A window holds an item if the weighted Jaccard similarity of their ``size``-word shingles
    is ``least`` or more (an item with fewer words is one shingle).  A document with fewer words
    than the item is its only window.  Only such pairs are returned; of equally similar windows
    the first.  Null or empty texts and items match nothing; items with equal words each get
    their row; repeated documents, and those without an id, each get theirs.  An empty table on either side: no rows.
    """
    spark, parts = docs.sparkSession, []
    for items in item_blocks(benchmark, size, least, radius):
        parts.append(over_texts(documents_of(docs), searcher(spark.sparkContext.broadcast(items)), "doc_id long, item_id long, similarity double, first_word long, n_words long", BATCH))
    return reduce(DataFrame.unionByName, parts)


def searcher(shipped) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        items, ids, rows = shipped.value, batch.column("doc_id").to_pylist(), []
        for at, found in items.search(batch.column("text")):
            rows += [(ids[at], item_id, j, start, n) for i, j, start, n in found for item_id in items.ids[i]]
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["doc_id", "item_id", "similarity", "first_word", "n_words"])

    return work


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 5, least: float = 0.8, radius: int = 20) -> DataFrame:
    """The rows of documents, all columns, that hold no item; decided row by row, without a shuffle.

    Null and empty texts hold none and stay; repeated rows share their fate; null doc_ids are
    rows as any other.  Without items all rows stay.  Extra columns are carried, whatever their
    names.
    """
    for items in item_blocks(benchmark, size, least, radius):
        shipped = docs.sparkSession.sparkContext.broadcast(items)
        docs = kept_rows(docs, keeper(shipped), BATCH)
    return docs


def keeper(shipped) -> Callable[[pa.Array], np.ndarray]:
    def keep(texts: pa.Array) -> np.ndarray:
        kept = np.ones(len(texts), bool)
        kept[[at for at, _ in shipped.value.search(texts)]] = False
        return kept

    return keep
