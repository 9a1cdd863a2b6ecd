"""Language-model scores from a probabilistic suffix tree over words.

Nodes are contexts of any length.  A context of ``min_context`` occurrences in the whole
training corpus, whose own suffix is a node, keeps the next symbols of ``min_pair`` occurrences
that diverge from what its suffix predicts, and stays if its next-symbol counts diverge by more
log-likelihood than its parameters cost.  Level k counts runs of k + 1 tokens; from the second
level on, a run is counted if the level above counted it without its last token, and kept it
without its first, so the tree grows where there is something to learn and stops by itself.
(Bloom filters say where such runs may be and never miss one; exact counts and joins decide.)  The thresholds are fixed counts, so the tree grows with the corpus; it is kept
in tables.

The distribution of a node: a kept symbol has (c + prior * q) / (n + prior), with q its chance
at the node's suffix; all others share what is left in proportion to q.  The root is the add-one
word distribution.  Each sums to one.  A token is scored in the longest suffix of its past that
is a node.

For scoring, the ``head`` nodes and symbols of most occurrences are broadcast (a fixed number).
What else a piece of text may need is asked of the tables, each key once, and answered, so
nothing is left out.

Disk: runs on their way to where they are counted are packed, a row for each class of keys of a
batch.  Those of three tokens and more are counted in shares of their keys, and documents that
need more than the head are scored in rounds; shuffle files go behind each share and round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FILTER_BITS, Words, bound_batches, discard, documents_of, filter_from, filter_words, fold_of, may_hold, materialize, mix, over_texts, pieces

#: Stand-ins for the end of a text, counted as a token, and for what is before its first word.
END, START = np.uint64(0x6A09E667F3BCC908), np.uint64(0x3B67AE8584CAA73B)
#: Bytes of text counted, and scored, at once in a task; tokens, and nodes and kept symbols, that are broadcast for scoring.
PIECE, SCORED, HEAD_TOKENS, HEAD = 8 << 20, 3 << 20, 500_000, 4_000_000
#: Power of the largest filter's bits; bits of a token's place among those that are broadcast; least classes of keys; bytes of a file's dictionary of tokens.
MOST_BITS, PLACE_BITS, CLASSES, DICTIONARY = 30, 20, 64, 8 << 20
#: Shares in which runs are counted if there is one for each token of all texts; most rounds of scoring; nodes and kept symbols of a class of the tree.
SHARES, ROUNDS, CLASS = 3, 16, 1 << 19
#: Sets the keys of nodes apart from those of kept symbols.
NODE = np.uint64(0xBB67AE8584CAA73B)
#: How far the second token's hash is turned in the key of two tokens.
TURN = 23


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Positions of ``wanted`` in sorted ``keys``, -1 where absent."""
    if not len(keys):
        return np.full(len(wanted), -1)
    # in order, so that the search goes through the keys once
    order = np.argsort(wanted)
    at = np.empty(len(wanted), np.int64)
    at[order] = np.minimum(np.searchsorted(keys, wanted[order]), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class Runs:
    """The tokens of a batch of texts, each begun by START and ended by END, or of ``stretches``, and the keys of their runs."""

    def __init__(self, texts: pa.Array) -> None:
        if pa.types.is_list(texts.type):
            self.starts = texts.offsets.to_numpy().astype(np.int64) - texts.offsets[0].as_py()
            self.keys = [texts.flatten().to_numpy(zero_copy_only=False).view(np.uint64)]
            self.place = np.arange(self.starts[-1], dtype=np.int32) - np.repeat(self.starts[:-1], np.diff(self.starts)).astype(np.int32)
            return
        words = Words(texts)
        n, m = len(words.starts) - 1, len(words.uniques)
        self.starts = words.starts + 2 * np.arange(n + 1)
        self.codes = np.full(self.starts[-1], m + 1, np.int32)
        self.codes[self.starts[:-1]] = m
        self.codes[np.arange(len(words.codes)) + np.repeat(1 + 2 * np.arange(n), words.lengths)] = words.codes
        self.hashes = np.concatenate([words.unique_hashes(), [START, END]]).astype(np.uint64)
        self.place = np.arange(self.starts[-1], dtype=np.int32) - np.repeat(self.starts[:-1], np.diff(self.starts)).astype(np.int32)
        self.keys = [self.hashes[self.codes]]

    def key(self, n: int) -> np.ndarray:
        """Key of the run of ``n`` tokens that ends at each place; of no meaning where the text has fewer up to there."""
        while len(self.keys) < n:
            longer = np.zeros_like(self.keys[0])
            longer[1:] = run_key(self.keys[-1][:-1], self.keys[-1][1:], len(self.keys) + 1)
            self.keys.append(longer)
        return self.keys[n - 1]

    def key_at(self, n: int, at: np.ndarray) -> np.ndarray:
        """``key(n)`` of some places, without that of all others."""
        shorter = min(n, max(2, len(self.keys)))
        parts = [self.key(shorter)[at - back] for back in range(n - shorter, -1, -1)]
        for size in range(shorter + 1, n + 1):
            parts = [run_key(a, b, size) for a, b in zip(parts, parts[1:])]
        return parts[0]


def run_key(context: np.ndarray, suffix: np.ndarray, n: int) -> np.ndarray:
    """Key of a run of ``n`` tokens by those of the run without its last and without its first token."""
    if n == 2:
        return context ^ (suffix << np.uint64(TURN) | suffix >> np.uint64(64 - TURN))
    return mix(context * np.uint64(0x9E3779B97F4A7C15) + suffix + np.uint64(n))


def tally(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, where each is first, and how often it occurs."""
    return np.unique(keys, return_index=True, return_counts=True)


def token_counts(docs: DataFrame) -> DataFrame:
    """key (64-bit hash), c: of all tokens of all texts, ends included."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        r = Runs(batch.column("text"))
        n = np.bincount(r.codes, minlength=len(r.hashes))
        n[-2] = 0
        return pa.RecordBatch.from_arrays([pa.array(r.hashes[n > 0].view(np.int64)), pa.array(n[n > 0])], names=["key", "c"])

    return over_texts(docs.select("text"), work, "key long, c long", PIECE).groupBy("key").agg(F.sum("c").alias("c"))


def filter_for(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of the column ``key`` of a table, of 8 bits a key or more, up to 2 ** MOST_BITS."""
    power = min(MOST_BITS, max(FILTER_BITS, (8 * keys.count()).bit_length()))
    words = filter_words(keys, power)
    if power == FILTER_BITS:
        return filter_from(words)
    words = materialize(words, "filter", release=True)
    out = filter_from(words, power)
    discard(words)
    return out


def class_of(keys: np.ndarray, classes: int) -> np.ndarray:
    """Keys in order have their classes in order."""
    return ((keys >> np.uint64(32)) * np.uint64(classes) >> np.uint64(32)).astype(np.int64)


def binary(bounds: np.ndarray, values: np.ndarray) -> pa.Array:
    """The bytes of the values between each two bounds."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def values_of(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """What ``binary`` was given: bounds, from 0 on, and values."""
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, kind)
    _, offsets, held = column.buffers()
    bounds = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    size = np.dtype(kind).itemsize
    values = np.frombuffer(held, kind, (bounds[-1] - bounds[0]) // size, bounds[0]) if bounds[-1] > bounds[0] else np.zeros(0, kind)
    return (bounds - bounds[0]) // size, values


def by_class(classes: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """A row for each class of rows in the order of their classes: class, and the bytes of its part of each column."""
    edges = np.flatnonzero(np.diff(classes, prepend=-1))
    bounds = np.append(edges, len(classes))
    return pa.RecordBatch.from_arrays([pa.array(classes[edges].astype(np.int32)), *(binary(bounds, x) for x in columns.values())], names=["class", *columns])


def whole_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of rows in the order of their classes, put together so that no class is in two."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        classes = batch.column("class").to_numpy()
        cut = int(np.searchsorted(classes, classes[-1]))
        if cut or (held and held[-1].column("class")[0].as_py() != classes[0]):
            yield pa.concat_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.concat_batches(held)


def added(keys: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct key is first, and the sum of its counts."""
    order = np.argsort(keys, kind="stable")
    edges = np.flatnonzero(np.diff(keys[order], prepend=keys[order[:1]] ^ keys.dtype.type(1))) if len(keys) else order
    return order[edges], np.add.reduceat(c[order], edges) if len(keys) else c


#: Counts of runs on their way, a row for each class of keys of a batch: of runs of two known tokens,
#: the differences of (place of the first, place of the second) among these; of others, the keys
#: without the last and without the first token; and their counts.
PACKED = "class int, low binary, high binary, context binary, suffix binary, c binary"
NONE32, NONE8, NONE64 = (np.zeros(0, kind) for kind in (np.uint32, np.uint8, np.uint64))


def packed_keys(classes: np.ndarray, context: np.ndarray, suffix: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    rows = by_class(classes, context=context, suffix=suffix, c=c.astype(np.uint32))
    nothing = binary(np.zeros(rows.num_rows + 1, np.int64), NONE8)
    return pa.RecordBatch.from_arrays([rows.column("class"), nothing, nothing, *rows.columns[1:]], names=["class", "low", "high", "context", "suffix", "c"])


def packed_places(classes: np.ndarray, places: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    """``places`` ascend in each class."""
    step = np.diff(places, prepend=0)
    first = np.flatnonzero(np.diff(classes, prepend=-1))
    step[first] = places[first]
    rows = by_class(classes, low=step.astype(np.uint32), high=(step >> 32).astype(np.uint8), c=c.astype(np.uint32))
    nothing = binary(np.zeros(rows.num_rows + 1, np.int64), NONE8)
    return pa.RecordBatch.from_arrays([*rows.columns[:3], nothing, nothing, rows.column("c")], names=["class", "low", "high", "context", "suffix", "c"])


def summed(packed: DataFrame, n: int, known: np.ndarray, least: int) -> DataFrame:
    """key, context, suffix, c of the runs of ``n`` tokens with ``least`` occurrences; ``known`` are the tokens whose places are given."""
    shipped = packed.sparkSession.sparkContext.broadcast(known)

    def found(context: np.ndarray, suffix: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        columns = [run_key(context, suffix, n), context, suffix]
        return pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in columns), pa.array(c.astype(np.int64))], names=["key", "context", "suffix", "c"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_classes(batches):
            placed = pc.greater(pc.binary_length(batch.column("low")), 0)
            rows = batch.filter(placed)
            bounds, low = values_of(rows.column("low"), np.uint32)
            places = np.cumsum(low.astype(np.int64) | values_of(rows.column("high"), np.uint8)[1].astype(np.int64) << 32)
            # the sums begin anew with each row
            places -= np.repeat(np.concatenate([[0], places])[bounds[:-1]], np.diff(bounds))
            first, c = added(places, values_of(rows.column("c"), np.uint32)[1].astype(np.int64))
            places, c = places[first[c >= least]], c[c >= least]
            yield found(shipped.value[places >> PLACE_BITS], shipped.value[places & ((1 << PLACE_BITS) - 1)], c)
            rows = batch.filter(pc.invert(placed))
            context, suffix = (values_of(rows.column(x), np.uint64)[1] for x in ("context", "suffix"))
            first, c = added(run_key(context, suffix, n), values_of(rows.column("c"), np.uint32)[1].astype(np.int64))
            first, c = first[c >= least], c[c >= least]
            yield found(context[first], suffix[first], c)

    bound_batches(packed.sparkSession)
    return packed.repartition("class").sortWithinPartitions("class").mapInArrow(work, "key long, context long, suffix long, c long")


def pair_counts(docs: DataFrame, begins: np.ndarray, ends: np.ndarray, known: np.ndarray, classes: int, least: int) -> DataFrame:
    """key, context, suffix, c: pairs of tokens with ``least`` occurrences; ``begins`` and ``ends`` are filters of the tokens that may be a pair's first and second.

    ``known`` are tokens in order; a pair of two of them goes to where it is counted by its places there.
    """
    known = np.union1d(known, [START])[: 1 << PLACE_BITS]
    shipped = docs.sparkSession.sparkContext.broadcast((begins, ends, known))

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        may_begin, may_end, tokens = shipped.value
        r = Runs(batch.column("text"))
        first, second = may_hold(may_begin, r.hashes) | (r.hashes == START), may_hold(may_end, r.hashes)
        at = 1 + np.flatnonzero(second[r.codes[1:]] & first[r.codes[:-1]] & (r.place[1:] >= 1))
        pairs, c = np.unique(r.codes[at - 1].astype(np.int64) << 32 | r.codes[at], return_counts=True)
        left, right = pairs >> 32, pairs & 0xFFFFFFFF
        own = class_of(run_key(r.hashes[left], r.hashes[right], 2), classes)
        place = find(tokens, r.hashes)
        at_left, at_right = place[left], place[right]
        both = (at_left >= 0) & (at_right >= 0)
        i = np.flatnonzero(both)
        places = at_left[i] << PLACE_BITS | at_right[i]
        order = np.lexsort((places, own[i]))
        i, places = i[order], places[order]
        yield packed_places(own[i], places, c[i])
        i = np.flatnonzero(~both)
        i = i[np.argsort(own[i], kind="stable")]
        yield packed_keys(own[i], r.hashes[left[i]], r.hashes[right[i]], c[i])

    return summed(over_texts(docs.select("text"), work, PACKED, PIECE), 2, known, least)


def stretches(docs: DataFrame, begins: np.ndarray, ends: np.ndarray) -> DataFrame:
    """tokens array<long>: the longest stretches in which of every three tokens the first two pass the filter ``begins`` and the last two the filter ``ends``.

    All longer runs that may be counted lie in these, so the texts needn't be read for them again.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((begins, ends))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        r = Runs(batch.column("text"))
        at = np.flatnonzero(r.place >= 2)
        for bits, back in zip(shipped.value, (1, 0), strict=True):
            at = at[may_hold(bits, r.key(2)[at - back])]
        ok = np.zeros(len(r.place) + 2, np.int8)
        ok[at + 1] = 1
        edges = np.flatnonzero(np.diff(ok))
        begin, end = edges[::2] - 2, edges[1::2]
        bounds = np.concatenate([[0], np.cumsum(end - begin)])
        at = np.arange(bounds[-1]) + np.repeat(begin - bounds[:-1], end - begin)
        return pa.RecordBatch.from_arrays([lists(bounds, pa.array(r.keys[0][at].view(np.int64)))], names=["tokens"])

    return over_texts(docs.select("text"), work, "tokens array<long>", PIECE)


def run_counts(parts: DataFrame, n: int, filters: tuple[np.ndarray, np.ndarray] | None, classes: int, share: tuple[int, int], least: int) -> DataFrame:
    """key, context, suffix, c: runs of ``n`` tokens in ``stretches`` with ``least`` occurrences, the keys without their last and without their first token.

    ``filters`` are of the runs of n - 1 tokens with which a run may begin and end.  ``share`` (k, of): one of so many shares of all keys.
    """
    shipped, (k, of) = parts.sparkSession.sparkContext.broadcast(filters), share

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = Runs(batch.column("tokens"))
            shorter = r.key(n - 1)
            at = np.flatnonzero(r.place >= n - 1)
            for bits, back in zip((shipped.value or ())[::-1], (0, 1), strict=False):
                at = at[may_hold(bits, shorter[at - back])]
            keys = run_key(shorter[at - 1], shorter[at], n)
            if of > 1:
                own = np.flatnonzero(class_of(keys, classes) * of // classes == k)
                keys, at = keys[own], at[own]
            keys, first, c = tally(keys)
            at = at[first]
            yield packed_keys(class_of(keys, classes), shorter[at - 1], shorter[at], c)

    bound_batches(parts.sparkSession)
    return summed(parts.mapInArrow(work, PACKED), n, NONE64, least)


@dataclass
class Tree:
    """The tables of a tree.  Chances are log10, those of kept symbols as gains over the root."""

    total: int  # N
    distinct: int  # V
    counts: DataFrame  # key, c of all tokens
    common: tuple[np.ndarray, np.ndarray]  # keys, in order, and counts of the tokens of most occurrences
    nodes: list[DataFrame] = field(default_factory=list)  # of each level: key, c, weight for what the node doesn't keep
    pairs: list[DataFrame] = field(default_factory=list)  # of each level: key, c, gain

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.total + self.distinct + 1))


def fit(docs: DataFrame, folds: int, held: int, min_context: int, min_pair: int, prior: float, cost: float, head_tokens: int) -> Tree:
    train = documents_of(docs).where(fold_of(F.col("doc_id"), folds) != held)
    counts = materialize(token_counts(train), "tokens", release=True)
    size = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    tree = Tree(size.n or 0, size.v, counts, sorted_columns(most_frequent(counts, head_tokens), "c"))
    price = float(cost * np.log(max(tree.total, 2)))
    classes = max(CLASSES, tree.total >> 20)
    # what the level above has: runs and their counts; chances of their last symbols there and at the root
    texts = counts.where(F.col("key") == int(END)).select(F.lit(int(START)).cast("long").alias("key"), "c")
    runs, spent = counts.unionByName(texts), []
    root = F.log10((F.col("c") + 1) / F.lit(float(tree.total + tree.distinct + 1)))
    above = counts.select("key", root.alias("root"), F.lit(0.0).alias("gain"))
    while True:
        level = len(tree.nodes) + 1
        # a run matters if the one without its last token has the occurrences of a context
        filters = filter_for(runs.where(F.col("c") >= max(min_context, min_pair)).select("key")), filter_for((above if level > 1 else counts.where(F.col("c") >= min_pair)).select("key"))
        if level == 1:
            longer = [materialize(pair_counts(train, *filters, tree.common[0], classes, min_pair), "runs-1", release=True)]
        else:
            if level == 2:
                # tokens that come again are kept once a file
                parts = materialize(stretches(train, *filters), "stretches", **{"parquet.dictionary.page.size": DICTIONARY, "compression": "zstd"})
                most = parts.agg(F.sum(F.size("tokens") - 2))
                filters = None  # every three tokens of a stretch have passed
            else:
                # a run goes on from one that has the occurrences of a context
                most = runs.where(F.col("c") >= min_context).agg(F.sum("c"))
            of = max(1, -(-SHARES * (most.first()[0] or 0) // max(tree.total, 1)))
            longer = [materialize(run_counts(parts, level + 1, filters, classes, (k, of), min_pair), f"runs-{level}", release=True) for k in range(of)]
        counted = reduce(DataFrame.unionByName, longer)
        wholes = runs.where(F.col("c") >= min_context).select(F.col("key").alias("context"), F.col("c").alias("whole"))
        tried = counted.join(wholes, "context").join(above.select(F.col("key").alias("suffix"), "root", F.col("gain").alias("parent")), "suffix")
        q, c, whole = F.pow(F.lit(10.0), F.col("root") + F.col("parent")), F.col("c"), F.col("whole")
        p = (c + prior * q) / (whole + prior)
        tried = tried.select("key", "context", "c", "whole", "root", "parent", q.alias("q"), p.alias("p"), (c * F.log(p / q) > price).alias("kept")).where("kept")
        tried = materialize(tried, f"tried-{level}", release=True)
        n = F.count(F.lit(1))
        own = tried.groupBy("context").agg(F.first("whole").alias("whole"), n.alias("n"), F.sum("c").alias("kept_c"), F.sum("p").alias("kept_p"), F.sum("q").alias("kept_q"), F.sum(c * F.log(F.col("p") / F.col("q"))).alias("won"))
        # what is left for other symbols, and how it compares with their share at the suffix
        weight = F.greatest(1 - F.col("kept_p"), F.lit(1e-12)) / F.greatest(1 - F.col("kept_q"), F.lit(1e-12))
        gained = F.col("won") + (whole - F.col("kept_c")) * F.log(weight)
        nodes = own.where(gained > price * (1 + F.col("n"))).select(F.col("context").alias("key"), F.col("whole").alias("c"), F.log10(weight).alias("weight"))
        nodes = materialize(nodes, f"nodes-{level}", release=True)
        if nodes.isEmpty():
            discard(tried, *longer, *spent, *([parts] if level > 1 else []))
            return tree
        known = tried.join(nodes.select(F.col("key").alias("context")), "context", "left_semi").select("key", "c", "root", (F.log10("p") - F.col("root")).alias("gain"))
        known = materialize(known, f"known-{level}", release=True)
        tree.nodes.append(nodes)
        tree.pairs.append(known.select("key", "c", "gain"))
        discard(tried, *spent)
        runs, above, spent = counted.select("key", "c"), known.select("key", "root", "gain"), longer


@dataclass
class Head:
    """What is broadcast for scoring: keys are sorted.  A filter is None if the head has all keys."""

    tokens: np.ndarray
    counts: np.ndarray
    nodes: np.ndarray
    weights: np.ndarray
    pairs: np.ndarray
    gains: np.ndarray
    node_filter: np.ndarray | None
    pair_filter: np.ndarray | None
    levels: int
    total: int
    distinct: int

    base = Tree.base

    def looked_up(self, keys: np.ndarray, values: np.ndarray, bits: np.ndarray | None, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value or NaN, whether only the tables know) of each wanted key."""
        out, open_ = np.full(len(wanted), np.nan), np.zeros(len(wanted), bool)
        maybe = np.arange(len(wanted)) if bits is None else np.flatnonzero(may_hold(bits, wanted))
        at = find(keys, wanted[maybe])
        out[maybe[at >= 0]] = values[at[at >= 0]]
        if bits is not None:
            open_[maybe[at < 0]] = True
        return out, open_

    def node(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.looked_up(self.nodes, self.weights, self.node_filter, wanted)

    def pair(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.looked_up(self.pairs, self.gains, self.pair_filter, wanted)

    def score(self, r: Runs) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """(gain of each place over the root; what must be asked of the tables for places whose gain is left at 0).

        The latter has a row for each such place and level: place, level, node, pair, the weight
        and gain of these as far as they are known, and whether the tables must be asked for them.
        """
        gain, open_ = np.zeros(len(r.codes)), np.zeros(len(r.codes), bool)
        weight, unsure = (x[r.codes] for x in self.node(r.hashes))
        at = 1 + np.flatnonzero((r.place[1:] >= 1) & (unsure[:-1] | ~np.isnan(weight[:-1])))
        weight, unsure = weight[at - 1], unsure[at - 1]
        for level in range(1, self.levels + 1):
            open_[at[unsure]] = True
            at, weight = at[~unsure], weight[~unsure]
            if not len(at):
                break
            kept, unsure = self.pair(r.key_at(level + 1, at))
            open_[at[unsure]] = True
            gain[at] = np.where(np.isnan(kept), weight + gain[at], kept)
            at = at[~unsure & (r.place[at] >= level + 1)]
            if level < self.levels:
                weight, unsure = self.node(r.key_at(level + 1, at - 1))
                node = unsure | ~np.isnan(weight)
                at, weight, unsure = at[node], weight[node], unsure[node]
        gain[open_] = 0
        asked: list[tuple] = []
        at = np.flatnonzero(open_)
        for level in range(1, self.levels + 1):
            at = at[r.place[at] >= level]
            node, pair = r.key_at(level, at - 1), r.key_at(level + 1, at)
            weight, unsure = self.node(node)
            may = unsure | ~np.isnan(weight)
            at, node, pair, weight, unsure = at[may], node[may], pair[may], weight[may], unsure[may]
            asked.append((at, np.full(len(at), level, np.uint8), node, pair, weight, unsure, *self.pair(pair)))
        names = "place", "level", "node", "pair", "weight", "weight_asked", "gain", "gain_asked"
        columns = [np.concatenate(x) for x in zip(*asked, strict=True)] if asked else [np.zeros(0, np.int64)] * len(names)
        order = np.argsort(columns[0], kind="stable")
        return gain, dict(zip(names, (c[order] for c in columns), strict=True))


def most_frequent(table: DataFrame, most: int) -> DataFrame:
    """The rows with c from the smallest power of two on that leaves ``most`` rows at most."""
    sizes = table.groupBy(F.floor(F.log2("c")).alias("power")).count().collect()
    power, held = 64, 0
    for r in sorted(sizes, key=lambda r: -r.power):
        held += r["count"]
        if held > most:
            break
        power = r.power
    return table.where(F.col("c") >= float(2**power))


def sorted_columns(table: DataFrame, value: str) -> tuple[np.ndarray, np.ndarray]:
    got = table.select("key", value).toArrow()
    keys, values = got["key"].to_numpy().view(np.uint64), got[value].to_numpy()
    del got  # the driver holds one copy at a time
    order = np.argsort(keys)
    return keys[order], values[order]


def head_of(tree: Tree, head: int) -> tuple[Head, int]:
    """The head, and how many nodes and kept symbols it lacks."""
    none = np.zeros(0, np.uint64), np.zeros(0)
    columns, filters, lacking = [*none, *none], [None, None], 0
    if tree.nodes:
        columns = []
        for i, (tables, value, most) in enumerate(((tree.nodes, "weight", head // 4), (tree.pairs, "gain", head - head // 4))):
            every = reduce(DataFrame.unionByName, tables)
            columns += sorted_columns(most_frequent(every, most), value)
            if left := every.count() - len(columns[-1]):
                lacking += left
                filters[i] = filter_for(every.select("key"))
    return Head(*tree.common, *columns, *filters, len(tree.nodes), tree.total, tree.distinct), lacking


def lists(bounds: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)


def packed_tree(tree: Tree, classes: int) -> DataFrame:
    """class, keys, values: a row for each class of keys, with the weights of nodes and the gains of kept symbols, keys in order."""
    nodes = reduce(DataFrame.unionByName, tree.nodes).select(F.col("key").bitwiseXOR(int(NODE.view(np.int64))).alias("key"), F.col("weight").alias("value"))
    rows = nodes.unionByName(reduce(DataFrame.unionByName, tree.pairs).select("key", F.col("gain").alias("value")))
    rows = rows.withColumn("class", F.shiftrightunsigned(F.shiftrightunsigned("key", 32) * classes, 32).cast("int"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_classes(batches):
            keys = batch.column("key").to_numpy().view(np.uint64)
            order = np.argsort(keys)
            keys = keys[order]
            yield by_class(class_of(keys, classes), keys=keys, values=batch.column("value").to_numpy()[order])

    bound_batches(nodes.sparkSession)
    return materialize(rows.repartition("class").sortWithinPartitions("class").mapInArrow(work, "class int, keys binary, values binary"), "tree", release=True)


#: What a piece of text asks: of a class of the tree (wanted: keys in order); and what it makes of
#: all answers, in a row without a class: document, level, and where the node's and the symbol's
#: values are among the answers and, behind them, the values known.
ASKED = "piece long, class int, wanted binary, owner binary, level binary, node binary, pair binary, known binary"


def questions(asked: dict[str, np.ndarray], owner: np.ndarray, piece: int, classes: int) -> Iterator[pa.RecordBatch]:
    """The rows ASKED of a piece."""
    keys, is_asked = np.concatenate([asked["node"] ^ NODE, asked["pair"]]), np.concatenate([asked["weight_asked"], asked["gain_asked"]])
    wanted, answer = np.unique(keys[is_asked], return_inverse=True)
    known, place = np.unique(np.concatenate([asked["weight"], asked["gain"]])[~is_asked], return_inverse=True)
    at = np.empty(len(keys), np.int32)
    at[is_asked], at[~is_asked] = answer, len(wanted) + place
    rows = by_class(class_of(wanted, classes), wanted=wanted)
    names = [x.split()[0] for x in ASKED.split(", ")]
    n = rows.num_rows
    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, piece)), *rows.columns, *(pa.nulls(n, pa.binary()) for _ in names[3:])], names=names)
    columns = owner[asked["place"]].astype(np.int32), asked["level"], *np.split(at, 2), known
    whole = [binary(np.array([0, len(x)]), x) for x in columns]
    yield pa.RecordBatch.from_arrays([pa.array([piece]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), *whole], names=names)


def answered(asked: DataFrame, tree: DataFrame) -> DataFrame:
    """row, asked_gain: the sum of the gains of the places of a document that were asked of the packed ``tree``."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, keys, values = -1, NONE64, np.zeros(0)
        for batch in batches:
            out = []
            for own, piece, *held in zip(*(batch.column(x).to_pylist() for x in ("class", "piece", "wanted", "keys", "values")), strict=True):
                if own != current:
                    current, keys, values = own, NONE64, np.zeros(0)
                if piece is None:
                    keys, values = np.frombuffer(held[1], np.uint64), np.frombuffer(held[2])
                else:
                    at = find(keys, np.frombuffer(held[0], np.uint64))
                    out.append((piece, own, np.where(at >= 0, np.append(values, np.nan)[at], np.nan).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(zip(*out) if out else ((), (), ()), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["piece", "class", "values"])

    def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers: list[np.ndarray] = []
        for batch in batches:
            for piece, own, values, *held in zip(*(batch.column(x).to_pylist() for x in ("piece", "class", "values", "owner", "level", "node", "pair", "known")), strict=True):
                if own is not None:
                    answers.append(np.frombuffer(values))
                    continue
                owner, level, node, pair, known = (np.frombuffer(x, kind) for x, kind in zip(held, (np.int32, np.uint8, np.int32, np.int32, np.float64), strict=True))
                value = np.concatenate([*answers, known])
                answers = []
                first = level == 1
                place = np.cumsum(first) - 1
                gain, reached = np.zeros(int(first.sum())), np.ones(int(first.sum()), bool)
                # from the root up, as far as there are nodes
                for n in range(1, int(level.max(initial=0)) + 1):
                    at = np.flatnonzero(level == n)
                    at = at[reached[place[at]]]
                    weight = value[node[at]]
                    reached[place[at[np.isnan(weight)]]] = False
                    at, weight = at[~np.isnan(weight)], weight[~np.isnan(weight)]
                    kept = value[pair[at]]
                    gain[place[at]] = np.where(np.isnan(kept), weight + gain[place[at]], kept)
                total = np.bincount(owner[first], gain)
                rows = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(piece + rows), pa.array(total[rows])], names=["row", "asked_gain"])

    bound_batches(asked.sparkSession)
    none = F.lit(None)
    rows = asked.where("class is not null").select("class", "piece", "wanted", none.cast("binary").alias("keys"), none.cast("binary").alias("values"))
    rows = rows.unionByName(tree.select("class", none.cast("long").alias("piece"), none.cast("binary").alias("wanted"), "keys", "values"))
    answers = rows.repartition("class").sortWithinPartitions("class", F.col("piece").asc_nulls_first()).mapInArrow(answer, "piece long, class int, values binary")
    means = asked.where("class is null and piece is not null").select("piece", "class", "owner", "level", "node", "pair", "known")
    both = answers.unionByName(means, allowMissingColumns=True)
    return both.repartition("piece").sortWithinPartitions("piece", F.col("class").asc_nulls_last()).mapInArrow(gains, "row long, asked_gain double")


def suffix_tree_scores(
    docs: DataFrame, folds: int = 7, held: int = 2, min_context: int = 8, min_pair: int = 4, prior: float = 4.0, cost: float = 0.5, head_tokens: int = HEAD_TOKENS, head: int = HEAD
) -> DataFrame:
    """Base and tree scores (log10) of every row of documents; the fold ``held`` of crc32(doc_id) doesn't train.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.  Null or
    empty text: its end alone.  Repeated rows train each and score alike.  With no training
    rows, N and V are 0 and every score 0.  A null doc_id has the fold of the text ''.  An empty
    table gives no rows.  Tokens and runs are known by 64-bit hashes.
    ``head_tokens`` and ``head`` only bound what is broadcast; they change no result.
    """
    tree = fit(docs, folds, held, min_context, min_pair, prior, cost, head_tokens)
    known, lacking = head_of(tree, head)
    shipped = docs.sparkSession.sparkContext.broadcast(known)
    classes = max(1, (lacking + head) // CLASS)
    packed = packed_tree(tree, classes) if lacking else None
    fields = {"row": pa.int64(), "doc_id": pa.int64(), "n_tokens": pa.int64(), "common": pa.int64(), "base": pa.float64(), "gain": pa.float64(), "tokens": pa.list_(pa.int64()), "times": pa.list_(pa.int64())}
    schema = f"row long, doc_id long, n_tokens long, common long, base double, gain double, tokens array<long>, times array<long>, {ASKED}"
    unseen_log = float(tree.base(np.zeros(1))[0]) if tree.total or tree.distinct else 0.0

    def work(batch: pa.RecordBatch, first_row: int) -> Iterator[pa.RecordBatch]:
        h, n = shipped.value, batch.num_rows
        r = Runs(batch.column("text"))
        symbol, owner = r.place >= 1, np.repeat(np.arange(n), np.diff(r.starts))
        own = find(h.tokens, r.hashes)[r.codes]
        common = symbol & (own >= 0)
        base = np.zeros(len(own))
        base[common] = h.base(h.counts)[own[common]]
        gain, asked = h.score(r)
        add = lambda x: np.bincount(owner, x, n)
        rare, _, times = tally((owner.astype(np.int64) << 32 | r.codes)[symbol & ~common])
        bounds = np.searchsorted(rare >> 32, np.arange(n + 1))
        hashes = r.hashes.view(np.int64)[rare & 0xFFFFFFFF]
        columns = [
            pa.array(first_row + np.arange(n)), batch.column("doc_id"), pa.array(np.diff(r.starts) - 1), pa.array(add(common).astype(np.int64)), pa.array(add(base)), pa.array(add(gain)),
            lists(bounds, pa.array(hashes)), lists(bounds, pa.array(times)),
        ]
        kinds = {x.split()[0]: pa.binary() for x in ASKED.split(", ")} | {"piece": pa.int64(), "class": pa.int32()}
        yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(n, kind) for kind in kinds.values())], names=[*fields, *kinds])
        if len(asked["place"]):
            for rows in questions(asked, owner, first_row, classes):
                yield pa.RecordBatch.from_arrays([*(pa.nulls(rows.num_rows, kind) for kind in fields.values()), *rows.columns], names=[*fields, *kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for piece in pieces(batches, SCORED):
            yield from work(piece, row)
            row += piece.num_rows

    def scores(part: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The scores of some documents, and the table that they are read from."""
        scored = materialize(part.mapInArrow(run, schema), "scored", release=True, compression="zstd")
        rows = scored.where("row is not null")
        rare = rows.select("row", F.explode(F.arrays_zip("tokens", "times")).alias("x")).select("row", F.col("x.tokens").alias("key"), F.col("x.times").alias("times"))
        per_doc = rare.join(tree.counts, "key").groupBy("row").agg(F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("rare_log"))
        joined = rows.select("row", "doc_id", "n_tokens", "common", "base", "gain").join(per_doc, "row", "left")
        extra: Column = F.col("gain")
        if packed is not None:
            joined = joined.join(answered(scored, packed), "row", "left")
            extra = extra + F.coalesce("asked_gain", F.lit(0.0))
        base = F.col("base") + (F.col("n_tokens") - F.col("common")) * F.lit(unseen_log) + F.coalesce("rare_log", F.lit(0.0))
        return joined.select(
            "doc_id", (fold_of(F.col("doc_id"), folds) == held).alias("held_out"), "n_tokens", (F.col("common") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
            F.lit(tree.total).cast("long").alias("train_tokens"), base.alias("base_score"), (base + extra).alias("score"),
        ), scored

    bound_batches(docs.sparkSession)
    every = documents_of(docs)
    if packed is None:
        return scores(every)[0]
    # what is asked of the tables can be larger than the texts
    rounds, done = min(ROUNDS, 2 + lacking // HEAD), []
    for k in range(rounds):
        found, scored = scores(every.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)) == k))
        done.append(materialize(found, "scores", release=True))
        discard(scored)
    discard(packed)
    return reduce(DataFrame.unionByName, done)
