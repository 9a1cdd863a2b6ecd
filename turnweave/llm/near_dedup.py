"""Near-duplicate documents by SetSketch.

A sketch has 256 registers.  Each shingle draws ascending exponential values for registers in an
order of its own; a register keeps the smallest, as the whole number 1 - log_b of it, cut off to
one byte.  Sketches merge by maximum, and two registers agree with a chance of about the Jaccard
similarity, so bands of registers find candidates.  Candidates are first judged by the
likelihood of how many registers are larger, smaller and equal, with the exact set sizes, and
then confirmed on the full sets.

Documents with equal sets are one class, and only classes are compared.  In a bucket of equal
bands every class is compared with one pivot, the class that shares most buckets with others,
not with every other.  Buckets that still hold several components go through an exact filter:
let D(x) be the elements that x and the pivot don't share.  Then x and y differ in
|D(x)| + |D(y)| - 2 |D(x) & D(y)| elements, and if x has no link to the pivot, a link from x to
y needs common elements in D, so many that one is among the first few of D(x) and of D(y) in a
common order, the rarest elements of the pivot's group first.  Only classes that share such an
element are compared, so copies that differ from each other by elements of their own are never
paired, those of a family by what it shares only where that is most of what they differ in, and
no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, discard, documents_of, filter_of, materialize, may_hold, mix, over_texts, pieces, quoted, same, shingles
from .components import connected_components

#: Registers of a sketch, base of their scale, rate of the exponentials.
REGISTERS, BASE, RATE = 256, 1.1, 20.0
#: Registers in a band, and bands.
ROWS, BANDS = 6, 42
LOG_BASE = np.log(BASE)
#: The table of how many differences have an element has 2 to this power of bytes.
CROWD_BITS = 24
#: Bytes of text that a task sketches at once.
BATCH = 4 << 20


def sketch(elements: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    """Registers (n x 256, one byte) of the sets of ``elements`` by owner."""
    m = np.uint64(REGISTERS - 1)
    registers, low = np.zeros((n, REGISTERS), np.uint8), np.zeros(n, np.uint8)
    first, step = mix(elements ^ np.uint64(0x51)) & m, mix(elements ^ np.uint64(0x52)) | np.uint64(1)
    value, flat = np.zeros(len(elements)), registers.reshape(-1)
    for j in range(REGISTERS):
        if not len(elements):
            break
        draw = (mix(elements + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(11)).astype(float) + 0.5
        value = value - np.log(draw / (1 << 53)) / (RATE * (REGISTERS - j))
        level = np.floor(1 - np.log(value) / LOG_BASE)
        alive = level > low[owners]
        elements, owners, value, first, step = elements[alive], owners[alive], value[alive], first[alive], step[alive]
        at = owners * REGISTERS + ((first + np.uint64(j) * step) & m).astype(np.int64)
        np.maximum.at(flat, at, np.minimum(level[alive], 255).astype(np.uint8))
        used = np.unique(owners)
        low[used] = registers[used].min(axis=1)
    return registers


def estimate(larger: np.ndarray, smaller: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of sets of sizes a and b, whose registers are larger and smaller so often."""
    u, v = a / (a + b), b / (a + b)
    equal = REGISTERS - larger - smaller
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / LOG_BASE

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = p(u - v * j), p(v - u * j)
        tiny = 1e-300
        return larger * np.log(up + tiny) + smaller * np.log(down + tiny) + equal * np.log(np.maximum(1 - up - down, tiny))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):
        one, two = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        better = likelihood(one) < likelihood(two)
        lo, hi = np.where(better, one, lo), np.where(better, hi, two)
    return (lo + hi) / 2


def describe(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, set1 and set2 (a hash of the set), registers for each row; no registers for an empty set."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        every, starts = shingles(Words(batch.column("text")), size)
        n = batch.num_rows
        sets = [np.unique(every[starts[i] : starts[i + 1]]) for i in range(n)]
        sizes = np.array([len(s) for s in sets])
        flat = np.concatenate(sets) if n else every
        owners = np.repeat(np.arange(n), sizes)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        hashes = []
        for seed in (0x11, 0x22):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat ^ np.uint64(seed)), dtype=np.uint64)])
            hashes.append(pa.array((sums[ends[1:]] - sums[ends[:-1]]).view(np.int64)))
        registers = sketch(flat, owners, n)
        shown = pa.array([r.tobytes() if k else None for r, k in zip(registers, sizes, strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes), *hashes, shown], names=["doc_id", "text_hash", "n_shingles", "set1", "set2", "registers"])

    rows = documents_of(docs).withColumn("text_hash", F.xxhash64("text"))
    return over_texts(rows, work, "doc_id long, text_hash long, n_shingles long, set1 long, set2 long, registers binary", BATCH)


def bands(classes: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
    """class, band: the 64-bit key of each band of its registers; with ``wanted``, only those that may be in this filter."""
    shipped = classes.sparkSession.sparkContext.broadcast(wanted)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4 << 20, "registers"):
            n = batch.num_rows
            registers = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint8).reshape(n, REGISTERS)
            key = np.zeros((n, BANDS), np.uint64)
            for k in range(ROWS):
                key = key << np.uint64(8) | registers[:, k : ROWS * BANDS : ROWS].astype(np.uint64)
            key = mix(key * np.uint64(64) + np.arange(BANDS, dtype=np.uint64)).ravel()
            owner = np.repeat(np.asarray(batch.column("class")), BANDS)
            kept = slice(None) if shipped.value is None else may_hold(shipped.value, key)
            yield pa.RecordBatch.from_arrays([pa.array(owner[kept]), pa.array(key[kept].view(np.int64))], names=["class", "band"])

    return classes.select("class", "registers").mapInArrow(work, "class long, band long")


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that may reach the similarity: by their sizes for certain, by the sketches within five deviations."""
    # the deviation of the share of equal registers is at most that of a binomial
    least = percent / 100 - 5 * np.sqrt(percent / 100 * (1 - percent / 100) / REGISTERS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4 << 20, "ra"):
            ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in ("ra", "rb"))
            na, nb = np.asarray(batch.column("na")).astype(float), np.asarray(batch.column("nb")).astype(float)
            kept = estimate((ra > rb).sum(1), (ra < rb).sum(1), na, nb) >= least
            yield batch.filter(pa.array(kept)).select(["a", "b"])

    side = lambda x: classes.select(F.col("class").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("registers").alias(f"r{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return joined.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(work, "a long, b long")


def sets_of(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted set of shingles of each text; equal texts are read once."""
    coded = texts.dictionary_encode()
    every, starts = shingles(Words(coded.dictionary), size)
    own = [np.unique(every[a:b]) for a, b in zip(starts, starts[1:], strict=False)]
    return [own[i] for i in coded.indices.to_pylist()]


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b, ...) with the texts of both, ta and text; texts: class, text."""
    with_a = pairs.join(texts.select(F.col("class").alias("a"), F.col("text").alias("ta")), "a")
    return with_a.join(texts.select(F.col("class").alias("b"), "text"), "b")


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets reach the similarity."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4 << 20):
            sets = [sets_of(batch.column(c), size) for c in ("ta", "text")]
            both = np.array([len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(*sets, strict=True)])
            total = np.array([len(a) + len(b) for a, b in zip(*sets, strict=True)])
            yield batch.filter(pa.array(100 * both >= percent * (total - both))).select(["a", "b"])

    return with_texts(pairs, texts).select("a", "b", "ta", "text").mapInArrow(work, "a long, b long")


def texts_of(pairs: DataFrame, classes: DataFrame, docs: DataFrame, tag: str) -> DataFrame:
    """class, text of the classes in pairs (a, b).  A filter of fixed size holds most other texts back from the shuffle."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(classes.select("class", "doc_id", "text_hash"), "class")
    named = materialize(named, f"named-{tag}")
    shipped = docs.sparkSession.sparkContext.broadcast(filter_of(named.select(F.col("text_hash").alias("key"))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_hold(shipped.value, batch.column("text_hash").to_numpy().view(np.uint64))))

    rows = documents_of(docs).withColumn("text_hash", F.xxhash64("text")).mapInArrow(work, "doc_id long, text string, text_hash long")
    found = rows.join(named.hint("merge"), ["doc_id", "text_hash"])
    # rows that repeat a document in full: any one of them
    return materialize(found.groupBy("doc_id", "text_hash", "class").agg(F.first("text").alias("text")).select("class", "text"), f"texts-{tag}")


def unshared(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """D(b) against pivot a, a row a class: pivot, class, part, outside, m (elements of the pivot), n (of the class), d (of D), elements (as bytes)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4 << 20):
            pivots, own = (sets_of(batch.column(c), size) for c in ("ta", "text"))
            each = [np.setxor1d(a, b, True) for a, b in zip(pivots, own, strict=True)]
            sizes = (pa.array([len(x) for x in sets], pa.int64()) for sets in (pivots, own, each))
            held = pa.array([x.tobytes() for x in each], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.select(["a", "b", "part", "outside"]).columns, *sizes, held], names=["pivot", "class", "part", "outside", "m", "n", "d", "elements"])

    schema = "pivot long, class long, part struct<doc_id: long, class: long>, outside boolean, m long, n long, d long, elements binary"
    return with_texts(pairs, texts).select("a", "b", "part", "outside", "ta", "text").mapInArrow(work, schema)


def elements_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(elements, row of each, place of each and its pivot in the table of :func:`crowds`) of a batch of :func:`unshared`."""
    row = np.repeat(np.arange(batch.num_rows), batch.column("d").to_numpy())
    elements = np.frombuffer(b"".join(batch.column("elements").to_pylist()), np.uint64)
    return elements, row, (mix(mix(batch.column("pivot").to_numpy().view(np.uint64))[row] ^ elements) >> np.uint64(64 - CROWD_BITS)).astype(np.int64)


def crowds(seen: DataFrame) -> np.ndarray:
    """A byte for each place (2 ** CROWD_BITS at most): 1 + 8 log2 of how many elements of all D have it; 1 says that an element is in no other D of its pivot."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4 << 20, "elements"):
            place, c = np.unique(elements_of(batch)[2], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(c)], names=["place", "c"])

    counts = seen.select("pivot", "d", "elements").mapInArrow(work, "place long, c long").groupBy("place").agg(F.sum("c").alias("c"))
    level = F.least(F.lit(255), F.floor(8 * F.log2("c")) + 1).cast("long")
    words = counts.withColumn("level", level).groupBy(F.shiftright("place", 3).alias("word")).agg(F.bit_or(F.expr("shiftleft(level, cast(8 * (place & 7) as int))")).alias("levels")).toArrow()
    out = np.zeros(1 << (CROWD_BITS - 3), np.int64)
    out[np.asarray(words["word"])] = np.asarray(words["levels"])
    return out.view(np.uint8)


def differences(seen: DataFrame, percent: int) -> DataFrame:
    """The first elements of each D, of those that others may have too, a row an element: pivot, class, part, n, d, excess, element, place, seeks, met.

    With q = 100 + percent and r = 100 - percent, x and y are linked if and only if
    q (d(x) + d(y) - 2 common) <= r (n(x) + n(y)), that is, if D(x) and D(y) have
    (excess(x) + excess(y)) / 2q common elements or more, where excess = q d - r n.  Of two
    linked classes the one of larger excess (at least r m, as it has no link to the pivot)
    seeks, the other is met; ``seeks`` and ``met`` tell how far each must show its elements,
    given that their sizes differ by no more than the similarity allows.  Any common order is
    right.  This one is by how many of the pivot's classes have an element in D, the rarest
    first, so those of a class alone, which meet no other, take the first places, and what a
    family of classes shares comes behind them.  The counts come from a table of fixed size, so
    only what is shown is ever a row of its own; elements that share a place there are taken
    for more frequent than they are, which changes the order and loses nothing.
    """
    q, r = 100 + percent, 100 - percent
    shipped = seen.sparkSession.sparkContext.broadcast(crowds(seen))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4 << 20, "elements"):
            elements, row, at = elements_of(batch)
            level = shipped.value[at]
            m, n, d = (batch.column(c).to_numpy() for c in ("m", "n", "d"))
            excess, edge, widest = q * d - r * n, r * m, r * n * 100 // percent  # r times the largest set that may be linked
            met = np.minimum(d, (2 * q * d - excess - np.maximum(excess, edge)) // (2 * q) + 1)
            seeks = np.where(excess > edge, np.minimum(d, np.minimum(q * d + r * n + widest, 2 * (r * n + widest)) // (2 * q) + 1), 0)
            order = np.lexsort((elements, level, row))
            elements, level, row = elements[order], level[order], row[order]
            place = np.arange(len(row)) - (np.cumsum(d) - d)[row]
            kept = (level > 1) & (place < np.maximum(seeks, met)[row])
            elements, row, place = elements[kept], row[kept], place[kept]
            named = batch.select(["pivot", "class", "part", "n", "d"]).take(pa.array(row)).columns
            columns = [excess[row], elements.view(np.int64), place, place < seeks[row], place < met[row]]
            yield pa.RecordBatch.from_arrays([*named, *map(pa.array, columns)], names=["pivot", "class", "part", "n", "d", "excess", "element", "place", "seeks", "met"])

    schema = "pivot long, class long, part struct<doc_id: long, class: long>, n long, d long, excess long, element long, place long, seeks boolean, met boolean"
    return seen.select("pivot", "class", "part", "m", "n", "d", "elements").mapInArrow(work, schema)


def across(seen: DataFrame, shown: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) between components, from :func:`unshared` and :func:`differences`."""
    x, y = shown.where("seeks").alias("x"), shown.where("met").alias("y")
    common = (F.col("x.excess") + F.col("y.excess")) / (2 * (100 + percent))
    fits = (
        (F.col("x.part") != F.col("y.part"))
        & (F.col("x.excess") >= F.col("y.excess"))
        & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))
        & (F.col("x.d") - F.col("x.place") >= common)
        & (F.col("y.d") - F.col("y.place") >= common)
    )
    met = x.join(y, (F.col("x.pivot") == F.col("y.pivot")) & (F.col("x.element") == F.col("y.element")) & fits).select("x.class", F.col("y.class").alias("other"))
    near = (100 + percent) * F.col("d") - (100 - percent) * F.col("n") <= (100 - percent) * F.col("m")  # linked to the pivot
    linked = seen.where(F.col("outside") & near).select("class", F.col("pivot").alias("other"))
    return met.union(linked).select(F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b")).distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept for every row of documents.

    Links join documents whose sets of ``size``-word shingles have 100 * intersection >=
    ``percent`` * union; a component's id is its smallest doc_id, and that document is kept.
    Null, empty or blank text: an empty set, linked with nothing, kept.  Rows repeated in full
    share their fate; rows with one doc_id and other texts are judged each by its own text.  A
    null doc_id takes no part: component null, kept.  An empty table gives one with no rows.
    """
    rows = materialize(describe(docs, size), "sets")
    full = rows.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    grouped = full.groupBy("set1", "set2", "n_shingles").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.min("registers").alias("registers"))
    # a class is named by a hash of its set: two texts under one doc_id stay two classes
    name = F.xxhash64("set1", "set2", "n_shingles")
    classes = materialize(grouped.select(name.alias("class"), "set1", "set2", "n_shingles", "first.doc_id", "first.text_hash", "registers"), "classes")
    counted = materialize(bands(classes).groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "counted")
    shared = bands(classes, filter_of(counted.select(F.col("band").alias("key"))))
    buckets = materialize(shared.join(counted, "band"), "buckets")
    # the class that shares most buckets with others is the likeliest to be linked to them
    central = materialize(buckets.groupBy("class").agg(F.sum("n").alias("shared")), "central")
    pivots = materialize(buckets.join(central, "class").groupBy("band").agg(F.max(F.struct("shared", "class"))["class"].alias("p")), "pivots")
    star = materialize(buckets.join(pivots, "band").where("p <> class").select("p", "class").distinct(), "star")
    discard(buckets, counted, central, pivots)
    pairs = materialize(likely(star.select(F.least("p", "class").alias("a"), F.greatest("p", "class").alias("b")).distinct(), classes, percent), "likely")
    texts = texts_of(pairs, classes, docs, "first")
    links = materialize(confirmed(pairs, texts, size, percent), "links")
    discard(pairs, texts)
    # nodes are ordered by document, so a component is named by its smallest one
    node = classes.select("class", F.struct("doc_id", "class").alias("node"))
    parts = components_of(links, node)
    whole = materialize(node.join(parts, "node", "left").select("class", F.coalesce("component", "node").alias("part")), "parts")
    # components whose buckets hold classes of others too: each has one class of its own, with most links, as its pivot
    member = star.join(whole, "class").join(whole.select(F.col("class").alias("p"), F.col("part").alias("main")), "p")
    member = materialize(member.select("main", "p", "class", "part", (F.col("part") != F.col("main")).alias("outside")), "members")
    mixed = materialize(member.groupBy("p").agg(F.max("outside").alias("some")).where("some").select("p"), "mixed")
    inside = member.join(mixed, "p").select("main", "class", "part").union(member.join(mixed, "p").select("main", F.col("p").alias("class"), F.col("main").alias("part"))).distinct()
    degree = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("degree"))
    central = inside.where("part = main").join(degree, "class", "left").groupBy("main").agg(F.max(F.struct(F.coalesce("degree", F.lit(0)), "class"))["class"].alias("a"))
    group = materialize(inside.join(central, "main").where("class <> a").select("a", F.col("class").alias("b"), "part", (F.col("part") != F.col("main")).alias("outside")), "groups")
    texts = texts_of(group, classes, docs, "groups")
    seen = materialize(unshared(group, texts, size), "unshared")
    shown = materialize(differences(seen, percent), "differences")
    pairs = materialize(across(seen, shown, percent), "across")
    discard(seen, shown)
    more = materialize(confirmed(pairs, texts, size, percent), "more-links")
    parts = components_of(links.union(more), node)
    named = materialize(classes.join(node, "class").join(parts, "node", "left").select("set1", "set2", F.coalesce("component.doc_id", "doc_id").alias("component_id")), "named")
    discard(texts, star, whole)
    found = rows.drop("registers").join(named, ["set1", "set2"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return found.select("doc_id", "text_hash", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def components_of(links: DataFrame, node: DataFrame) -> DataFrame:
    """``connected_components`` of links between classes, by the nodes of ``node`` (class, node)."""
    side = lambda x: node.select(F.col("class").alias(x), F.col("node").alias(f"n{x}"))
    return connected_components(links.join(side("a"), "a").join(side("b"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b")))


def keep_representatives(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of documents, all columns, whose document stands for its group.

    Which rows those are is said by :func:`near_duplicates`: rows with null, empty or blank
    text and rows with a null doc_id stay, rows that repeat a kept document in full stay too.
    Extra columns are carried, whatever their names.  An empty table stays empty.
    """
    lost = near_duplicates(docs, size, percent).where(~F.col("kept")).select("doc_id", "text_hash").distinct()
    key = lambda of: (F.col(f"{of}.doc_id"), F.col(f"{of}.text_hash"))
    # the rows as one column, so no name of theirs meets ours
    held = docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"))
    text_hash = F.xxhash64(F.coalesce(F.col("row.text"), F.lit("")))
    held = held.withColumn("doc_id", F.col("row.doc_id").cast("long")).withColumn("text_hash", text_hash).alias("held")
    (a, b), (c, d) = key("held"), key("lost")
    return held.join(lost.alias("lost"), same(a, c) & (b == d), "left_anti").select("row.*")
