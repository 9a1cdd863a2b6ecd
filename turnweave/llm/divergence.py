"""How far sources diverge in their use of words, by Gustavson's row accumulation.

Documents are counted into (lang, source, term) once; terms of enough documents of a lang stay.
Each group (lang, source) has a smoothed profile over the kept terms of its lang.  The distance
of two groups is the sum of differences over all these terms, most of which a group never uses:
there its profile is a constant, its zero baseline.

Tasks hold ranges of terms with all postings of a term together, the term-major index.  A task
goes through its groups: a group's row scatters each of its terms, through the postings of that
term, into one dense accumulator with a cell a peer.  A cell gets what the pair differs in where
both have the term, less what the baselines say of it; what a row differs from a peer's baseline
is added to all cells at once.  So no pair of postings is ever a row of a table; what leaves a
task is one sum a pair of groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnweave.operators.ordering import dense_numbers

from .common import Words, materialize, over_texts

#: Profiles are in parts of a thousand million.
UNIT = 1_000_000_000
#: Postings that a task works on at once; more only where one term has more.
CHUNK = 1 << 20
#: Groups whose baselines are broadcast at once; with more groups, as many passes as it takes.
PEERS = 100_000

#: Each byte as it counts in a term: A-Z in lower case, other ASCII that isn't a letter a space.
BYTES = np.arange(256, dtype=np.uint8)
BYTES[:0x41] = BYTES[0x5B:0x61] = BYTES[0x7B:0x80] = 0x20
BYTES[0x41:0x5B] += 0x20


def terms_of(texts: pa.Array) -> Words:
    """The terms ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` of each text, A-Z in lower case."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    _, offsets, data = texts.buffers()
    starts = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    held = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]] if data is not None else np.zeros(0, np.uint8)
    return Words(pa.StringArray.from_buffers(len(texts), pa.py_buffer((starts - starts[0]).tobytes()), pa.py_buffer(BYTES[held].tobytes())), lower=False)


def count_terms(batch: pa.RecordBatch) -> pa.RecordBatch:
    """lang, source, term, n, docs of a batch of documents."""
    words, groups = terms_of(batch.column("text")), {}
    of = np.array([groups.setdefault(g, len(groups)) for g in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)], np.int64)
    u = max(1, len(words.uniques))
    in_docs, n = np.unique(words.owners() * u + words.codes, return_counts=True)
    keys, at = np.unique(of[in_docs // u] * u + in_docs % u, return_inverse=True)
    names = list(groups)
    columns = [
        pa.array([g[0] for g in names], pa.string()).take(pa.array(keys // u)), pa.array([g[1] for g in names], pa.string()).take(pa.array(keys // u)),
        words.uniques.cast(pa.string()).take(pa.array(keys % u)), pa.array(np.bincount(at, weights=n, minlength=len(keys)).astype(np.int64)), pa.array(np.bincount(at, minlength=len(keys))),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])


def profile(count: Column, divisor: Column, smooth: int) -> Column:
    """1 + floor(UNIT * (count + smooth) / divisor) in whole numbers; in two steps, so that counts up to 2.9e14 fit."""
    a, b = F.lit(31_250).cast("long"), F.lit(UNIT // 31_250).cast("long")
    whole = lambda x: F.call_function("div", x, divisor)
    first = (count + smooth) * a
    return 1 + whole(first) * b + whole((first % divisor) * b)


class Peers:
    """Of a block of groups, by number: langs, and baselines in that order."""

    def __init__(self, rows: pa.Table) -> None:
        self.first = rows.column("number")[0].as_py() if len(rows) else 0
        self.base = rows.column("base").to_numpy()
        langs = rows.column("lang").to_pylist()
        self.range: dict[str, tuple[int, int]] = {}  # groups are numbered by lang
        for i, lang in enumerate(langs):
            self.range[lang] = self.range.get(lang, (i, i))[0], i + 1

    def rows(self, chunk: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(groups, peers, sums) for each row of a chunk of postings sorted by lang and term, all of a term's postings in it.

        A pair's correction where both have the term goes to the row of the lower number.
        """
        langs = chunk.column("lang").combine_chunks().dictionary_encode()
        terms = chunk.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
        codes = langs.indices.to_numpy()
        group, p, base = (chunk.column(name).to_numpy() for name in ("number", "p", "base"))
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            if lang not in self.range:
                continue
            low, high = self.range[lang]
            own = np.flatnonzero(codes == code)
            begins = np.flatnonzero(np.append(True, terms[own][1:] != terms[own][:-1]))
            sizes = np.diff(np.append(begins, len(own)))
            term = np.repeat(np.arange(len(begins)), sizes)
            g, x, zero, peer_zero = group[own], p[own], base[own], self.base[low:high]
            order = np.argsort(g, kind="stable")
            heads = np.flatnonzero(np.append(True, g[order][1:] != g[order][:-1]))
            for at in np.split(order, heads[1:]):
                number, zero_g = g[at[0]], zero[at[0]]
                # this row's terms against every baseline, by sums of the sorted profile
                held = np.sort(x[at])
                sums = np.concatenate([[0], np.cumsum(held)])
                below = np.searchsorted(held, peer_zero)
                cells = (2 * below - len(held)) * peer_zero + sums[-1] - 2 * sums[below] - len(held) * np.abs(zero_g - peer_zero)
                # through the index: the postings of each of its terms
                n = sizes[term[at]]
                there = np.repeat(begins[term[at]] - np.cumsum(n) + n, n) + np.arange(n.sum())
                mine = np.repeat(x[at], n)
                peer = g[there] - self.first
                hit = (g[there] > number) & (peer >= low) & (peer < high)
                there, mine, peer = there[hit], mine[hit], peer[hit]
                both = np.abs(mine - x[there]) - np.abs(mine - zero[there]) - np.abs(zero_g - x[there]) + np.abs(zero_g - zero[there])
                np.add.at(cells, peer - low, both)
                yield np.full(len(cells), number), np.arange(low, high) + self.first, cells


def accumulator(shipped, chunk_size: int):
    """mapInArrow over postings sorted by lang and term: a, b, f for each row and peer, a < b."""

    def sums(chunk: pa.Table) -> Iterator[pa.RecordBatch]:
        for g, h, cells in shipped.value.rows(chunk):
            other = g != h
            columns = np.minimum(g, h)[other], np.maximum(g, h)[other], cells[other]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["a", "b", "f"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= chunk_size:
                table = pa.Table.from_batches(held)
                last = table.slice(n - 1)
                same = pc.and_(pc.equal(table.column("term"), last.column("term")[0]), pc.equal(table.column("lang"), last.column("lang")[0]))
                cut = pc.index(same, True).as_py()  # where the last term begins, which may go on
                if cut:
                    yield from sums(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
                    n -= cut
        if n:
            yield from sums(pa.Table.from_batches(held))

    return work


def source_divergence(docs: DataFrame, min_docs: int = 30, smooth: int = 5, top: int = 50, chunk: int = CHUNK, peers: int = PEERS) -> DataFrame:
    """lang, source, part, item, value, rank for the groups (lang, source) of docs (doc_id, source, lang, text).

    Terms in at least ``min_docs`` rows of a lang are kept there.  p of a group and a term is
    1 + floor(10^9 (count + smooth) / (N + smooth V)), with N the group's count of kept terms
    and V how many terms its lang keeps; q is that of the whole lang.  Part ``pair``: each other
    source of the lang, value the sum of abs(p - p') over all kept terms (0 without any), all
    ranks.  Part ``term``: kept terms of the group with p > q, value p - q, the first ``top``
    ranks.  Ranks are by value descending, then item bytewise.

    All numbers are whole and exact.  Null lang, source and text count as ''; '' is a group as
    any other.  Groups without terms have their pairs.  Every row is a document, also one that
    repeats another or has a null doc_id.  Texts of any length are read whole.  Further columns
    are not read.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    raw = over_texts(named, count_terms, "lang string, source string, term string, n long, docs long")
    counts = materialize(raw.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    kept = materialize(counts.groupBy("lang", "term").agg(F.sum("docs").alias("in_docs"), F.sum("n").alias("in_lang")).where(F.col("in_docs") >= min_docs).drop("in_docs"), "kept-terms")
    postings = materialize(counts.drop("docs").join(kept, ["lang", "term"]), "postings")

    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("in_lang").alias("lang_n"))
    sizes = postings.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = named.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("group_n", "lang_n", "v")))
    groups = dense_numbers(groups, ["lang", "source"]).drop("number_total")
    divisor = F.nullif(F.col("group_n") + smooth * F.col("v"), F.lit(0))
    lang_divisor = F.nullif(F.col("lang_n") + smooth * F.col("v"), F.lit(0))
    groups = materialize(groups.withColumn("base", F.coalesce(profile(F.lit(0).cast("long"), divisor, smooth), F.lit(0))), "groups")

    profiles = materialize(postings.join(groups, ["lang", "source"]).select("lang", "source", "term", "number", "base", profile(F.col("n"), divisor, smooth).alias("p"), profile(F.col("in_lang"), lang_divisor, smooth).alias("q")), "profiles")
    index = profiles.select("lang", "term", "number", "base", "p").repartition("lang", "term").sortWithinPartitions("lang", "term")
    total, parts = groups.count(), None
    for first in range(0, total, peers):
        block = groups.where(F.col("number").between(first, first + peers - 1)).select("number", "lang", "base").orderBy("number").toArrow()
        found = index.mapInArrow(accumulator(spark.sparkContext.broadcast(Peers(block)), chunk), "a long, b long, f long")
        parts = found if parts is None else parts.unionByName(found)
    if parts is None:
        return spark.createDataFrame([], "lang string, source string, part string, item string, value long, rank int")
    sums = parts.groupBy("a", "b").agg(F.sum("f").alias("f"))

    # a lang's groups have numbers in a row
    ends = groups.groupBy("lang").agg(F.min("number").alias("low"), F.max("number").alias("high"))
    listed = groups.join(ends, "lang").withColumn("other", F.explode(F.sequence("low", "high"))).where("other <> number")
    facing = groups.select(F.col("number").alias("other"), F.col("source").alias("item"), F.col("base").alias("other_base"))
    pairs = listed.join(facing, "other").withColumn("a", F.least("number", "other")).withColumn("b", F.greatest("number", "other")).join(sums, ["a", "b"], "left")
    value = F.col("v") * F.abs(F.col("base") - F.col("other_base")) + F.coalesce("f", F.lit(0))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")).withColumn("rank", F.row_number().over(by))
    over = profiles.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return pair.unionByName(over.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top))
