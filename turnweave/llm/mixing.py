"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a seeded order, served as often as ``repeats``
allows.  A document's virtual finish time is the words of its source up to its end, divided by
the source's target; all sources together are range-sorted by it and cut off at the total
budget.  At any point of the mix each source has had its share, but for less than a document.
Running sums are those of range partitions with offsets, so that neither a source nor the mix
has to fit one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnweave.functions.seeding import uniform
from turnweave.operators.ordering import running_sums

from .common import materialize


def words_in(text: Column) -> Column:
    """How many words ``[^\\x20\\x09-\\x0D]+`` there are; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, repeats: int = 2) -> DataFrame:
    """source, rank, source_size, target for sizes (source, source_size), one row a source.

    Sources by code point, null last, take the weights in turn.  They share ``percent`` % of all
    sizes by weight; none gets more than ``repeats`` times its size, and the excess is shared by
    weight among the others until none is above.  That is the level at which sources, by size
    over weight, stop being full: all before it get their limit, and the others what is left.
    Sizes and weights are whole numbers, so sums are exact.
    """
    ranked = running_sums(sizes.withColumn("last", F.col("source").isNull()), ["last", "source"], {"rank": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*map(F.lit, weights)), (((F.col("rank") - 1) % len(weights)) + 1).cast("int")).cast("long")
    ranked = ranked.select("source", "rank", "source_size", weight.alias("weight"))
    big = lambda c: c.cast("decimal(38,0)")
    summed = running_sums(ranked.withColumn("full_at", F.col("source_size") / F.col("weight")), ["full_at", "rank"], {"words": F.col("source_size"), "shares": F.col("weight")})
    # what this source and all after it share if all before it are full, in hundredths of words
    left = big(F.col("words_total")) * percent - big(F.col("words") - F.col("source_size")) * (100 * repeats)
    rest = F.col("shares_total") - F.col("shares") + F.col("weight")
    full = big(F.col("source_size")) * (100 * repeats) * rest <= left * F.col("weight")
    levels = summed.withColumn("left", left).withColumn("rest", rest).withColumn("full", full)
    level = levels.where(~F.col("full")).agg(F.min_by(F.struct("left", "rest"), F.struct("full_at", "rank")).alias("level"))
    share = F.col("weight") * F.col("level.left").cast("double") / (F.col("level.rest") * F.lit(100.0))
    limit = (F.col("source_size") * repeats).cast("double")
    return ranked.crossJoin(F.broadcast(level)).select("source", "rank", "source_size", F.coalesce(F.least(limit, share), limit).alias("target"))  # one row


def mixing_order(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, repeats: int = 2, seed: int = 42) -> tuple[DataFrame, DataFrame, int]:
    """(queues, mix, budget).

    queues: doc_id, source, size, u, rank, source_size, target, upto of every row, upto being
    the words of its source up to its end.  mix: doc_id, source, rank, copy, upto, size, finish
    and at of every copy that may be taken, at being the words of the mix up to its end; the mix
    is the copies with at within the budget, in the order of (finish, rank, copy, upto).
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words_in(F.col("text")).alias("size"))
    rows = materialize(own.withColumn("u", uniform(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), "sizes")
    shares = materialize(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, percent, repeats), "targets")
    queues = materialize(running_sums(rows, ["u", "doc_id", "size"], {"upto": F.col("size")}, by=("source",), with_groups=shares).drop("upto_total"), "queues")
    copies = queues.where("target > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    finish = (F.col("copy") * F.col("source_size") + F.col("upto")).cast("double") / F.col("target")
    copies = copies.select("doc_id", "source", "rank", "copy", "upto", "size", finish.alias("finish"))
    mix = running_sums(copies, ["finish", "rank", "copy", "upto"], {"at": F.col("size")}).drop("at_total")
    whole = shares.agg(F.sum("source_size")).first()[0] or 0
    return queues, mix, whole * percent // 100


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, repeats: int = 2, seed: int = 42) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for each row of docs (doc_id, source, text).

    size is the words of the text, taken those that the mix takes of it, with repeats: whole
    documents, each at most ``repeats`` times.  See ``targets`` for target.  The mix is the
    longest head of the common order that stays within ``percent`` % of all words; a source is
    off its target by less than a document and its share of what such remainders add up to.

    The order follows from the seed, doc_id and size alone, so reruns agree however the rows
    are dealt out.  Null and empty texts have size 0 and are never taken; a null source is one of
    its own, the last; null doc_ids are rows as any other; rows that repeat each other in full
    are documents of their own, and the first of equal ones are taken first.  Further columns
    are not read.  An empty table gives no rows; without any words all targets are 0.
    """
    queues, mix, budget = mixing_order(docs, weights, percent, repeats, seed)
    place = ("finish", "rank", "copy", "upto")
    last = mix.where(F.col("at") <= budget).agg(F.max(F.struct(*place)).alias("last"))
    finish = lambda copy: (F.lit(copy) * F.col("source_size") + F.col("upto")).cast("double") / F.col("target")
    within = lambda copy: F.struct(finish(copy).alias("finish"), F.col("rank"), F.lit(copy).alias("copy"), F.col("upto")) <= F.col("last")
    times = sum((F.when((F.col("target") > 0) & within(k), 1).otherwise(0) for k in range(repeats)), F.lit(0))
    ended = queues.crossJoin(F.broadcast(last))  # one row
    return ended.select("doc_id", "source", "size", "source_size", "target", (times * F.col("size")).cast("long").alias("taken"))
