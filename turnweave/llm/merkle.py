"""Merkle manifest of a dataset, with witnesses that grow as leaves are appended.

Each lang is a tree of arity two over its documents in order; the trees' roots, by lang, are the
leaves of one more tree.  Leaves get their place by range partitions and offsets.  Aligned blocks
of 2 ** BITS leaves are sealed side by side: leaves are appended one after another to a frontier
of open subtrees, each subtree carries the partial witnesses of its leaves, and whenever a
sibling is complete these are extended by its root.  Block roots are appends to the next level,
whose witnesses extend those of all leaves of the block; levels go on until each tree is one
block.  No task holds more than a block, however many documents a lang has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnweave.operators.ordering import dense_numbers, running_sums

from .common import materialize

#: A block has 2 to this power of leaves.
BITS = 12
#: Of a witness, from the leaf up: the sibling, and whether it stands left; without one, a node is hashed alone.
PATH = "array<struct<left: boolean, digest: string>>"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Frontier:
    """The open subtrees of a tree that is appended to, and the witnesses of its leaves so far.

    ``open`` has (height, digest, first leaf) of each, higher ones first.  ``witness[i]`` has the
    siblings of leaf i, as (stands left, digest), up to the root of the open subtree it is in.
    """

    def __init__(self) -> None:
        self.open: list[tuple[int, str, int]] = []
        self.witness: list[list[tuple[bool | None, str | None]]] = []

    def append(self, digest: str) -> None:
        self.open.append((0, digest, len(self.witness)))
        self.witness.append([])
        while len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
            self.merge()

    def merge(self) -> None:
        """The last two subtrees become one; the leaves of each get the other's root."""
        height, right, middle = self.open.pop()
        _, left, first = self.open.pop()
        for w in self.witness[first:middle]:
            w.append((False, right))
        for w in self.witness[middle:]:
            w.append((True, left))
        self.open.append((height + 1, sha(left + right), first))

    def close(self, height: int = 0) -> str:
        """The root, of this height at least: subtrees without a sibling are hashed alone until they meet one."""
        while len(self.open) > 1 or self.open[0][0] < height:
            if len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
                self.merge()
                continue
            own, digest, first = self.open.pop()
            for w in self.witness[first:]:
                w.append((None, None))
            self.open.append((own + 1, sha(digest), first))
        return self.open[0][1]


def sealer(bits: int) -> Callable[[pa.Table], pa.Table]:
    def seal(block: pa.Table) -> pa.Table:
        block, frontier = block.sort_by("pos"), Frontier()
        for digest in block.column("digest").to_pylist():
            frontier.append(digest)
        # one block of several is as high as all others
        top = frontier.close(bits if block.column("total")[0].as_py() > 1 << bits else 0)
        kind = pa.list_(pa.struct([("left", pa.bool_()), ("digest", pa.string())]))
        sides, digests, offsets = [], [], [0]
        for w in frontier.witness:
            sides += [left for left, _ in w]
            digests += [digest for _, digest in w]
            offsets.append(len(sides))
        entries = pa.StructArray.from_arrays([pa.array(sides, pa.bool_()), pa.array(digests, pa.string())], fields=list(kind.value_type))
        path = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries)
        return block.append_column("path", path).append_column("root", pa.array([top] * len(block), pa.string()))

    return seal


def climb(nodes: DataFrame, bits: int, above: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``nodes`` with the path from each to the root of its tree, and that root.

    nodes: tree, pos (from 0 on), total (nodes of the tree), digest, and more.  ``above`` takes
    tree and digest of each whole tree and gives tree, path and root, which extend them; then
    subroot is the tree's own root.
    """
    size = 1 << bits
    placed = nodes.withColumn("block", F.shiftright("pos", bits))
    sealed = materialize(placed.groupBy("tree", "block").applyInArrow(sealer(bits), f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in placed.schema)}, path {PATH}, root string"), "sealed")
    heads = sealed.where(F.col("pos") % size == 0)
    if (sealed.agg(F.max("total")).first()[0] or 0) > size:
        upper = climb(heads.select("tree", F.col("block").alias("pos"), F.ceil(F.col("total") / size).cast("long").alias("total"), F.col("root").alias("digest")), bits, above).withColumnRenamed("pos", "block")
        keys = ["tree", "block"]
    elif above is not None:
        upper, keys = above(heads.select("tree", F.col("root").alias("digest"))).withColumn("subroot", F.lit(None).cast("string")), ["tree"]
    else:
        return sealed.drop("block").withColumn("subroot", F.col("root"))
    more = upper.select(*keys, F.col("path").alias("rest"), F.col("root").alias("whole"), F.col("subroot").alias("tree_root"))
    joined = sealed.join(more, keys)
    return joined.select(*nodes.columns, F.concat("path", "rest").alias("path"), F.col("whole").alias("root"), F.coalesce("tree_root", "root").alias("subroot"))


def forest(bits: int) -> Callable[[DataFrame], DataFrame]:
    """The tree over all trees' roots, in order of their names."""

    def above(trees: DataFrame) -> DataFrame:
        numbered = dense_numbers(trees.withColumnRenamed("tree", "name"), ["name"], "pos")
        nodes = numbered.select(F.lit("").alias("tree"), "name", "pos", F.col("pos_total").alias("total"), "digest")
        return climb(nodes, bits).select(F.col("name").alias("tree"), "path", "root")

    return above


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value told apart from its neighbours: ``-`` if null, else its length in bytes, a colon and the value."""
    shown = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown))


def leaf_of(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return digest(*map(field, (doc_id, source, lang, n_chars, text)))


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its witness."""
    up = lambda at, s: F.when(s["left"], F.concat(s["digest"], at)).otherwise(F.concat(at, F.coalesce(s["digest"], F.lit(""))))
    return F.aggregate(path, leaf, lambda at, s: F.sha2(up(at, s), 256))


def proof(path: Column) -> Column:
    """Digest of a witness: its siblings from the leaf up."""
    return F.sha2(F.array_join(F.transform(path, lambda s: s["digest"]), ""), 256)


def merkle_manifest(docs: DataFrame, claim: Column | None = None, bits: int = BITS) -> DataFrame:
    """doc_id, lang, pos, leaf, claim, path, subroot, root of each document of docs (doc_id, source, lang, n_chars, text).

    leaf is the digest of the row, path its witness (see ``PATH``) through the tree of its lang,
    with root subroot, to the root of all.  ``claim`` is a digest computed from the row that is
    carried along, the leaf itself by default; ``fold(claim, path)`` is the root if the claim is
    the leaf.

    Trees are in order of lang, null first, then bytewise; leaves by doc_id, null first; rows of
    one doc_id by their digest.  So any order of the input gives the same manifest.  Rows that
    repeat each other in full are a leaf each.  Nulls in any column are values of their own
    (``-``), and texts of any length and empty ones are hashed whole.  Further columns are not
    read.  An empty table gives no rows.
    """
    leaf = leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.col("text"))
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))  # sorts as lang does, null first
    leaves = docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("digest"), (leaf if claim is None else claim).alias("claim"))
    placed = running_sums(leaves, ["doc_id", "digest"], {"pos": F.lit(1).cast("long")}, by=("tree",))
    nodes = placed.withColumn("pos", F.col("pos") - 1).withColumnRenamed("pos_total", "total")
    found = climb(nodes, bits, forest(bits))
    lang = F.when(F.col("tree") != "", F.substring("tree", 2, 2**31 - 1))
    return found.select("doc_id", lang.alias("lang"), "pos", F.col("digest").alias("leaf"), "claim", "path", "subroot", "root")


def tampered_leaf(every: int = 7) -> Column:
    """The leaf of a row; where ``every`` divides crc32 of the decimal doc_id (a null one: never), that of the row with one more in n_chars."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0, F.lit(False))
    more = F.col("n_chars").cast("decimal(20,0)") + F.when(hit, 1).otherwise(0)
    return leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), more, F.col("text"))


def audit(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: the manifest, checked against a copy of the rows with some tampered (``tampered_leaf``)."""
    found = merkle_manifest(docs, tampered_leaf(), bits).withColumn("folded_root", fold(F.col("claim"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
