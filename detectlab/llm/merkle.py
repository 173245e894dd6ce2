"""Merkle manifest of a table: one root over all rows, a proof for each row, and folding of proofs.

H is the SHA-256 of concatenated inputs in lowercase hexadecimal; digests are concatenated as that text. A leaf is H of the row's
columns, each ``-`` if null, else its number of UTF-8 bytes, ``:`` and the value. The leaves of a source ascend by id; while more
than one node is left, every ``arity`` nodes in a row become their H, also a last run of fewer or of one. What is left is the
subroot. Subroots in the order of their sources make the root in the same way.

A level is a self-join: the slot-zero row of each run computes the indices of its run (its own plus each slot offset; for
runs of two that is the XOR with one), an equijoin on (tree, index) brings their nodes, and the slot-zero row emits the parent and
the run's digests. It asks once for the whole run, so a level shuffles each node once and not once for each of its siblings.
Levels shrink by the arity and are written; texts stay behind at the leaves, of which only digests move. Positions within a source
come from range slices, so a source with a third of all rows is cut into many.

A proof is the list of (digests to the left, digests to the right) of each level, and is put together from the root downwards: the
upper part of it is made once for each run.

Nulls, ties, empties: a null id comes first in its source and a null source before all others; rows that repeat an id are ordered
by their leaf, so equal rows get the positions in any order and the tree stays the same; an empty table gives an empty one; a tree
of one node has no levels, an empty proof and its leaf as the root. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from detectlab.llm.common import crc_remainder, materialise
from detectlab.operators.rates import null_safe_join, number_in_group

ARITY = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tampered rows of the report: one in so many by the crc32 of the id.
TAMPER_MODULUS = 5
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PATH = "array<struct<l:string,r:string>>"


def leaf_digest(columns: Sequence[Column]) -> Column:
    """H of the values, each with its length."""
    def part(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(part, columns)), 256)


def _levels(most: int, arity: int) -> int:
    """Levels above the leaves of a tree with so many of them."""
    n = 0
    while most > 1:
        most, n = -(-most // arity), n + 1
    return n


def runs_of(nodes: DataFrame, arity: int) -> DataFrame:
    """(tree, n, idx, node) -> (tree, n, run, nodes) of all trees with more than one node.

    ``n`` is the number of nodes of the tree, ``node`` a struct that begins with the digest. The nodes of a run stand in order.
    """
    open_trees = nodes.where("n > 1")
    heads = open_trees.where(F.col("idx") % arity == 0).select(
        "tree", F.col("idx").alias("head"), F.explode(F.sequence("idx", F.least(F.col("idx") + (arity - 1), F.col("n") - 1))).alias("idx")
    )
    met = heads.join(open_trees, ["tree", "idx"])
    slots = F.sort_array(F.collect_list(F.struct((F.col("idx") - F.col("head")).alias("slot"), "node")))
    grouped = met.groupBy("tree", "n", "head").agg(slots.alias("slots"))
    return grouped.select("tree", "n", (F.col("head") / arity).cast("long").alias("run"), F.col("slots.node").alias("nodes"))


def parents_of(runs: DataFrame, arity: int) -> DataFrame:
    """The nodes of the next level."""
    digest = F.sha2(F.array_join("nodes.digest", ""), 256)
    return runs.select("tree", F.ceil(F.col("n") / arity).cast("long").alias("n"), F.col("run").alias("idx"), F.struct(digest.alias("digest")).alias("node"))


def grow(nodes: DataFrame, most: int, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """The runs of every level, lowest first, and the last node (tree, digest) of each tree. ``most``: nodes of the largest tree."""
    levels, tops = [], nodes.where("n = 1").select("tree", "node.digest")
    for _ in range(_levels(most, arity)):
        runs = materialise(runs_of(nodes, arity), "runs")
        levels.append(runs)
        nodes = parents_of(runs, arity)
        tops = tops.union(nodes.where("n = 1").select("tree", "node.digest"))
    return levels, tops


def _beside(slot: Column) -> Column:
    """The digests of a run's other nodes, to the left and to the right of a slot."""
    digests = F.col("nodes.digest")
    left = F.array_join(F.slice(digests, F.lit(1), slot), "")
    right = F.array_join(F.slice(digests, slot + 2, F.size("nodes")), "")
    return F.struct(left.alias("l"), right.alias("r"))


def paths_down(levels: list[DataFrame], above: DataFrame, arity: int) -> DataFrame:
    """(tree, run, upper, ...) for the lowest level: its runs with the path of the node that each makes.

    ``above``: (tree, path) of the last node of each tree.
    """
    known = above.select("tree", F.lit(0).cast("long").alias("idx"), "path")
    for level in reversed(levels[1:]):
        # Trees of fewer levels begin further down.
        upper = _with_upper(level, known)
        slots = upper.select("tree", "nodes", "run", "upper", F.explode(F.sequence(F.lit(0), F.size("nodes") - 1)).alias("slot"))
        path = F.concat(F.array(_beside(F.col("slot"))), F.col("upper")).cast(_PATH)
        nodes = slots.select("tree", (F.col("run") * arity + F.col("slot")).cast("long").alias("idx"), path.alias("path"))
        roots = above.join(level.select("tree").distinct(), "tree", "left_anti").select("tree", F.lit(0).cast("long").alias("idx"), "path")
        known = materialise(nodes.union(roots), "paths")
    return _with_upper(levels[0], known)


def _with_upper(level: DataFrame, known: DataFrame) -> DataFrame:
    return level.join(known.select("tree", F.col("idx").alias("run"), F.col("path").alias("upper")), ["tree", "run"])


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path give."""
    return F.aggregate(path, leaf, lambda digest, p: F.sha2(F.concat(p["l"], digest, p["r"]), 256))


def siblings_digest(path: Column) -> Column:
    """H of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["l"], p["r"])), ""), 256)


def manifest(docs: DataFrame, others: DataFrame | None = None, columns: Sequence[str] = COLUMNS, id_col: str = "doc_id",
             source_col: str = "source", arity: int = ARITY, altered: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, leaf, other, subroot, root, path) for every row.

    ``other`` is the leaf of the row as it is found later: with the columns in ``altered`` in place of its own; null without one.
    """
    if arity < 2:
        raise ValueError("a run has two nodes at least")
    changed = leaf_digest([(altered or {}).get(c, F.col(c)) for c in columns]) if altered else F.lit(None).cast("string")
    leaves = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), leaf_digest([F.col(c) for c in columns]).alias("leaf"),
                         changed.alias("other"))
    # Equal rows are equal leaves: which of them comes first changes nothing.
    placed = number_in_group(leaves, ["source"], ["doc_id", "leaf"], "at")
    sizes = materialise(placed.groupBy("source").agg(F.count("*").alias("n")), "sources")
    sources = materialise(number_in_group(sizes, [], ["source"], "tree"), "trees").withColumn("tree", F.col("tree").cast("long") - 1)
    most, trees = sources.agg(F.max("n"), F.count("*")).first()
    at = null_safe_join(placed, sources.select("source", "n", "tree"), ["source"])
    node = F.struct(F.col("leaf").alias("digest"), "doc_id", "other")
    nodes = materialise(at.select("tree", F.col("n").cast("long").alias("n"), (F.col("at") - 1).cast("long").alias("idx"), node.alias("node")), "leaves")
    levels, tops = grow(nodes, most or 0, arity)
    tops = materialise(tops, "subroots")

    # The tree over the subroots, whose paths begin the paths of all others.
    upper_nodes = tops.select(F.lit(0).cast("long").alias("tree"), F.lit(trees).cast("long").alias("n"), F.col("tree").alias("idx"),
                              F.struct("digest").alias("node"))
    upper_levels, last = grow(upper_nodes, trees, arity)
    root = last.agg(F.max("digest")).first()[0]
    empty = F.array().cast(_PATH)
    if upper_levels:
        # One tree, with nothing above it.
        runs = paths_down(upper_levels, docs.sparkSession.range(1).select(F.col("id").alias("tree"), empty.alias("path")), arity)
        slots = runs.select("nodes", "run", "upper", F.explode(F.sequence(F.lit(0), F.size("nodes") - 1)).alias("slot"))
        path = F.concat(F.array(_beside(F.col("slot"))), F.col("upper")).cast(_PATH)
        above = slots.select((F.col("run") * arity + F.col("slot")).cast("long").alias("tree"), path.alias("path"))
    else:
        above = tops.select("tree", empty.alias("path"))
    above = materialise(above.join(tops, "tree").select("tree", "path", F.col("digest").alias("subroot"), F.lit(root).alias("root")), "above")

    alone = nodes.where("n = 1").join(above, "tree").select("node.doc_id", F.col("node.digest").alias("leaf"), "node.other", "subroot", "root", "path")
    if not levels:
        return alone
    runs = paths_down(levels, above.select("tree", "path"), arity).join(above.select("tree", "subroot", "root"), "tree")
    rows = runs.select("nodes", "upper", "subroot", "root", F.posexplode("nodes").alias("slot", "node"))
    path = F.concat(F.array(_beside(F.col("slot"))), F.col("upper")).cast(_PATH)
    several = rows.select("node.doc_id", F.col("node.digest").alias("leaf"), "node.other", "subroot", "root", path.alias("path"))
    return several.union(alone)


def verification(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", arity: int = ARITY) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): the manifest, and a check of tampered rows against it.

    Rows whose id's crc32 is divisible by ``TAMPER_MODULUS`` come with the letters A-Z of their text in lower case; a null id's
    do not. Their proof is that of the original row.
    """
    text = F.col(text_col)
    tampered = F.when(crc_remainder(F.col(id_col), TAMPER_MODULUS) == 0, F.translate(text, _UPPER, _UPPER.lower())).otherwise(text)
    columns = [id_col, source_col, *[c for c in COLUMNS if c not in ("doc_id", "source", "text")], text_col]
    rows = manifest(docs, columns=columns, id_col=id_col, source_col=source_col, arity=arity, altered={text_col: tampered})
    found = rows.select("doc_id", "leaf", "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"),
                        folded(F.col("other"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


__all__ = ["ARITY", "folded", "grow", "leaf_digest", "manifest", "parents_of", "paths_down", "runs_of", "siblings_digest", "verification"]
