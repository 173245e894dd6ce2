"""Near copies by the Jaccard similarity of word shingles: SimHash balls and MinHash bands find candidates, shingle sets verify them.

Words are those of ``simhash``; a shingle is five words in a row (all words of a shorter text). Texts with equal shingle sets
collapse first. The others have a SimHash fingerprint of their shingles and meet in the balls of ``simhash.near_links``, so those of one
fingerprint or within two bits are candidates. Two sets of similarity 0.8 differ in about ten of 64 bits, which no ball reaches; so they
meet again under ``BANDS`` keys of ``ROWS`` minima each: a pair of similarity s is met with probability
1 - (1 - s**ROWS)**BANDS, which is 1 - 5e-8 at 0.8. Of each minimum four bits are kept as well: two sets of similarity s have
1/16 + 15/16 s of them equal, and a pair that has fewer than ``least_equal`` is left out (a chance of 1e-8 at most for a pair of the threshold),
and so is one whose sets have too many shingles in cells that the other has none in, so texts are only read for pairs that are near it. Each pair that is left is verified on its own shingle sets, so no link is false.

A key of at most ``MOST`` sets gives all its pairs. Under a hotter key each set is paired with the one whose keys are the
most common, which is the middle of a group of near copies and the same for most of its keys. That joins most of a
hot group; what it leaves apart is completed exactly: sets that were under a hot key meet again under the rarest of their
shingles (two sets of similarity t share one of the first n - ceil(t n) + 1 in any order that holds for all, so a passage that many texts
share brings nothing together), and pairs of different components are verified. Under each shingle the sets outside its largest
component are compared with the others, in parts of ``STEPS`` sets at first and whole at last, with the components anew in between. So
pairs inside a group are never listed, and no link between components is lost.

Nulls, ties, empties: null and empty texts have the empty set and are one group; rows with repeated or null ids are rows
like any other, as rows are told apart by a key of their own; the row with the least id of a group stays, one with an id before
one without.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from detectlab.llm.common import ROWS_AT_ONCE, fresh, map_texts, materialise, space_words
from detectlab.llm.components import connected_components
from detectlab.llm.simhash import majority, near_links, signed

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 4
MOST = 16
#: Bits kept of each minimum, and the chance that a pair of the threshold is taken for a less similar one.
KEPT_BITS, MISSED = 4, 1e-8
#: Cells that the shingles of a set are counted in.
CELLS = 512
#: Rare shingles that stand with each entry of a set, so that a pair is a row under the first that both have; beyond them it is one under each.
EARLIER = 128
STEPS = (16, 256, None)
_FACTORS = np.random.default_rng(7).integers(1, 1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = np.random.default_rng(8).integers(0, 1 << 63, size=BANDS * ROWS, dtype=np.uint64)
_BLOCK = 2048


def shingles(text: str | None, size: int = SHINGLE) -> set[bytes]:
    words = space_words(text)
    if not words:
        return set()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def jaccard(a: set[bytes], b: set[bytes]) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def least_equal(threshold: float) -> int:
    """So many of the kept minima are equal for a pair of the threshold, but for a chance of ``MISSED``: a binomial tail."""
    n, equal, tail = BANDS * ROWS, 2.0**-KEPT_BITS + (1 - 2.0**-KEPT_BITS) * threshold, 0.0
    for least in range(n):
        tail += math.comb(n, least) * equal**least * (1 - equal) ** (n - least)
        if tail > MISSED:
            return least
    return n


def near(x: str, y: str, threshold: float) -> str:
    """SQL: whether two sets can have the threshold's similarity, by what ``sketch`` keeps of them.

    A cell that only one of them has holds a shingle at least that they don't share, which is exact. Of the minima word w of a plane
    has one bit of 64.
    """
    words, cells = BANDS * ROWS // 64, CELLS // 64
    at = cells + KEPT_BITS * words
    of = lambda a, b: f"{a}[{at}] - ({' + '.join(f'bit_count({a}[{i}] & ~{b}[{i}])' for i in range(cells))})"
    bound = f"least({of(x, y)}, {of(y, x)}) * {1 + threshold}D >= ({x}[{at}] + {y}[{at}]) * {threshold}D - 1e-9D"
    differing = (" | ".join(f"({x}[{i}] ^ {y}[{i}])" for i in range(cells + w, at, words)) for w in range(words))
    return f"{' + '.join(f'bit_count({d})' for d in differing)} <= {BANDS * ROWS - least_equal(threshold)} AND {bound}"


def sketch(text: str | None, size: int = SHINGLE) -> tuple[str, list[int], int, list[int]]:
    """The digest of the shingle set, a signed key for each band, the fingerprint, and for ``near`` the cells of all shingles, the kept bits of
    all minima and the number of shingles; the empty set has no keys."""
    digest = xxhash.xxh64_intdigest
    hashes = np.unique(np.fromiter((digest(g) for g in shingles(text, size)), dtype=np.uint64))
    name = xxhash.xxh3_128_hexdigest(hashes.tobytes())
    if not len(hashes):
        return name, [], 0, []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), _BLOCK):
        block = (hashes[at : at + _BLOCK, None] ^ _MASKS[None, :]) * _FACTORS[None, :]
        np.minimum(least, block.min(axis=0), out=least)
    bands = least.reshape(BANDS, ROWS)
    keys = np.array([digest(row.tobytes(), seed) for seed, row in enumerate(bands)], dtype=np.uint64)
    fingerprint = signed(majority(hashes.astype(">u8").view(np.uint8).reshape(-1, 8)))
    planes = least[None, :] >> np.arange(KEPT_BITS, dtype=np.uint64)[:, None] & np.uint64(1)
    cells = np.zeros(CELLS, dtype=np.uint8)
    cells[hashes % CELLS] = 1
    kept = np.packbits(np.concatenate([cells, planes.astype(np.uint8).ravel()])).view(np.int64)
    return name, keys.view(np.int64).tolist(), fingerprint, [*kept.tolist(), len(hashes)]


def ball_pairs(sets: DataFrame) -> DataFrame:
    """(node, fp) -> pairs (a, b), a < b, of fingerprints within two bits: each set with the least of its fingerprint, and these in the balls."""
    least = materialise(sets.groupBy("fp").agg(F.min("node").alias("least")), "fingerprints")
    same = sets.join(least, "fp").where("least < node").select(F.col("least").alias("a"), F.col("node").alias("b"))
    links = materialise(near_links(least.select("fp")).distinct(), "balls")
    left = links.join(least.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a")
    both = left.join(least.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    return same.union(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def candidates(sets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(node, keys, kept) -> pairs (a, b), a < b, to verify, and the nodes that stand under a hot key."""
    entries = sets.select("node", F.explode("keys").alias("key"))
    # Only keys that meet; written, so that the join below has its sizes and Spark can split a hot key.
    sizes = materialise(entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key-sizes")
    met = materialise(entries.join(sizes, "key"), "met")
    few = met.where(F.col("n") <= MOST).join(sets.select("node", "kept"), "node")
    groups = few.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("node", "kept"))).alias("nodes"))
    pairs = groups.select(F.explode(F.expr(
        f"flatten(transform(nodes, (x, i) -> transform(filter(slice(nodes, i + 2, size(nodes)), y -> {near('x.kept', 'y.kept', threshold)}),"
        " y -> struct(x.node AS a, y.node AS b))))"
    )).alias("p")).select("p.a", "p.b")
    many = met.where(F.col("n") > MOST)
    hot = materialise(many.groupBy("node").agg(F.sum("n").alias("common")).join(sets.select("node", "kept"), "node"), "hot")
    middles = many.join(hot.select("node", "common"), "node").groupBy("key").agg(F.max(F.struct("common", "node"))["node"].alias("middle"))
    to_middle = many.join(middles, "key").where("middle <> node").select("node", "middle").distinct()
    to_middle = to_middle.join(hot.select("node", F.col("kept").alias("x")), "node").join(
        hot.select(F.col("node").alias("middle"), F.col("kept").alias("y")), "middle").where(near("x", "y", threshold))
    return pairs.union(to_middle.select(F.least("node", "middle").alias("a"), F.greatest("node", "middle").alias("b"))), hot.select("node", "kept")


def rare_shingles(hot: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """(term, node, n, m, earlier) for the rarest shingles of each hot set, as many as a similar set must share one of; m of its n some other set has,
    and ``earlier`` are the set's own before this one."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                some = batch.slice(at, ROWS_AT_ONCE)
                # One array for all these texts: numbers, not objects.
                parts = [np.fromiter((xxhash.xxh64_intdigest(g) for g in shingles(t.as_py(), size)), dtype=np.uint64).view(np.int64) for t in some.column(1)]
                counts = np.array([len(p) for p in parts])
                nodes = np.repeat(some.column(0).to_numpy(), counts)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.repeat(counts, counts).astype(np.int32)), pa.array(np.concatenate(parts))],
                                                 names=["node", "n", "term"])

    # Rows come from the function itself: an explode above a function of columns would have it run twice, for a filter and for the rows.
    listed = texts.join(hot, "node", "left_semi").select("node", "text")
    terms = materialise(listed.mapInArrow(hashes, "node long, n int, term long"), "terms")
    shared = terms.groupBy("term").agg(F.count("*").alias("df")).where("df > 1")
    known = terms.join(shared, "term").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "term"))).alias("known"))
    # Shingles that no other set has come first; they are in the prefix as far as it goes, and bring nothing.
    kept = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1 - (F.col("n") - F.size("known"))
    terms_of = F.slice("known", F.lit(1), F.greatest(kept, F.lit(0)).cast("int"))["term"]
    known = known.select("node", "n", F.size("known").alias("m"), terms_of.alias("terms"))
    known = known.select("node", "n", "m", "terms", F.posexplode("terms").alias("at", "term"))
    earlier = F.when(F.col("at") <= EARLIER, F.slice("terms", F.lit(1), F.col("at")))
    return materialise(known.select("term", "node", "n", "m", earlier.alias("earlier")), "rare")


def across(rare: DataFrame, hot: DataFrame, groups: DataFrame, step: int | None, threshold: float) -> DataFrame:
    """Pairs (a, b), a < b, of different components that share a rare shingle, or a part of about ``step`` of its sets; ``hot`` has the kept minima."""
    named = rare.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    apart = rare.join(groups, "node", "left").groupBy("term").agg(
        F.min(F.coalesce("component", "node")).alias("lo"), F.max(F.coalesce("component", "node")).alias("hi"), F.count("*").alias("sets")).where("lo < hi")
    part = F.lit(0).cast("long") if step is None else F.pmod(F.xxhash64("node", "term"), F.ceil(F.col("sets") / step)).cast("long")
    entries = named.join(apart.select("term", "sets"), "term").select("term", part.alias("part"), "node", "n", "m", "earlier", "component")
    entries = materialise(entries.join(hot, "node"), "across")
    largest = entries.groupBy("term", "part", "component").agg(F.count("*").alias("m")).groupBy("term", "part").agg(
        F.max(F.struct("m", "component"))["component"].alias("largest"))
    both = entries.join(largest, ["term", "part"]).withColumn("outside", F.col("component") != F.col("largest")).drop("largest")
    mine = both.where("outside").select("term", "part", *(F.col(c).alias(f"{c}_x") for c in ("node", "n", "m", "earlier", "component", "kept")))
    # What two sets share is among what either shares with any. All in the join's own condition, so that no other pair is a row.
    met = mine.join(both, ["term", "part"]).where(
        (F.col("component_x") != F.col("component")) & (~F.col("outside") | (F.col("node_x") < F.col("node")))
        & (F.least("m_x", "m") * (1 + threshold) >= (F.col("n_x") + F.col("n")) * threshold - 1e-9) & F.expr(near("kept_x", "kept", threshold))
        & ~F.coalesce(F.arrays_overlap("earlier_x", "earlier"), F.lit(False)))
    return met.select(F.least("node_x", "node").alias("a"), F.greatest("node_x", "node").alias("b")).distinct()


def _similar(size: int, threshold: float):
    @F.arrow_udf("boolean")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            pairs = ((a.as_py(), b.as_py()) for a, b in zip(left, right, strict=True))
            yield pa.array([jaccard(shingles(a, size), shingles(b, size)) >= threshold for a, b in pairs], type=pa.bool_())

    return run


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
                threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, str]:
    """``docs`` written with a key for each row, the keys of the rows that stay, and the name of the key."""
    row = fresh(docs, "row")
    kind = T.StructType([T.StructField("name", T.StringType()), T.StructField("keys", T.ArrayType(T.LongType())),
                         T.StructField("fp", T.LongType()), T.StructField("kept", T.ArrayType(T.LongType()))])
    run = map_texts(lambda: lambda text: sketch(text, size), kind)
    keyed = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    prints = keyed.select(F.col(row).alias("row"), F.col(id_col).alias("id"), run(F.col(text_col)).alias("s"))
    prints = materialise(prints.select("row", "id", "s.name", "s.keys", "s.fp", "s.kept"), "sketches")
    # Copies collapse here, before the shuffle: a hot text is one row per task.
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    sets = prints.groupBy("name").agg(first, F.first("keys").alias("keys"), F.first("fp").alias("fp"), F.first("kept").alias("kept"))
    sets = materialise(sets.select(F.col("first.row").alias("node"), "first", "keys", "fp", "kept"), "sets")
    pairs, hot = candidates(sets, threshold)
    balls = ball_pairs(sets.where("size(keys) > 0").select("node", "fp"))
    pairs = materialise(pairs.union(balls).distinct(), "pairs")
    texts = keyed.select(F.col(row).alias("node"), F.col(text_col).alias("text"))

    def verified(some: DataFrame) -> DataFrame:
        # Written, so that a join with few rows has their size and the texts need no exchange.
        needed = materialise(some.select(F.col("a").alias("node")).union(some.select("b")).distinct(), "needed")
        own = materialise(texts.join(needed, "node", "left_semi"), "texts")
        left = materialise(some.join(own.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a"), "left")
        both = left.join(own.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
        return both.where(_similar(size, threshold)(F.col("ta"), F.col("tb"))).select("a", "b")

    links = materialise(verified(pairs), "found")
    groups = connected_components(links)
    if not hot.isEmpty():
        rare = rare_shingles(hot.select("node"), texts, size, threshold)
        for step in STEPS:
            more = materialise(across(rare, hot, groups, step, threshold).join(pairs, ["a", "b"], "left_anti"), "more")
            if more.isEmpty():
                continue
            new = materialise(verified(more), "new")
            pairs = pairs.union(more)
            if not new.isEmpty():
                links = links.union(new)
                groups = connected_components(links)
    stay = sets.join(groups, "node", "left").groupBy(F.coalesce("component", "node").alias("group")).agg(F.min("first").alias("first"))
    return keyed, materialise(stay.select(F.col("first.row").alias(row)), "stay"), row


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
                     threshold: float = THRESHOLD) -> DataFrame:
    """Exactly one row of each group; all columns stay."""
    keyed, stay, row = near_copies(docs, id_col, text_col, size, threshold)
    return keyed.join(stay, row, "left_semi").select(*docs.columns)
