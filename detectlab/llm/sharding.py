"""Sharding into a fixed number of shards by bytes: minimax contiguous partition of atomic groups.

Rows of equal text are one group and stay together. Groups are ordered by a 64-bit hash of their text, so no sort is
needed: a run of groups is an interval of hashes, and the bytes of all intervals of a width are one partial aggregate.
The smallest feasible shard capacity is found by binary search with a greedy check on the driver, over a list that is
coarse everywhere but where a cut can fall. Intervals that a cut may fall into are split further, level by level,
until each one is a single group; the list stays at some thousand entries whatever the corpus.

Groups larger than an equal share of what is left come first in the order and fill a shard each; the capacity of the
others would otherwise be theirs, and most shards empty.

Nulls, ties, empties: a null text has size 1, and is one group with the empty text; a null or repeated id is a row like
any other; with fewer groups than shards some shards are empty; an empty table gives an empty one; other columns are
not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from detectlab.llm.common import materialise, rows_per_slice

FIRST_BITS, MORE_BITS = 12, 8
#: Rows of a slice that is numbered by one task.
SLICE_ROWS = 1 << 16


@dataclass(frozen=True)
class Run:
    """Consecutive groups in hash order: bytes, the least hash, and the prefix that they share if there are several."""

    size: int
    first: int
    prefix: int
    bits: int
    single: bool


def _runs(sizes: DataFrame, bits: int, within: list[Run]) -> list[Run]:
    """The runs of all groups (no ``within``) or of those in the given runs, ``bits`` bits wide."""
    if within:
        old = within[0].bits
        sizes = sizes.where(F.shiftright("h", 64 - old).isin([r.prefix for r in within]))
    rows = sizes.groupBy(F.shiftright("h", 64 - bits).alias("p")).agg(F.sum("size"), F.min("h"), F.max("h")).collect()
    return sorted((Run(r[1], r[2], r[0], bits, r[2] == r[3]) for r in rows), key=lambda r: r.first)


def _cuts(runs: list[Run], capacity: int, shards: int, late: bool) -> list[int] | None:
    """Greedy: for each shard but the last the place in bytes where it ends at the latest, or None if too few.

    A run of several groups may be cut anywhere if ``late``, else only before it: the two bracket the true cut.
    """
    cuts, start, at = [], 0, 0
    for run in runs:
        if at + run.size - start > capacity:
            if run.single or not late:
                if run.size > capacity:
                    return None
                cuts.append(at)
                start = at
            else:
                while at + run.size - start > capacity:
                    start += capacity
                    cuts.append(start)
        at += run.size
    return cuts if len(cuts) < shards else None


def _least(runs: list[Run], shards: int, late: bool) -> int:
    """The smallest feasible capacity under either way to cut."""
    total = sum(r.size for r in runs)
    low, high = max(1, -(-total // shards)), max(1, total)
    while low < high:
        middle = (low + high) // 2
        if _cuts(runs, middle, shards, late) is None:
            low = middle + 1
        else:
            high = middle
    return low


def minimax_cuts(sizes: DataFrame, shards: int) -> list[int]:
    """(h, size) rows -> the least hash of each shard but the first, for at most ``shards`` contiguous shards."""
    runs = _runs(sizes, FIRST_BITS, [])
    while True:
        low, high = _least(runs, shards, True), _least(runs, shards, False)
        # The k-th cut lies between that of the smallest capacity cut early and that of the largest cut late.
        early, late = _cuts_or_all(runs, low, False), _cuts_or_all(runs, high, True)
        total = sum(r.size for r in runs)
        spans = [(a, late[k] if k < len(late) else total) for k, a in enumerate(early[: shards - 1])]
        open_runs, at = [], 0
        for run in runs:
            end = at + run.size
            # A run that is large beside a shard may hold several cuts.
            if not run.single and (4 * run.size > low or any(at <= b and a <= end for a, b in spans)):
                open_runs.append(run)
            at = end
        if not open_runs:
            break
        least_bits = min(r.bits for r in open_runs)
        now = [r for r in open_runs if r.bits == least_bits]
        finer = _runs(sizes, min(64, least_bits + MORE_BITS), now)
        gone = set(now)
        runs = sorted([r for r in runs if r not in gone] + finer, key=lambda r: r.first)
    cuts = _cuts(runs, high, shards, False)
    firsts, at = {}, 0
    for run in runs:
        firsts[at] = run.first
        at += run.size
    return [firsts[c] for c in cuts or []]


def _cuts_or_all(runs: list[Run], capacity: int, late: bool) -> list[int]:
    """As many greedy cuts as fit; a run larger than the capacity is a shard of its own."""
    cuts, start, at = [], 0, 0
    for run in runs:
        if at + run.size - start > capacity:
            if late and not run.single:
                while at + run.size - start > capacity:
                    start += capacity
                    cuts.append(start)
            elif at > start:
                cuts.append(at)
                start = at
        at += run.size
    return cuts


def _large_groups(groups: DataFrame, shards: int) -> list[tuple[int, int]]:
    """Groups (h, size) above an equal share of what is left, largest first: fewer than ``shards``, read in a few steps."""
    large: list[tuple[int, int]] = []
    left, places = groups.agg(F.sum("size")).first()[0] or 0, shards
    while places > 1 and left:
        # Fewer than ``places`` groups can be above this share; taking one out only lowers the share.
        found = groups.where(F.col("size") * places > left)
        if large:
            found = found.where(~F.col("h").isin([h for h, _ in large]))
        found = found.orderBy(F.desc("size"), "h").limit(places - 1).collect()
        if not found:
            break
        large += [(r["h"], r["size"]) for r in found]
        left, places = left - sum(r["size"] for r in found), places - len(found)
    return large


def _shard_of(h: Column, large: list[int], cuts: list[int]) -> Column:
    after = F.lit(len(large))
    for cut in cuts:
        after = after + (h >= F.lit(cut)).cast("int")
    return reduce(lambda rest, at: F.when(h == F.lit(large[at]), F.lit(at)).otherwise(rest), reversed(range(len(large))), after).cast("int")


def numbered(rows: DataFrame, group: str, ids: str, total: int) -> DataFrame:
    """A gapless number from 0 within each value of ``group``, in column ``slot``.

    Each group is cut into slices by a hash of the id, whose number grows with the table; slices are numbered on their own
    and their counts added up, so no task sees a whole group.
    """
    slices = rows_per_slice(total, SLICE_ROWS)
    rows = rows.withColumn("__slice", F.pmod(F.xxhash64(ids), F.lit(slices)).cast("int"))
    counts = rows.groupBy(group, "__slice").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(group, "__slice", F.coalesce(before, F.lit(0)).alias("__offset"))
    place = F.row_number().over(Window.partitionBy(group, "__slice").orderBy(ids)) - 1
    return rows.withColumn("__place", place).join(offsets, [group, "__slice"]).withColumn("slot", F.col("__offset") + F.col("__place"))


def byte_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row; the law is ``bytes``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = materialise(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"),
    ), "sizes")
    # One row per text: a hot group of copies is one partial sum per task.
    groups = materialise(sized.groupBy("h").agg(F.sum("size").alias("size")), "groups")
    large = _large_groups(groups, shards)
    rest = groups.where(~F.col("h").isin([h for h, _ in large])) if large else groups
    cuts = minimax_cuts(rest, shards - len(large))
    placed = sized.withColumn("shard", _shard_of(F.col("h"), [h for h, _ in large], cuts))
    # Written, as the numbering reads it twice.
    placed = materialise(placed.drop("h"), "shards")
    return numbered(placed, "shard", "doc_id", placed.count()).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
