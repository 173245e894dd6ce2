"""Connected components of a graph given as a table of links, by alternating large-star and small-star steps.

Kiveris et al., Connected Components in MapReduce and Beyond (2014). Every step is a group-wise minimum, which is
combined before the shuffle, and an equi-join that Spark can split where a key is hot. Each round is written to the
shared folder, so the plan stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from detectlab.llm.common import materialise


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("b", "a") % (1 << 31))).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    # a > b in links: the larger neighbours of node x are the rows with b = x.
    joined = links.join(least.withColumnRenamed("a", "b"), "b")
    return joined.select("a", F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    kept = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return kept.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``links`` (a, b), any order, -> (node, component) for every node with a link to another one.

    ``component`` is the least node that can be reached. Links from a node to itself and links with a null say
    nothing and are left out; repeated links are counted once; no links give no rows.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = materialise(links, "links")
    before = _state(links)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        links = materialise(_small_star(materialise(_large_star(links), "links")), "links")
        now = _state(links)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    pairs = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return pairs.union(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
