"""Near-duplicate groups by SimHash fingerprints and multi-index hashing.

Words are runs without ASCII white space, A-Z in lower case; a shingle is ``shingle`` words in a row (all words of a
shorter text). Each shingle votes with the bits of its XXH64, and a fingerprint bit is 1 where more than half of the
votes are. Fingerprints that differ in at most two bits are linked.

The search enumerates the ball of radius 1 inside each segment of the fingerprint while the other segments stay as they
are. Two fingerprints within two bits meet in at least one entry: the one that takes one of the two bits from each. An
entry is a whole 64-bit value and can only be reached from itself and its 64 neighbours, so a bucket never holds more
than 65 fingerprints, however many near copies a text has. Buckets that hold a segment alone would hold all of them.
The complete distance of each match is verified.

Nulls, ties, empties: a null or empty text has fingerprint zero and is linked like any other; equal texts share a
fingerprint and so a group; a repeated id keeps its rows; a row with a null id gets a fingerprint and a group, and a
group whose ids are all null has a null component_id; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from detectlab.llm.common import fresh, map_texts, materialise, space_words
from detectlab.llm.components import connected_components

BITS, SEGMENTS, MAX_DISTANCE = 64, 4, 2
_BIT_TABLE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_PLACE = (np.arange(8, dtype=np.int32) * 256)[None, :]


def simhash(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint as an unsigned number."""
    words = space_words(text)
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    elif shingle == 3:
        grams = [b"%b %b %b" % g for g in zip(words, words[1:], words[2:], strict=False)]
    else:
        grams = [b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)]
    return majority(np.frombuffer(b"".join([digest(g, seed) for g in grams]), dtype=np.uint8).reshape(-1, 8))


def majority(votes: np.ndarray) -> int:
    """The number whose bits more than half of the votes have; a vote is a row of eight bytes, big-endian."""
    # Count each value of each byte, then the bits of the values.
    seen = np.bincount((votes + _PLACE).ravel(), minlength=2048).reshape(8, 256)
    ones = (seen @ _BIT_TABLE)[::-1].ravel()
    return int.from_bytes(np.packbits(2 * ones > len(votes), bitorder="little").tobytes(), "little")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""
    run = map_texts(lambda: lambda text: (signed(simhash(text, shingle)),), T.StructType([T.StructField("fp", T.LongType())]))
    return docs.select(F.col(id_col).alias("doc_id"), run(F.col(text_col)).alias("__r")).select("doc_id", "__r.fp")


def near_links(prints: DataFrame) -> DataFrame:
    """Distinct ``fp`` -> links (a, b) that connect all fingerprints within two bits of each other.

    Neighbours in an entry are linked in a chain, so an entry of n gives n - 1 links and not n * n; each link is a true
    one, and every pair within two bits is connected through its common entry.
    """
    width = BITS // SEGMENTS
    # One array over all segments: bit i of segment s flips bit s * width + i.
    flips = [F.expr(f"transform(sequence(0, {width - 1}), i -> fp ^ shiftleft(1L, {s * width} + i))") for s in range(SEGMENTS)]
    entries = prints.select("fp", F.explode(F.concat(F.array("fp"), *flips)).alias("entry"))
    before = F.lag("fp").over(Window.partitionBy("entry").orderBy("fp"))
    matches = entries.select(F.col("fp").alias("a"), before.alias("b")).where("b is not null")
    return matches.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_DISTANCE)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row."""
    prints = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    # Copies collapse here, before the shuffle: a hot text is one row per task.
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    groups = connected_components(near_links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    linked = distinct.join(groups, "fp")
    least = linked.groupBy("component").agg(F.min("first_id").alias("least_id"))
    by_group = linked.join(least, "component").select("fp", "least_id")
    owner = distinct.join(by_group, "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id"))
    # Written, so that the join has nothing but its two exchanges below it and Spark can split a hot fingerprint.
    owner = materialise(owner, "owners")
    return prints.join(owner, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """The rows whose id is the least of their group; all columns stay. Of rows that repeat that id each one stays."""
    groups = near_duplicates(docs, id_col, text_col, shingle)
    name = fresh(docs, "first_id")
    first = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(first, F.col(id_col).eqNullSafe(F.col(name)), "left_semi")
