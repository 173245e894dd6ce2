"""Exact-data match: registered values, hashed with a key, found in text under any spacing or punctuation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from detectlab.functions import fixed
from detectlab.functions.unicode import normal_form
from detectlab.operators.rates import pct

WARN_ABOVE = 50_000

#: Starts of runs that are looked at together, with what a run from them can reach.
WINDOW = 1 << 16
#: Cells of the filter of registered values: one byte each, so many for a value, and no more than so many in all.
CELLS_A_VALUE, MOST_CELLS = 16, 1 << 23


#: Spaces that have no compatibility form.
_SPACES = "".join(fixed.UNICODE_SPACES.values())


def _folded(text: Column) -> Column:
    return F.lower(F.translate(normal_form(text, "NFKC"), _SPACES, " " * len(_SPACES)))


def edm_normalise(value: Column) -> Column:
    """Compatibility form (NFKC), lower case, spaces and ``-./()`` removed. Look-alike letters stay different."""
    return F.regexp_replace(_folded(value), r"[\s\-./()]+", "")


def value_hash(normalised: Column, key: str) -> Column:
    return F.sha2(F.concat(F.lit(key), normalised), 256)


def _base(key: str) -> int:
    """An odd number from the key, so that it has an inverse among 64-bit numbers."""
    return int.from_bytes(sha256(f"probe|{key}".encode()).digest()[:8], "little") | 1


def _mixed(sums: np.ndarray) -> np.ndarray:
    sums = (sums ^ sums >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
    return sums ^ sums >> np.uint64(29)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2 ... as 64-bit numbers, n of them."""
    factors = np.full(n, base, dtype=np.uint64)
    factors[:1] = 1
    return np.cumprod(factors, dtype=np.uint64)


def value_probe(normalised: Column, key: str) -> Column:
    """The characters as digits to a base that depends on the key: a run's is the difference of two prefix sums."""
    base = _base(key)

    @F.arrow_udf("long")
    def run(values: pa.Array) -> pa.Array:
        powers = _powers(base, max([len(v) for v in values.to_pylist() if v] or [1]))
        sums = [None if v is None else (codes := _codes(v)) @ powers[: len(codes)] for v in values.to_pylist()]
        mixed = _mixed(np.array([x or 0 for x in sums], dtype=np.uint64)).view(np.int64)
        return pa.array(mixed, mask=np.array([x is None for x in sums], dtype=bool))

    return run(normalised)


def register_values(values: DataFrame, key: str, value: str = "value") -> DataFrame:
    """The dictionary: one row per category and hash, with the number of words a value spans and its length.

    ``probe`` is a short hash with the same key, for a first look before the long one is computed.
    """
    normalised = edm_normalise(F.col(value))
    return values.filter(normalised != "").select(
        "category", "label", value_hash(normalised, key).alias("value_hash"), F.length(normalised).alias("n_chars"),
        F.size(F.split(F.trim(F.col(value)), r"\s+")).alias("n_words"),
        value_probe(normalised, key).alias("probe"),
    ).groupBy("category", "value_hash").agg(
        F.min("label").alias("label"), F.max("n_chars").alias("n_chars"), F.max("n_words").alias("n_words"),
        F.max("probe").alias("probe"))


def registration_counts(dictionary: DataFrame, namespace: str = "edm") -> DataFrame:
    return dictionary.groupBy("category").agg(
        F.count("*").alias("entries"), F.count_distinct("value_hash").alias("hashes"),
    ).select(F.concat_ws(":", F.lit(namespace), F.col("category")).alias("category"), "entries", "hashes",
             (F.col("hashes") > WARN_ABOVE).alias("over_limit"))


def _tokens(text: Column) -> Column:
    """Normalised tokens between white space, without punctuation at their ends; empty ones are left out. The whole text is cleaned at once."""
    edge = r"""[,;:!?"'<>\[\]{}]"""
    # A run of punctuation is looked at from its first character alone.
    bare = F.regexp_replace(_folded(text), rf"(?<!\S){edge}++|(?<!{edge}){edge}++(?!\S)", "")
    return F.array_remove(F.split(F.regexp_replace(bare, r"[\-./()]+", ""), r"\s+"), "")


def cells_of(dictionary: DataFrame, column: str, values: int) -> bytes:
    """The filter of a column of the dictionary: one byte for each cell that hashes fall into, by their remainder.

    The driver gets a 64-bit word for 64 cells, not a value; the number of cells is bounded, and a full filter only means that
    more runs get their long hash. The answer does not depend on it.
    """
    n = 1 << max(6, min(MOST_CELLS, CELLS_A_VALUE * values).bit_length() - 1)
    cells = dictionary.select(F.pmod(column, F.lit(n)).alias("cell"))
    words = cells.groupBy(F.shiftright("cell", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(cell & 63 AS INT))")).alias("bits"))
    flags = bytearray(n)
    for word, bits in words.collect():
        for i in range(64):
            if bits >> i & 1:
                flags[word * 64 + i] = 1
    return bytes(flags)


def _runs(df: DataFrame, keys: Sequence[str], text: str, lengths: Sequence[int], key: str, probes: bytes | None) -> DataFrame:
    """keys, position, words, run: every run of tokens that has the length of a registered value, and may be one.

    Tokens of many rows stand one after the other, with the places of their characters. A run of so many characters begins at a place if
    the place so far on is the end of a token of the same row; its probe is the difference of two prefix sums, so no run is put
    together before that is known. All starts of a part are looked at together, once for each length.
    """
    base, longest = _base(key), max(lengths)
    back = pow(base, -1, 1 << 64)
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("position", T.IntegerType()), T.StructField("words", T.IntegerType()),
                           T.StructField("run", T.StringType())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = None if probes is None else np.frombuffer(probes, dtype=np.uint8)
        up, down = _powers(base, 1), _powers(back, 1)
        for batch in batches:
            lists = batch.column(len(keys))
            counts = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            if not len(flat):
                continue
            row = np.repeat(np.arange(len(counts)), counts)
            before = (np.cumsum(counts) - counts)[row]
            size = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(size)
            starts, row_end = ends - size, ends[before + counts[row] - 1]
            a = 0
            while a < len(flat):
                b = min(a + WINDOW, len(flat))
                reach = int(np.searchsorted(starts, ends[b - 1] + longest, side="left"))
                joined, zero = "".join(flat.slice(a, reach - a).to_pylist()), starts[a]
                if len(joined) > len(up):
                    up, down = _powers(base, len(joined)), _powers(back, len(joined))
                sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_codes(joined) * up[: len(joined)], dtype=np.uint64)])
                token_at = np.full(len(joined) + 1, -1, dtype=np.int64)
                token_at[ends[a:reach] - zero] = np.arange(a, reach)
                first, limit = starts[a:b] - zero, np.minimum(row_end[a:b] - zero, len(joined))
                found = []
                for n in lengths:
                    some = np.flatnonzero(first + n <= limit)
                    some = some[token_at[first[some] + n] >= 0]
                    at = first[some]
                    if flags is not None:
                        probe = _mixed((sums[at + n] - sums[at]) * down[at])
                        some = some[flags[probe & np.uint64(len(flags) - 1)] == 1]
                        at = first[some]
                    if len(some):
                        found.append((some + a, token_at[at + n], at, at + n))
                if found:
                    start, end, low, high = (np.concatenate(c) for c in zip(*found, strict=True))
                    kept = batch.select(list(range(len(keys)))).take(pa.array(row[start]))
                    yield pa.RecordBatch.from_arrays(
                        [*kept.columns, pa.array((start - before[start] + 1).astype(np.int32)), pa.array((end - start + 1).astype(np.int32)),
                         pa.array([joined[i:j] for i, j in zip(low.tolist(), high.tolist(), strict=True)], pa.string())], names=schema.names)
                a = b

    return df.select(*keys, _tokens(F.col(text)).alias("__t")).mapInArrow(find, schema)


def find_registered(df: DataFrame, keys: Sequence[str], text: str, dictionary: DataFrame, key: str) -> DataFrame:
    """One row per registered value found: keys, position, words, category, label, value_hash.

    Values are found under any spacing: what counts is the normalised characters, and the lengths that registered values
    have, which are a short list of small numbers. Only runs that pass the filter of probes are rows and get their long
    hash, so what is joined is about as many rows as there are finds. The join is a plain one on the hash: Spark broadcasts a
    small dictionary by its size, or splits a hot run, as it finds at run time.
    """
    values, lengths = dictionary.agg(F.count("*"), F.sort_array(F.collect_set("n_chars"))).first()
    lengths = [n for n in lengths if n]
    if not lengths:
        lengths = [1]
    probes = cells_of(dictionary, "probe", values) if "probe" in dictionary.columns else None
    runs = _runs(df, keys, text, lengths, key, probes)
    hashed = runs.select(*keys, "position", "words", value_hash(F.col("run"), key).alias("value_hash"))
    return hashed.join(dictionary.select("value_hash", "category", "label"), "value_hash")


def match_rate(dictionary: DataFrame, found: DataFrame) -> DataFrame:
    """Registered values per category and how many of them occur."""
    hits = found.select("category", "value_hash").distinct().withColumn("hit", F.lit(1))
    return dictionary.join(hits, ["category", "value_hash"], "left").groupBy("category").agg(
        F.count("*").alias("registered"), F.count("hit").alias("found"),
    ).withColumn("match_pct", pct(F.col("found"), F.col("registered")))


def every_four(value: Column, sep: str) -> Column:
    """Groups of four characters; a shorter value is followed by its first one, so that it is changed as well."""
    longer = F.array_join(F.regexp_extract_all(value, F.lit("(?s)(.{1,4})"), F.lit(1)), sep)
    return F.when(F.length(value) <= 4, F.concat(value, F.lit(sep), F.substring(value, 1, 1))).otherwise(longer)


# Probes of a matcher's normalisation, one changed text per registered value.
PROBES = {
    "exact": lambda v: v,
    "uppercase": F.upper,
    "lowercase": F.lower,
    "dashes": lambda v: every_four(v, "-"),
    "spaces": lambda v: every_four(v, " "),
    "dots": lambda v: every_four(v, "."),
    "slashes": lambda v: every_four(v, "/"),
    "nbsp_spaces": lambda v: every_four(v, "\u00a0"),
    "homoglyph_0": lambda v: F.replace(v, F.lit("0"), F.lit("\u041e")),
    "homoglyph_o": lambda v: F.replace(v, F.lit("o"), F.lit("\u043e")),
    "zero_width": lambda v: every_four(v, "\u200b"),
}


def probe_values(values: DataFrame, value: str = "value") -> DataFrame:
    """Eleven texts per value."""
    return values.select("category", value, F.inline(F.array(*[
        F.struct(F.lit(name).alias("probe"), build(F.col(value)).alias("text")) for name, build in PROBES.items()])))


def probe_report(values: DataFrame, dictionary: DataFrame, key: str, value: str = "value") -> DataFrame:
    """Per probe how many whole texts the dictionary still matches, and what that says about the normalisation."""
    hashed = probe_values(values, value).withColumn("value_hash", value_hash(edm_normalise(F.col("text")), key))
    known = dictionary.select("value_hash").distinct().withColumn("hit", F.lit(1))
    counted = hashed.join(known, "value_hash", "left").groupBy("probe").agg(
        F.count("*").alias("tested"), F.count("hit").alias("detected"))
    rate = pct(F.col("detected"), F.col("tested"))
    return counted.withColumn("detected_pct", rate).withColumn("absorbed", F.when(
        F.col("detected") * 100 >= F.col("tested") * 99, "yes").when(
        F.col("detected") * 100 >= F.col("tested") * 20, "partial").otherwise("no"))
