"""Benchmark decontamination: a broadcast hash set of benchmark windows, scanned against all document words.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z is lower-cased. A window is ``size`` words in a row of an
item; an item of fewer words, but not none, is one window. A document word inside any occurrence of any window is hit.
Window hashes are sums of word numbers times random odd factors, so all windows of a batch are hashed at once; a match
of the hash is verified word by word.

The benchmark is a query set: it is broadcast in blocks of at most about ``block_bytes`` of text each, so its size never
decides what an executor must hold. One block is the usual case and costs one pass without a shuffle. With more, every
block's hits are carried along in a column and the table is written between passes.

Nulls, ties, empties: a null or empty text has no words and no hits; a null item hits words but is not named; items that
repeat an id count once; a repeated document keeps its rows; an empty benchmark hits nothing; other columns pass through.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from detectlab.llm.common import ASCII_LOWER, fresh, materialise

WINDOW = 10
BLOCK_BYTES = 16 << 20
#: Words of a step: bounds the arrays of a batch, whatever the texts.
STEP_WORDS = 1 << 20

_WORD_BYTES = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(128, 256))
_TO_WORDS = bytes(b if b in _WORD_BYTES else 32 for b in (ASCII_LOWER[i] for i in range(256)))
_WORD = re.compile(rb"[^ ]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_TO_WORDS).split() if text else []


class WindowSet:
    """All windows of a block of items, by length; every distinct window has its own hash."""

    def __init__(self, items: list[tuple[int | None, str | None]], size: int):
        self.number: dict[bytes, int] = {}
        owners: dict[int, dict[tuple[int, ...], set[int]]] = {}
        for item_id, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            length = min(size, len(ids))
            for at in range(len(ids) - length + 1 if length else 0):
                named = owners.setdefault(length, {}).setdefault(tuple(ids[at : at + length]), set())
                if item_id is not None:
                    named.add(item_id)
        self.lengths = {length: self._table(length, windows) for length, windows in sorted(owners.items())}

    @staticmethod
    def _table(length: int, windows: dict[tuple[int, ...], set[int]]) -> tuple:
        rows = np.array(list(windows), dtype=np.int64).reshape(-1, length)
        named = list(windows.values())
        for seed in range(1000):
            factors = np.random.default_rng(seed).integers(1, 1 << 63, length, dtype=np.uint64) | np.uint64(1)
            hashes = (rows.astype(np.uint64) * factors).sum(axis=1, dtype=np.uint64)
            order = np.argsort(hashes, kind="stable")
            if len(np.unique(hashes)) == len(hashes):
                return factors, hashes[order], rows[order], [named[i] for i in order]
        raise RuntimeError("no seed keeps the windows apart")

    def find(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """ids: word numbers, 0 for other words and between texts -> (length, positions, rows of the window table)."""
        known = np.concatenate([[0], np.cumsum(ids != 0)])
        for length, (factors, hashes, rows, _) in self.lengths.items():
            if len(ids) < length:
                continue
            at = np.flatnonzero(known[length:] - known[:-length] == length)
            if not len(at):
                continue
            value = np.zeros(len(at), dtype=np.uint64)
            for k in range(length):
                value += ids[at + k].astype(np.uint64) * factors[k]
            row = np.minimum(np.searchsorted(hashes, value), len(hashes) - 1)
            same = hashes[row] == value
            at, row = at[same], row[same]
            exact = (ids[at[:, None] + np.arange(length)] == rows[row]).all(axis=1)
            yield length, at[exact], row[exact]


#: n_words, then the hit words as alternating starts and ends, then the items.
HITS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("ranges", T.ArrayType(T.IntegerType())),
    T.StructField("items", T.ArrayType(T.LongType())),
])


def _scan(texts: list[str | None], windows: WindowSet) -> list[tuple[int, list[int], list[int]]]:
    out: list[tuple[int, list[int], list[int]]] = []
    group: list[list[bytes]] = []
    held = 0
    for text in texts:
        group.append(words_of(text))
        held += len(group[-1]) + 1
        if held >= STEP_WORDS:
            out += _scan_words(group, windows)
            group, held = [], 0
    return out + _scan_words(group, windows)


def _scan_words(group: list[list[bytes]], windows: WindowSet) -> list[tuple[int, list[int], list[int]]]:
    lengths = np.array([len(words) for words in group], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    ids = np.zeros(int(starts[-1]), dtype=np.int64)
    for words, start in zip(group, starts, strict=False):
        ids[start : start + len(words)] = np.fromiter(map(windows.number.get, words, repeat(0)), np.int64, len(words))
    marks = np.zeros(len(ids) + 1, dtype=np.int64)
    items: dict[int, set[int]] = {}
    for length, at, row in windows.find(ids):
        np.add.at(marks, at, 1)
        np.add.at(marks, at + length, -1)
        named = windows.lengths[length][3]
        text_of = np.searchsorted(starts, at, side="right") - 1
        for text, r in set(zip(text_of.tolist(), row.tolist(), strict=True)):
            items.setdefault(text, set()).update(named[r])
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(marks) > 0).astype(np.int8)])))
    ranges: dict[int, list[int]] = {}
    owner = np.searchsorted(starts, edges[::2], side="right") - 1
    for text, start, end in zip(owner.tolist(), edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        ranges.setdefault(text, []).extend((start - int(starts[text]), end - int(starts[text])))
    return [(int(n), ranges.get(i, []), sorted(items.get(i, ()))) for i, n in enumerate(lengths)]


def _merged(a: list[int], b: list[int]) -> list[int]:
    out: list[int] = []
    for start, end in sorted([*zip(a[::2], a[1::2], strict=True), *zip(b[::2], b[1::2], strict=True)]):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def _scanners(windows: Broadcast[WindowSet]) -> tuple[Callable, Callable]:
    """Column functions: hits of a text, and hits of a text added to those found before."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(HITS)

    @F.arrow_udf(HITS)
    def first(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = _scan(texts.to_pylist(), windows.value)
            yield pa.array([{"n_words": n, "ranges": r, "items": i} for n, r, i in rows], type=kind)

    @F.arrow_udf(HITS)
    def more(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for texts, found in batches:
            both = zip(_scan(texts.to_pylist(), windows.value), found.to_pylist(), strict=True)
            yield pa.array(
                [{"n_words": n, "ranges": _merged(r, old["ranges"]), "items": sorted({*i, *old["items"]})} for (n, r, i), old in both],
                type=kind,
            )

    return first, more


def with_hits(docs: DataFrame, benchmark: DataFrame, name: str, text_col: str = "text", item_col: str = "item_id",
              item_text_col: str = "text", size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` and a column ``name`` of type HITS."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("words"))
    total = items.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    blocks = max(1, math.ceil(1.3 * total / block_bytes))
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == block) if blocks > 1 else items
        windows = docs.sparkSession.sparkContext.broadcast(WindowSet([tuple(r) for r in part.collect()], size))

        first, more = _scanners(windows)
        docs = docs.withColumn(name, first(F.col(text_col)) if block == 0 else more(F.col(text_col), F.col(name)))
        if block + 1 < blocks:
            docs = materialise(docs, "hits")
    return docs


def _hit_words(hits: Column) -> Column:
    """Ends minus starts of the ranges."""
    signs = F.transform(hits, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x).cast("long"))
    return F.aggregate(signs, F.lit(0).cast("long"), lambda a, x: a + x)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row."""
    found = with_hits(docs.select(F.col(id_col).alias("doc_id"), F.col(options.pop("text_col", "text")).alias("text")), benchmark, "h", **options)
    names = F.array_join(F.array_sort(F.transform("h.items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "h.n_words", _hit_words(F.col("h.ranges")).alias("n_hit"), F.size("h.items").cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"), (F.size("h.ranges") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents without any hit word; all their columns stay."""
    name = fresh(docs, "hits")
    found = with_hits(docs, benchmark, name, text_col=text_col, **options)
    return found.where(F.size(F.col(name)["ranges"]) == 0).drop(name)


def cut_words(text: str | None, ranges: list[int]) -> str | None:
    """The text without the words of the ranges and what stands between them."""
    if not text or not ranges:
        return text
    data = text.encode()
    places = [m.span() for m in _WORD.finditer(data.translate(_TO_WORDS))]
    kept, at = [], 0
    for start, end in zip(ranges[::2], ranges[1::2], strict=True):
        kept.append(data[at : places[start][0]])
        at = places[end - 1][1]
    return b"".join([*kept, data[at:]]).decode()


def cut_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """All documents, their hit spans taken out of the text."""
    name = fresh(docs, "hits")
    found = with_hits(docs, benchmark, name, text_col=text_col, **options)

    @F.arrow_udf("string")
    def cut(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        return pa.array([cut_words(t, r) for t, r in zip(texts.to_pylist(), ranges.to_pylist(), strict=True)], type=pa.string())

    return found.withColumn(text_col, cut(F.col(text_col), F.col(name)["ranges"])).drop(name)


__all__ = ["HITS", "WindowSet", "contamination", "cut_contaminated", "drop_contaminated", "with_hits", "words_of"]
