"""Small helpers that the operators share: byte-level words, per-text Arrow functions, durable intermediate tables."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from detectlab.session import materialise

#: Rows of an Arrow batch that are Python objects at once.
ROWS_AT_ONCE = 500
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Lower-cases A-Z and nothing else; on UTF-8 bytes, so letters beyond ASCII stay as they are.
ASCII_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())


def space_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text in UTF-8, A-Z in lower case. Null has none."""
    return text.encode().translate(ASCII_LOWER).split() if text else []


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def map_texts(make: Callable[[], Callable[[str | None], tuple]], schema: T.StructType,
              done: Callable[[], None] | None = None) -> Callable[[Column], Column]:
    """Column function text -> struct, in Arrow batches.

    ``make`` runs once a task and gives the function for one text, so models and caches are set up once and
    nothing is kept across texts but what ``make`` itself keeps. ``done`` runs when the task's last batch has been read.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(schema)

    @F.arrow_udf(schema)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = make()
        for texts in batches:
            parts = []
            for at in range(0, max(1, len(texts)), ROWS_AT_ONCE):
                rows = [one(t) for t in texts.slice(at, ROWS_AT_ONCE).to_pylist()]
                columns = zip(*rows, strict=True) if rows else [()] * len(kind)
                parts.append(pa.StructArray.from_arrays(
                    [pa.array(list(c), type=f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind)
                ))
            yield pa.concat_arrays(parts)
        if done is not None:
            done()

    return run


def with_texts(df: DataFrame, keep: list[str], result: Column) -> DataFrame:
    """The kept columns and the fields of the struct ``result``."""
    return df.select(*keep, result.alias("__r")).select(*keep, "__r.*")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    name = f"__{stem}"
    while name in df.columns:
        name += "_"
    return name


def crc_remainder(id_column: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null ids give null."""
    return F.crc32(id_column.cast("string").cast("binary")) % modulus


def rows_per_slice(total: int, per_slice: int) -> int:
    """How many slices hold ``total`` rows with about ``per_slice`` in each: it grows with the data."""
    return max(1, math.ceil(total / per_slice))


__all__ = ["ASCII_LOWER", "crc_remainder", "fresh", "map_texts", "materialise", "rows_per_slice", "sha256_hex",
           "space_words", "with_texts"]
