"""Deterministic draws: a function of (seed, salt, row id), so results do not depend on partitioning or retries."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from detectlab.functions.text import let


def _key(seed: int, salt: str, row_id: Column) -> Column:
    return F.concat_ws("|", F.lit(str(seed)), F.lit(salt), row_id.cast("string"))


def _hex_int(hexes: Column, start: int, size: int) -> Column:
    return F.conv(F.substring(hexes, start, size), 16, 10).cast("bigint")


def uniform(seed: int, salt: str, row_id: Column) -> Column:
    """Uniform number in [0, 1) with 32 bits."""
    return _hex_int(F.md5(_key(seed, salt, row_id)), 1, 8) / F.lit(4294967296.0)


def uniform_of(seed: int, salt: str, row_id: int) -> float:
    """The same number on the driver, for parameters that are drawn while a plan is made."""
    return int(hashlib.md5(f"{seed}|{salt}|{row_id}".encode()).hexdigest()[:8], 16) / 4294967296.0


def permutation_of(seed: int, salt: str, row_id: int, items: Sequence[str]) -> list[str]:
    keyed = [(hashlib.md5(f"{seed}|{salt}.{i}|{row_id}".encode()).hexdigest(), item) for i, item in enumerate(items)]
    return [item for _, item in sorted(keyed)]


def below(seed: int, salt: str, row_id: Column, n: int | Column) -> Column:
    """Whole number in [0, n)."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.floor(uniform(seed, salt, row_id) * n).cast("int")


def between(seed: int, salt: str, row_id: Column, low: int, high: int) -> Column:
    """Whole number in [low, high], both ends included."""
    return below(seed, salt, row_id, high - low + 1) + F.lit(low)


def choice(seed: int, salt: str, row_id: Column, options: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), below(seed, salt, row_id, len(options)) + 1)


def digits(seed: int, salt: str, row_id: Column, n: int) -> Column:
    """``n`` decimal digits with leading zeros, at most 12 from one hash."""
    parts = []
    for block, at in enumerate(range(0, n, 12)):
        size = min(12, n - at)
        number = _hex_int(F.md5(_key(seed, f"{salt}.{block}", row_id)), 1, 15) % (10**size)
        parts.append(F.lpad(number.cast("string"), size, "0"))
    return F.concat(*parts)


def _spell(alphabet: str, size: int):
    def spell(hexes: Column) -> Column:
        return F.concat(*[
            F.substring(F.lit(alphabet), (_hex_int(hexes, 4 * i + 1, 4) % len(alphabet)).cast("int") + 1, F.lit(1))
            for i in range(size)
        ])

    return spell


def symbols(seed: int, salt: str, row_id: Column, n: int | Column, alphabet: str, longest: int | None = None) -> Column:
    """``n`` symbols of ``alphabet``; ``longest`` bounds ``n`` when it is a column. 16 symbols come from one hash."""
    longest = n if isinstance(n, int) else longest
    blocks = []
    for block in range(-(-longest // 16)):
        hashed = F.sha2(_key(seed, f"{salt}.{block}", row_id), 256)
        blocks.append(let(hashed, _spell(alphabet, min(16, longest - 16 * block))))
    drawn = F.concat(*blocks)
    return drawn if isinstance(n, int) else F.substring(drawn, F.lit(1), n)


def permutation(seed: int, salt: str, row_id: Column, items: Sequence[str]) -> Column:
    """The items in an order drawn by hash, as an array."""
    keyed = F.array(*[
        F.struct(F.md5(_key(seed, f"{salt}.{i}", row_id)).alias("k"), F.lit(item).alias("v"))
        for i, item in enumerate(items)
    ])
    return F.transform(F.array_sort(keyed), lambda s: s["v"])


def from_format(seed: int, salt: str, row_id: Column, spec: str) -> Column:
    """Expand a format: D digit, L letter, X letter or digit; any other character stands for itself."""
    parts: list[Column] = []
    at = 0
    while at < len(spec):
        end = at
        while end < len(spec) and spec[end] == spec[at]:
            end += 1
        run, part_salt = spec[at:end], f"{salt}.{at}"
        if run[0] == "D":
            parts.append(digits(seed, part_salt, row_id, len(run)))
        elif run[0] == "L":
            parts.append(symbols(seed, part_salt, row_id, len(run), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        elif run[0] == "X":
            parts.append(symbols(seed, part_salt, row_id, len(run), "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
        else:
            parts.append(F.lit(run))
        at = end
    return F.concat(*parts)
