"""Shannon entropy of strings and the token scan built on it."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from detectlab.functions import fixed
from detectlab.functions.text import chars, let


#: Lengths up to which logarithms of shares are looked up.
EXACT_LENGTH = 128


def log2_of_share(count: Column, n: Column) -> Column:
    """log2(count / n). The built-in divides two rounded logarithms, so its last bit can be off, and an entropy of exactly the threshold
    would fall on either side of it; for short texts the logarithm is one of a constant table, rounded once."""
    table = F.split(F.lit(",".join(repr(math.log2(c / m)) for m in range(1, EXACT_LENGTH + 1) for c in range(1, m + 1))), ",").cast("array<double>")
    place = F.floor(n * (n - 1) / 2).cast("int") + count - 1
    return F.when(n <= EXACT_LENGTH, F.get(table, place)).otherwise(F.log2(count / n))


def shannon(value: Column) -> Column:
    """Bits per character; 0 for the empty string. Characters are counted by removing them, so nothing is shuffled."""
    def bits(v: Column) -> Column:
        n = F.length(v)
        return F.aggregate(
            F.array_sort(F.array_distinct(chars(v))), F.lit(0.0),
            lambda acc, c: acc + let(
                n - F.length(F.replace(v, c, F.lit(""))), lambda k: -(k / n) * log2_of_share(k, n)),
        )

    return F.when(value == "", 0.0).otherwise(let(value, bits))


def tokens(text: Column, min_length: int = fixed.ENTROPY_MIN_LENGTH) -> Column:
    """Runs between delimiters that are long enough to hold a secret."""
    return F.filter(F.split(text, fixed.ENTROPY_DELIMITERS), lambda t: F.length(t) >= min_length)


def core_token(value: Column) -> Column:
    """What follows the first ``=``, else ``: ``, else ``:``; the value itself when nothing follows."""
    def after(sep: str) -> Column:
        tail = F.trim(F.substring(value, F.instr(value, sep) + len(sep), F.length(value)))
        return F.when(F.instr(value, sep) > 0, F.nullif(tail, F.lit("")))

    return F.coalesce(after("="), after(": "), after(":"), value)
