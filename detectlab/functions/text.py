"""Small string building blocks shared by the transforms, checks and detectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for use inside ``body`` (lambda bodies are not shared by the optimiser)."""
    return F.transform(F.array(value), body)[0]


def chars(value: Column) -> Column:
    """Code points of a string. An empty string gives one empty element."""
    return F.split(value, "")


def between(value: Column, sep: str) -> Column:
    """``sep`` placed between every two characters."""
    return F.array_join(chars(value), sep)


def alnum(value: Column) -> Column:
    return F.regexp_replace(value, "[^A-Za-z0-9]", "")


def chunks(value: Column, size: int) -> Column:
    return F.regexp_extract_all(value, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def half(value: Column) -> Column:
    """Length of the first half, in characters."""
    return F.floor(F.length(value) / 2).cast("int")


def first_half(value: Column) -> Column:
    return F.substring(value, F.lit(1), half(value))


def last_half(value: Column) -> Column:
    return F.substring(value, half(value) + 1, F.length(value))


def digits_only(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def char_value(char: Column) -> Column:
    """Digit value; letters count A=10 to Z=35; ``*@#`` count 36 to 38; anything else 0."""
    return F.when(char == "", 0).otherwise(
        F.greatest(F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ*@#"), F.upper(char)) - 1, F.lit(0))
    )


def starts_in_order(text: Column, pieces: Column, matches: Column) -> Column:
    """1-based start of each match, from the pieces between matches (``split`` on the same pattern)."""
    seed = F.struct(F.lit(1).alias("at"), F.expr("cast(array() as array<int>)").alias("starts"))
    walked = F.aggregate(
        F.arrays_zip(
            F.transform(F.slice(pieces, 1, F.size(matches)), F.length).alias("gap"),
            F.transform(matches, F.length).alias("width"),
        ),
        seed,
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["width"]).alias("at"),
            F.array_append(acc["starts"], acc["at"] + x["gap"]).alias("starts"),
        ),
        lambda acc: acc["starts"],
    )
    return walked
