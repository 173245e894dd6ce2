"""Check digits and validity predicates as columns.

Check digits of Luhn form are found by trying the built-in ``luhn_check`` on the ten candidates, which stays inside
generated code; weighted sums are written as plain arithmetic over fixed positions for the same reason.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from detectlab.functions import fixed
from detectlab.functions.text import char_value, chars, digits_only, let


def luhn_valid(value: Column) -> Column:
    """Digits only, else false."""
    return F.coalesce(value.rlike("^[0-9]+$") & F.call_function("luhn_check", value), F.lit(False))


def luhn_digit(body: Column) -> Column:
    """The digit that completes ``body`` to a number that passes."""

    def search(bound: Column) -> Column:
        found = F.lit("9")
        for digit in "876543210":
            found = F.when(F.call_function("luhn_check", F.concat(bound, F.lit(digit))), digit).otherwise(found)
        return found

    return let(body, search)


def _weighted(body: Column, total: Callable[[Column], Column]) -> Column:
    """A check digit from a sum over fixed positions of ``body``, bound once."""
    return let(body, total)


def mod97(value: Column) -> Column:
    """Remainder modulo 97 of an alphanumeric string, letters counting 10 to 35; no big integers.

    Up to 36 letters and digits are spelt out and divided in pieces of 14 digits; anything else goes character by character.
    """
    def by_character(text: Column) -> Column:
        return F.aggregate(
            chars(text),
            F.lit(0),
            lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + char_value(c)) % 97).otherwise(
                (acc * 100 + char_value(c)) % 97
            ),
        )

    def in_pieces(digits: Column) -> Column:
        rest = F.lit("")
        for at in range(1, 72, 14):
            rest = (F.concat(rest, F.substring(digits, at, 14)).cast("bigint") % 97).cast("string")
        return rest.cast("int")

    def spelt(text: Column) -> Column:
        out = text
        for i in range(26):
            out = F.replace(out, F.lit(chr(65 + i)), F.lit(str(10 + i)))
        return F.when(text.rlike("[A-Z]"), out).otherwise(text)

    return let(F.upper(value), lambda text: F.when(text.rlike(r"\A[0-9A-Z]{1,36}\z"), let(spelt(text), in_pieces)).otherwise(by_character(text)))


def mod97_digits(body: Column) -> Column:
    """Two check digits for ``body`` (already followed by the country where the scheme asks for it)."""
    return F.lpad((F.lit(98) - mod97(F.concat(body, F.lit("00")))).cast("string"), 2, "0")


def iban_digits(country: Column, bban: Column) -> Column:
    return mod97_digits(F.concat(bban, country))


def iban_valid(value: Column) -> Column:
    bare = F.upper(F.replace(value, F.lit(" "), F.lit("")))
    rotated = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))
    return F.coalesce((F.length(bare) >= 5) & bare.rlike("^[0-9A-Z]+$") & (mod97(rotated) == 1), F.lit(False))


def sin_valid(value: Column) -> Column:
    bare = F.translate(value, " -", "")
    return F.coalesce((F.length(bare) == 9) & luhn_valid(bare), F.lit(False))


def _at(value: Column, position: int) -> Column:
    return char_value(F.substring(value, position, 1))


def _complement(total: Column) -> Column:
    return ((F.lit(10) - total % 10) % 10).cast("int").cast("string")


def _tens_and_units(value: Column) -> Column:
    return F.floor(value / 10) + value % 10


def cusip_digit(base8: Column) -> Column:
    return _weighted(base8, lambda b: _complement(
        sum((_tens_and_units(_at(b, i + 1) * (2 if i % 2 else 1)) for i in range(8)), F.lit(0))))


def sedol_digit(base6: Column) -> Column:
    return _weighted(base6, lambda b: _complement(
        sum((_at(b, i + 1) * w for i, w in enumerate(fixed.SEDOL_WEIGHTS)), F.lit(0))))


def spelled_out(value: Column) -> Column:
    """Letters replaced by their two-digit values."""
    return F.array_join(F.transform(chars(F.upper(value)), lambda c: char_value(c).cast("string")), "")


def isin_digit(base11: Column) -> Column:
    return luhn_digit(spelled_out(base11))


def figi_digit(base11: Column) -> Column:
    """Same rule as the ISIN digit."""
    return luhn_digit(spelled_out(base11))


def lei_digits(base18: Column) -> Column:
    return mod97_digits(base18)


def _last_is(value: Column, n: int, shape: str, digit: Column) -> Column:
    return F.coalesce(value.rlike(shape) & (F.substring(value, n + 1, 2) == digit), F.lit(False))


def cusip_valid(value: Column) -> Column:
    return _last_is(value, 8, "^[0-9A-Z*@#]{8}[0-9]$", cusip_digit(F.substring(value, 1, 8)))


def sedol_valid(value: Column) -> Column:
    return _last_is(value, 6, "^[0-9B-DF-HJ-NP-TV-Z]{6}[0-9]$", sedol_digit(F.substring(value, 1, 6)))


def isin_valid(value: Column) -> Column:
    return _last_is(value, 11, "^[A-Z]{2}[0-9A-Z]{9}[0-9]$", isin_digit(F.substring(value, 1, 11)))


def figi_valid(value: Column) -> Column:
    return _last_is(value, 11, "^BBG[0-9B-DF-HJ-NP-TV-Z]{8}[0-9]$", figi_digit(F.substring(value, 1, 11)))


def lei_valid(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9A-Z]{18}[0-9]{2}$") & (mod97(value) == 1), F.lit(False))


def _cpf_digit(digits: Column, n: int) -> Column:
    def total(b: Column) -> Column:
        return sum((F.substring(b, i + 1, 1).cast("int") * (n + 1 - i) for i in range(n)), F.lit(0)) % 11

    return let(_weighted(digits, total), lambda rest: F.when(rest < 2, 0).otherwise(F.lit(11) - rest).cast("string"))


def cpf_digits(base9: Column) -> Column:
    with_first = let(base9, lambda b: F.concat(b, _cpf_digit(b, 9)))
    return let(with_first, lambda b: F.concat(F.substring(b, 10, 1), _cpf_digit(b, 10)))


def cpf_valid(value: Column) -> Column:
    bare = digits_only(value)
    base = F.substring(bare, 1, 9)
    same = base == F.repeat(F.substring(base, 1, 1), 9)
    return F.coalesce((F.length(bare) == 11) & ~same & (F.substring(bare, 10, 2) == cpf_digits(base)), F.lit(False))


def de_tax_digit(base10: Column) -> Column:
    """ISO 7064 MOD 11,10."""

    def step(product: Column, char: Column) -> Column:
        return let((product + char.cast("int")) % 10, lambda r: F.when(r == 0, 20).otherwise(r * 2) % 11)

    product = F.aggregate(chars(base10), F.lit(10), step)
    return ((F.lit(11) - product) % 10).cast("int").cast("string")


def de_tax_valid(value: Column) -> Column:
    """First ten digits: no leading zero, one digit two or three times, every other digit at most once."""
    bare = F.translate(value, " ", "")
    distinct = F.lit(0)
    for d in fixed.DIGITS:
        distinct = distinct + F.when(F.instr(F.substring(bare, 1, 10), d) > 0, 1).otherwise(0)
    repeated = F.lit(0)
    for d in fixed.DIGITS:
        without = F.length(F.translate(F.substring(bare, 1, 10), d, ""))
        repeated = repeated + F.when(without < 9, 1).otherwise(0)
    return F.coalesce(
        bare.rlike("^[1-9][0-9]{10}$") & (repeated == 1) & distinct.isin(8, 9)
        & (F.substring(bare, 11, 1) == de_tax_digit(F.substring(bare, 1, 10))),
        F.lit(False),
    )


def medicare_digit(base8: Column) -> Column:
    return _weighted(base8, lambda b: (
        sum((F.substring(b, i + 1, 1).cast("int") * w for i, w in enumerate(fixed.MEDICARE_WEIGHTS)), F.lit(0)) % 10
    ).cast("string"))


def medicare_valid(value: Column) -> Column:
    bare = F.translate(value, " ", "")
    return F.coalesce(
        bare.rlike("^[2-6][0-9]{8}[1-9]$") & (F.substring(bare, 9, 1) == medicare_digit(F.substring(bare, 1, 8))),
        F.lit(False),
    )


def ssn_valid(value: Column) -> Column:
    area = F.substring(value, 1, 3).try_cast("int")
    return F.coalesce(
        value.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$") & area.between(1, 899) & (area != 666)
        & (F.substring(value, 5, 2) != "00") & (F.substring(value, 8, 4) != "0000"),
        F.lit(False),
    )


def nin_valid(value: Column) -> Column:
    bare = F.translate(value, " ", "")
    shape = f"^[{fixed.NIN_FIRST}][{fixed.NIN_SECOND}][0-9]{{6}}[{fixed.NIN_SUFFIX}]$"
    return F.coalesce(bare.rlike(shape) & ~F.substring(bare, 1, 2).isin(*fixed.NIN_DISALLOWED), F.lit(False))


def ramq_valid(value: Column) -> Column:
    bare = F.translate(value, " ", "")
    month = F.substring(bare, 7, 2).try_cast("int")
    return F.coalesce(
        bare.rlike("^[A-Z]{4}[0-9]{8}$") & (month.between(1, 12) | month.between(51, 62)), F.lit(False)
    )
