"""Reversible text encodings as columns, and the decoders that undo them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from detectlab.functions import fixed
from detectlab.functions.text import chars

_LOWER = fixed.UPPER.lower()
_ROT_FROM = fixed.UPPER + _LOWER
_ROT_TO = fixed.UPPER[13:] + fixed.UPPER[:13] + _LOWER[13:] + _LOWER[:13]


def utf8(value: Column) -> Column:
    return F.encode(value, "UTF-8")


def base64(value: Column) -> Column:
    """One line, unlike the built-in, which breaks lines at 76 characters."""
    return F.translate(F.base64(utf8(value)), "\r\n", "")


def hex_lower(value: Column) -> Column:
    return F.lower(F.hex(utf8(value)))


def rot13(value: Column) -> Column:
    return F.translate(value, _ROT_FROM, _ROT_TO)


def percent(value: Column, mark: str = "%") -> Column:
    """Every UTF-8 byte as a percent escape."""
    return F.regexp_replace(F.hex(utf8(value)), "(..)", f"{mark}$1")


def percent_digits(value: Column, mark: str = "%") -> Column:
    """Only the digits escaped; a digit's byte is 3 followed by the digit."""
    return F.regexp_replace(value, "([0-9])", f"{mark}3$1")


def base32(value: Column, alphabet: str = fixed.BASE32) -> Column:
    """RFC 4648: each run of 5 bytes is read as one 40-bit number and written as eight symbols."""
    hexes = F.hex(utf8(value))
    symbols = F.transform(
        F.regexp_extract_all(hexes, F.lit("(.{1,10})"), F.lit(1)),
        lambda chunk: F.concat(*[
            F.substring(
                F.lit(alphabet),
                F.shiftright(F.conv(F.rpad(chunk, 10, "0"), 16, 10).cast("bigint"), 35 - 5 * k)
                .bitwiseAND(F.lit(31)).cast("int") + 1,
                F.lit(1),
            )
            for k in range(8)
        ]),
    )
    kept = F.ceil(F.octet_length(value) * 8 / 5).cast("int")
    body = F.substring(F.array_join(symbols, ""), F.lit(1), kept)
    return F.rpad(body, (F.ceil(kept / 8) * 8).cast("int"), F.lit("="))


def unbase32(value: Column) -> Column:
    """Inverse of :func:`base32` for any case and padding; null when it is not base32."""
    bare = F.upper(F.rtrim(value, F.lit("=")))
    hexes = F.array_join(
        F.transform(
            F.regexp_extract_all(bare, F.lit("(.{1,8})"), F.lit(1)),
            lambda chunk: F.lpad(
                F.conv(
                    F.aggregate(
                        chars(F.rpad(chunk, 8, "A")),
                        F.lit(0).cast("bigint"),
                        lambda acc, c: acc * 32 + (F.instr(F.lit(fixed.BASE32), c) - 1),
                    ).cast("string"), 10, 16,
                ), 10, "0",
            ),
        ), "",
    )
    whole_bytes = F.floor(F.length(bare) * 5 / 8).cast("int")
    return F.when(
        bare.rlike("^[A-Z2-7]{2,}$"),
        bytes_text(F.try_to_binary(F.substring(hexes, F.lit(1), whole_bytes * 2), F.lit("hex"))),
    )


def unbase32_hex(value: Column) -> Column:
    """The same for the alphabet of digits first."""
    bare = F.upper(F.rtrim(value, F.lit("=")))
    return F.when(bare.rlike("^[0-9A-V]{2,}$"), unbase32(F.translate(bare, fixed.BASE32_HEX, fixed.BASE32)))


def bytes_text(value: Column) -> Column:
    """Bytes as UTF-8 text, null when they are not valid UTF-8."""
    return F.try_validate_utf8(value.cast("string"))


def unbase64(value: Column) -> Column:
    """Standard and URL-safe alphabets, with or without padding or line breaks; null when it is not base64."""
    bare = F.translate(F.translate(value, "-_", "+/"), "\r\n=", "")
    padded = F.concat(bare, F.element_at(F.array(F.lit(""), F.lit(""), F.lit("=="), F.lit("=")),
                                         (F.length(bare) % 4 + 1).cast("int")))
    return F.when(
        bare.rlike("^[A-Za-z0-9+/]{2,}$") & (F.length(bare) % 4 != 1),
        bytes_text(F.try_to_binary(padded, F.lit("base64"))),
    )


def unhex(value: Column) -> Column:
    """Bare, spaced, ``\\x`` escaped and 0x forms; null when it is not hex."""
    bare = F.regexp_replace(F.regexp_replace(value, "^0x", ""), r"\\x| ", "")
    return F.when(
        bare.rlike("^([0-9A-Fa-f]{2})+$"), bytes_text(F.try_to_binary(bare, F.lit("hex")))
    )


def unpercent(value: Column) -> Column:
    """Percent escapes decoded, ``+`` kept; the text itself when an escape is broken."""
    return F.coalesce(F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B"))), value)
