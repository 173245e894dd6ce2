"""Values that look right and are wrong, for false-positive measurement, and the rules that count them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from detectlab.functions import checks as C
from detectlab.functions import draws as D
from detectlab.functions import fixed
from detectlab.functions import synth as S
from detectlab.functions.text import let


def _shifted_digit(seed: int, row_id: Column, right: Column) -> Column:
    """A digit other than ``right``: 1 to 8 further on."""
    return ((right.cast("int") + D.between(seed, "near.shift", row_id, 1, 8)) % 10).cast("string")


def near_card(seed: int, row_id: Column) -> Column:
    """16 digits under every prefix, so the 37 numbers are one digit longer than real ones."""
    body = S.card_body(seed, row_id, tuple((p, 16) for p in fixed.NEAR_CARD_PREFIXES))
    return let(body, lambda b: F.concat(b, _shifted_digit(seed, row_id, C.luhn_digit(b))))


def near_ssn(seed: int, row_id: Column) -> Column:
    """Areas 000, 666 and 900 to 999, 102 of them."""
    area = let(D.below(seed, "near.area", row_id, 102),
               lambda at: F.when(at == 0, "000").when(at == 1, "666").otherwise((at + 898).cast("string")))
    return F.concat_ws("-", area, D.digits(seed, "near.ssn.group", row_id, 2), D.digits(seed, "near.ssn", row_id, 4))


def near_sin(seed: int, row_id: Column) -> Column:
    whole = let(S.sin_body(seed, row_id), lambda b: F.concat(b, _shifted_digit(seed, row_id, C.luhn_digit(b))))
    return S.grouped(whole, 3, 3, 3)


def near_iban(seed: int, row_id: Column) -> Column:
    shift = D.between(seed, "near.iban", row_id, 1, 96)

    def spoil(b: Column) -> Column:
        wrong = (C.iban_digits(b["col1"], b["col2"]).cast("int") % 97 + shift) % 97
        return F.concat(b["col1"], S.two(wrong), b["col2"])

    return let(F.struct(*S.bban(seed, row_id)), spoil)


def near_email(seed: int, row_id: Column) -> Column:
    user = D.symbols(seed, "near.user", row_id, D.between(seed, "near.user.n", row_id, 4, 10),
                     fixed.UPPER.lower() + fixed.DIGITS, 10)
    return F.concat(user, F.lit("@"), D.choice(seed, "near.domain", row_id, fixed.NEAR_MAIL_DOMAINS),
                    D.choice(seed, "near.tld", row_id, fixed.RESERVED_TLDS))


def near_phone(seed: int, row_id: Column) -> Column:
    return F.concat_ws("-", F.lit("+1"), D.choice(seed, "near.code", row_id, fixed.NEAR_AREA_CODES),
                       D.between(seed, "near.exchange", row_id, 200, 999).cast("string"),
                       D.digits(seed, "near.phone", row_id, 4))


def near_ramq(seed: int, row_id: Column) -> Column:
    """Months 0, 13 to 50 and 63 to 99, 76 of them."""
    month = let(D.below(seed, "near.month", row_id, 76),
                lambda at: F.when(at == 0, 0).when(at <= 38, at + 12).otherwise(at + 24))
    return S.ramq_value(seed, row_id, month)


def near_entropy(seed: int, row_id: Column) -> Column:
    """Runs of four letters, UUIDs, hashes of common words, base64 of plain words."""
    letters = D.permutation(seed, "near.letters", row_id, list(fixed.UPPER.lower()))
    run = D.between(seed, "near.run", row_id, 4, 8)
    runs = F.array_join(F.transform(F.slice(letters, 1, 4), lambda c: F.repeat(c, run)), "")
    uuid = S.grouped(D.symbols(seed, "near.uuid", row_id, 32, "0123456789abcdef"), 8, 4, 4, 4, 12, sep="-")
    kind = D.below(seed, "near.kind", row_id, 4)
    return (
        F.when(kind == 0, runs).when(kind == 1, uuid)
        .when(kind == 2, D.choice(seed, "near.hash", row_id, fixed.KNOWN_HASHES))
        .otherwise(D.choice(seed, "near.base64", row_id, fixed.KNOWN_BASE64))
    )


NEAR_MISSES: dict[str, Callable[[int, Column], Column]] = {
    "credit_card": near_card, "ssn": near_ssn, "sin": near_sin, "iban": near_iban, "email": near_email,
    "phone": near_phone, "ca_ramq": near_ramq, "entropy": near_entropy,
}


def near_miss(category: str, seed: int, row_id: Column) -> Column:
    if category not in NEAR_MISSES:
        raise ValueError(f"no near-miss values for category {category!r}")
    return NEAR_MISSES[category](seed, row_id)


def wrap_in_context(category: Column, value: Column) -> Column:
    """The value inside its category's sentence, or the general sentence."""
    template = F.lit(fixed.WRAP_FALLBACK)
    for name, text in fixed.WRAP_TEMPLATES.items():
        template = F.when(category == name, text).otherwise(template)
    return F.replace(template, F.lit("{value}"), value)


def is_relevant(category: Column, sub_label: Column, label: Column) -> Column:
    """Whether a detector's match counts for the tested category; a category without a label set counts every match."""
    sub, main = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (sub_label, label))
    out = F.lit(True)
    for name, labels in fixed.RELEVANT_LABELS.items():
        out = F.when(category == name, sub.isin(*labels) | main.isin(*labels)).otherwise(out)
    return out
