"""Synthetic values: structurally valid strings per category, drawn from (seed, row id) alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from detectlab.functions import checks as C
from detectlab.functions import draws as D
from detectlab.functions import fixed
from detectlab.functions.text import let

Synth = Callable[[int, Column], Column]
SYNTHS: dict[str, Synth] = {}


def register_synth(category: str) -> Callable[[Synth], Synth]:
    def add(build: Synth) -> Synth:
        SYNTHS[category] = build
        return build

    return add


def synth(category: str, seed: int, row_id: Column) -> Column:
    """A valid value of ``category`` for each row id."""
    if category not in SYNTHS:
        raise ValueError(f"no synthetic values for category {category!r}")
    return SYNTHS[category](seed, row_id)


def synth_column(category: Column, seed: int, row_id: Column, categories: list[str]) -> Column:
    """Valid values for a category column; null where the category has no rule."""
    out = F.lit(None).cast("string")
    for name in categories:
        if name in SYNTHS:
            out = F.when(category == name, synth(name, seed, row_id)).otherwise(out)
    return out


def _pick_of(options: list[tuple[str, Column]], index: Column) -> Column:
    out = options[-1][1]
    for i in range(len(options) - 2, -1, -1):
        out = F.when(index == i, options[i][1]).otherwise(out)
    return out


def grouped(value: Column, *sizes: int, sep: str = " ") -> Column:
    def cut(bound: Column) -> Column:
        starts = [1 + sum(sizes[:i]) for i in range(len(sizes))]
        return F.concat_ws(sep, *[F.substring(bound, at, size) for at, size in zip(starts, sizes)])

    return let(value, cut)


def card_body(seed: int, row_id: Column, prefixes: tuple[tuple[str, int], ...]) -> Column:
    """A card number without its last digit."""
    index = D.below(seed, "card.prefix", row_id, len(prefixes)) + 1
    prefix = F.element_at(F.array(*[F.lit(p) for p, _ in prefixes]), index)
    kept = F.element_at(F.array(*[F.lit(n - 1) for _, n in prefixes]), index)
    return F.substring(F.concat(prefix, D.digits(seed, "card", row_id, 15)), F.lit(1), kept)


@register_synth("credit_card")
def credit_card(seed: int, row_id: Column) -> Column:
    return let(card_body(seed, row_id, fixed.CARD_PREFIXES), lambda b: F.concat(b, C.luhn_digit(b)))


def corpus_card(seed: int, row_id: Column) -> Column:
    """Card numbers of generated corpora, which add two more prefixes."""
    return let(card_body(seed, row_id, fixed.CORPUS_CARD_PREFIXES), lambda b: F.concat(b, C.luhn_digit(b)))


def sin_body(seed: int, row_id: Column) -> Column:
    return F.concat(D.between(seed, "sin.first", row_id, 1, 7).cast("string"), D.digits(seed, "sin", row_id, 7))


@register_synth("sin")
def sin(seed: int, row_id: Column) -> Column:
    whole = let(sin_body(seed, row_id), lambda b: F.concat(b, C.luhn_digit(b)))
    return grouped(whole, 3, 3, 3)


def bban(seed: int, row_id: Column) -> tuple[Column, Column]:
    """Country and account part for GB, DE and FR, drawn alike."""
    country = D.choice(seed, "iban.country", row_id, ("GB", "DE", "FR"))
    bank = F.when(country == "GB", D.symbols(seed, "iban.bank", row_id, 4, fixed.UPPER)).otherwise("")
    kept = F.when(country == "GB", 14).when(country == "DE", 18).otherwise(23)
    return country.alias("col1"), F.concat(bank, F.substring(D.digits(seed, "iban", row_id, 23), F.lit(1), kept)).alias("col2")


@register_synth("iban")
def iban(seed: int, row_id: Column) -> Column:
    return let(F.struct(*bban(seed, row_id)),
               lambda b: F.concat(b["col1"], C.iban_digits(b["col1"], b["col2"]), b["col2"]))


@register_synth("phone")
def phone(seed: int, row_id: Column) -> Column:
    area = D.choice(seed, "phone.area", row_id, [str(a) for a in fixed.CA_AREA_CODES])
    exchange = D.between(seed, "phone.exchange", row_id, 200, 999).cast("string")
    return F.concat_ws("-", F.lit("+1"), area, exchange, D.digits(seed, "phone", row_id, 4))


@register_synth("email")
def email(seed: int, row_id: Column) -> Column:
    first = D.choice(seed, "mail.first", row_id, fixed.FIRST_NAMES)
    last = D.choice(seed, "mail.last", row_id, fixed.LAST_NAMES)
    initial = F.substring(first, 1, 1)
    local = _pick_of([
        ("dot", F.concat(first, F.lit("."), last)), ("underscore", F.concat(first, F.lit("_"), last)),
        ("firstlast", F.concat(initial, last)), ("lastfirst", F.concat(last, initial)),
    ], D.below(seed, "mail.pattern", row_id, 4))
    suffix = F.when(D.uniform(seed, "mail.suffix", row_id) < 0.3,
                    D.between(seed, "mail.number", row_id, 1, 99).cast("string")).otherwise("")
    return F.concat(local, suffix, F.lit("@"), D.choice(seed, "mail.domain", row_id, fixed.MAIL_DOMAINS))


def ramq_name(seed: int, row_id: Column) -> Column:
    odd = D.symbols(seed, "ramq.odd", row_id, 2, fixed.RAMQ_CONSONANTS)
    even = D.symbols(seed, "ramq.even", row_id, 2, fixed.UPPER)
    return F.concat(F.substring(odd, 1, 1), F.substring(even, 1, 1), F.substring(odd, 2, 1), F.substring(even, 2, 1))


def two(number: Column) -> Column:
    return F.lpad(number.cast("string"), 2, "0")


def ramq_value(seed: int, row_id: Column, month: Column) -> Column:
    return F.concat(
        ramq_name(seed, row_id), F.lit(" "), D.digits(seed, "ramq.year", row_id, 2), two(month), F.lit(" "),
        two(D.between(seed, "ramq.day", row_id, 1, 28)), two(D.between(seed, "ramq.seq", row_id, 1, 99)),
    )


@register_synth("ca_ramq")
def ramq(seed: int, row_id: Column) -> Column:
    month = D.between(seed, "ramq.month", row_id, 1, 12)
    month = month + F.when(D.uniform(seed, "ramq.half", row_id) < 0.5, 50).otherwise(0)
    return ramq_value(seed, row_id, month)


for _category, _spec in fixed.FORMAT_SPECS.items():
    SYNTHS[_category] = lambda seed, row_id, c=_category, s=_spec: D.from_format(seed, c, row_id, s)


@register_synth("ca_gst_hst")
def gst_hst(seed: int, row_id: Column) -> Column:
    account = F.lpad(D.between(seed, "gst.account", row_id, 1, 9999).cast("string"), 4, "0")
    return F.concat(D.digits(seed, "gst", row_id, 9), F.lit("RT"), account)


@register_synth("ca_bank_account")
def bank_account(seed: int, row_id: Column) -> Column:
    return F.substring(D.digits(seed, "account", row_id, 12), F.lit(1), D.between(seed, "account.n", row_id, 7, 12))


@register_synth("ssn")
def ssn(seed: int, row_id: Column) -> Column:
    """Areas 1 to 899 without 666, drawn from the valid set by stepping over the gap."""
    area = let(D.between(seed, "ssn.area", row_id, 1, 898), lambda d: d + F.when(d >= 666, 1).otherwise(0))
    serial = D.between(seed, "ssn.serial", row_id, 1, 9999)
    return F.concat_ws("-", F.lpad(area.cast("string"), 3, "0"), two(D.between(seed, "ssn.group", row_id, 1, 99)),
                       F.lpad(serial.cast("string"), 4, "0"))


@register_synth("uk_nin")
def uk_nin(seed: int, row_id: Column) -> Column:
    allowed = [a + b for a in fixed.NIN_FIRST for b in fixed.NIN_SECOND if a + b not in fixed.NIN_DISALLOWED]
    at = D.below(seed, "nin.prefix", row_id, len(allowed)) * 2 + 1
    prefix = F.substring(F.lit("".join(allowed)), at, F.lit(2))
    drawn = D.digits(seed, "nin", row_id, 6)
    return F.concat_ws(" ", prefix, grouped(drawn, 2, 2, 2), D.symbols(seed, "nin.suffix", row_id, 1, fixed.NIN_SUFFIX))


@register_synth("br_cpf")
def br_cpf(seed: int, row_id: Column) -> Column:
    """An all-equal base is reserved; its last digit moves on by one."""
    drawn = D.digits(seed, "cpf", row_id, 9)

    def settle(d: Column) -> Column:
        moved = ((F.substring(d, 9, 1).cast("int") + 1) % 10).cast("string")
        same = d == F.repeat(F.substring(d, 1, 1), 9)
        return F.when(same, F.concat(F.substring(d, 1, 8), moved)).otherwise(d)

    return let(let(drawn, settle),
               lambda b: F.concat(grouped(b, 3, 3, 3, sep="."), F.lit("-"), C.cpf_digits(b)))


@register_synth("au_medicare")
def au_medicare(seed: int, row_id: Column) -> Column:
    base = F.concat(D.between(seed, "medicare.first", row_id, 2, 6).cast("string"),
                    D.digits(seed, "medicare", row_id, 7))
    issue = D.between(seed, "medicare.issue", row_id, 1, 9).cast("string")
    return grouped(let(base, lambda b: F.concat(b, C.medicare_digit(b), issue)), 4, 5, 1)


@register_synth("de_tax_id")
def de_tax_id(seed: int, row_id: Column) -> Column:
    """Nine of the ten digits in drawn order, the first of them twice; a leading zero swaps with the next digit."""
    order = D.permutation(seed, "tax", row_id, list(fixed.DIGITS))
    slots = F.array_sort(F.transform(
        let(order, lambda o: F.concat(F.slice(o, 1, 9), F.slice(o, 1, 1))),
        lambda d, i: F.struct(F.md5(F.concat_ws("|", F.lit(f"{seed}|tax.slot"), row_id.cast("string"),
                                                i.cast("string"))).alias("k"), d.alias("d")),
    ))
    joined = F.array_join(F.transform(slots, lambda s: s["d"]), "")

    def no_leading_zero(j: Column) -> Column:
        swapped = F.concat(F.substring(j, 2, 1), F.lit("0"), F.substring(j, 3, 8))
        rolled = F.concat(F.substring(j, 3, 8), F.lit("00"))
        return F.when(j.startswith("00"), rolled).when(j.startswith("0"), swapped).otherwise(j)

    return let(let(joined, no_leading_zero), lambda b: F.concat(b, C.de_tax_digit(b)))


@register_synth("us_dl")
def us_dl(seed: int, row_id: Column) -> Column:
    formats = list(fixed.US_DL_FORMATS.values())
    distinct = sorted(set(formats))

    def expand(spec: Column) -> Column:
        out = F.lit(None).cast("string")
        for fmt in distinct:
            out = F.when(spec == fmt, D.from_format(seed, "dl", row_id, fmt)).otherwise(out)
        return out

    return let(D.choice(seed, "dl.state", row_id, formats), expand)


@register_synth("cusip_num")
def cusip_num(seed: int, row_id: Column) -> Column:
    base = F.concat(D.choice(seed, "cusip.issuer", row_id, fixed.CUSIP_ISSUERS),
                    D.choice(seed, "cusip.issue", row_id, fixed.CUSIP_ISSUES))
    return let(base, lambda b: F.concat(b, C.cusip_digit(b)))


@register_synth("cins_num")
def cins_num(seed: int, row_id: Column) -> Column:
    base = F.concat(D.symbols(seed, "cins.prefix", row_id, 1, fixed.CINS_PREFIXES), D.digits(seed, "cins", row_id, 5),
                    D.choice(seed, "cins.issue", row_id, fixed.CINS_ISSUES))
    return let(base, lambda b: F.concat(b, C.cusip_digit(b)))


@register_synth("sedol_num")
def sedol_num(seed: int, row_id: Column) -> Column:
    lettered = F.concat(D.symbols(seed, "sedol.first", row_id, 1, fixed.RAMQ_CONSONANTS),
                        D.symbols(seed, "sedol.rest", row_id, 5, fixed.DIGITS + fixed.RAMQ_CONSONANTS))
    base = F.when(D.uniform(seed, "sedol.kind", row_id) < 0.5, D.digits(seed, "sedol", row_id, 6)).otherwise(lettered)
    return let(base, lambda b: F.concat(b, C.sedol_digit(b)))


@register_synth("isin")
def isin(seed: int, row_id: Column) -> Column:
    base = F.concat(D.choice(seed, "isin.country", row_id, fixed.ISIN_COUNTRIES),
                    D.symbols(seed, "isin", row_id, 9, fixed.ISIN_BODY))
    return let(base, lambda b: F.concat(b, C.isin_digit(b)))


@register_synth("figi_num")
def figi_num(seed: int, row_id: Column) -> Column:
    base = F.concat(F.lit("BBG"), D.symbols(seed, "figi", row_id, 8, fixed.FIGI_BODY))
    return let(base, lambda b: F.concat(b, C.figi_digit(b)))


@register_synth("lei_num")
def lei_num(seed: int, row_id: Column) -> Column:
    alphabet = fixed.DIGITS + fixed.UPPER
    base = F.concat(D.symbols(seed, "lei.lou", row_id, 4, alphabet), F.lit("00"),
                    D.symbols(seed, "lei", row_id, 12, alphabet))
    return let(base, lambda b: F.concat(b, C.lei_digits(b)))


@register_synth("ticker_symbol")
def ticker_symbol(seed: int, row_id: Column) -> Column:
    return D.choice(seed, "ticker", row_id, fixed.TICKERS)


@register_synth("reuters_ric")
def reuters_ric(seed: int, row_id: Column) -> Column:
    return D.choice(seed, "ric", row_id, fixed.RICS)


@register_synth("valor_num")
def valor_num(seed: int, row_id: Column) -> Column:
    return D.between(seed, "valor", row_id, 1_000_000, 59_999_999).cast("string")


@register_synth("mt103_ref")
def mt103_ref(seed: int, row_id: Column) -> Column:
    return D.symbols(seed, "mt103", row_id, D.between(seed, "mt103.n", row_id, 12, 16), fixed.UPPER + fixed.DIGITS, 16)


@register_synth("mifid_tx_id")
def mifid_tx_id(seed: int, row_id: Column) -> Column:
    return D.symbols(seed, "mifid", row_id, D.between(seed, "mifid.n", row_id, 30, 52), fixed.UPPER + fixed.DIGITS, 52)
