"""Queries for check digits, synthetic values and near-misses."""

from __future__ import annotations

from pyspark.sql import functions as F

from detectlab.functions import checks as C
from detectlab.functions import fixed
from detectlab.functions.nearmiss import NEAR_MISSES, is_relevant, wrap_in_context
from detectlab.functions.synth import SYNTHS
from detectlab.operators.corpus import near_miss_corpus, synthetic_values
from detectlab.plans import sqlref as S
from detectlab.plans.registry import query
from detectlab.session import read_table, spread

SEED = 42


def _keyed(spark, sf_dir):
    return spread(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"))


PAD = "lpad(CAST({k} AS VARCHAR), {n}, '0')"


def _pad(n, k="o_orderkey"):
    return PAD.format(k=k, n=n)


def _padded(n, key="o_orderkey"):
    return F.lpad(F.col(key).cast("string"), n, "0")




@query("check_luhn", f"SELECT o_orderkey, {S.luhn_valid(_pad(16))} AS valid, {S.luhn_digit(_pad(16))} AS digit FROM orders")
def check_luhn(spark, sf_dir):
    v = _padded(16)
    return _keyed(spark, sf_dir).select("o_orderkey", C.luhn_valid(v).alias("valid"), C.luhn_digit(v).alias("digit"))


_IBAN = f"('GB' || lpad(CAST(o_orderkey % 97 AS VARCHAR), 2, '0') || 'WEST' || {_pad(14)})"


_IBAN_TAIL = f"('WEST' || {_pad(14)} || 'GB')"


@query("check_iban", f"SELECT o_orderkey, {S.iban_valid(_IBAN)} AS valid, "
                     f"{S.mod97_digits(_IBAN_TAIL)} AS digits FROM orders")
def check_iban(spark, sf_dir):
    tail = F.concat(F.lit("WEST"), _padded(14))
    value = F.concat(F.lit("GB"), F.lpad((F.col("o_orderkey") % 97).cast("string"), 2, "0"), tail)
    return _keyed(spark, sf_dir).select("o_orderkey", C.iban_valid(value).alias("valid"),
                                        C.iban_digits(F.lit("GB"), tail).alias("digits"))


_SIN = f"(substr({_pad(9)}, 1, 3) || '-' || substr({_pad(9)}, 4))"


@query("check_sin", f"SELECT o_orderkey, {S.sin_valid(_SIN)} AS valid FROM orders")
def check_sin(spark, sf_dir):
    v = _padded(9)
    return _keyed(spark, sf_dir).select("o_orderkey", C.sin_valid(
        F.concat(F.substring(v, 1, 3), F.lit("-"), F.substring(v, 4, 6))).alias("valid"))


_BASE8 = f"(substr('ABCDEFGHJK', CAST(o_orderkey % 10 AS INT) + 1, 1) || {_pad(7)})"


def _base8():
    return F.concat(F.substring(F.lit("ABCDEFGHJK"), (F.col("o_orderkey") % 10).cast("int") + 1, F.lit(1)), _padded(7))


@query("check_cusip", f"SELECT o_orderkey, {S.cusip_digit(_BASE8)} AS digit, "
                      f"{S.cusip_digit(_BASE8)} = CAST(o_custkey % 10 AS VARCHAR) AS valid FROM orders")
def check_cusip(spark, sf_dir):
    whole = F.concat(_base8(), (F.col("o_custkey") % 10).cast("string"))
    return _keyed(spark, sf_dir).select("o_orderkey", C.cusip_digit(_base8()).alias("digit"), C.cusip_valid(whole).alias("valid"))


_BASE6 = f"('B' || {_pad(5, 'o_orderkey % 100000')})"


@query("check_sedol", f"SELECT o_orderkey, {S.sedol_digit(_BASE6)} AS digit, "
                      f"{S.sedol_digit(_BASE6)} = CAST(o_custkey % 10 AS VARCHAR) AS valid FROM orders")
def check_sedol(spark, sf_dir):
    base = F.concat(F.lit("B"), F.lpad((F.col("o_orderkey") % 100000).cast("string"), 5, "0"))
    whole = F.concat(base, (F.col("o_custkey") % 10).cast("string"))
    return _keyed(spark, sf_dir).select("o_orderkey", C.sedol_digit(base).alias("digit"), C.sedol_valid(whole).alias("valid"))


_ISIN = f"('US' || substr('ABCDEFGHJK', CAST(o_orderkey % 10 AS INT) + 1, 1) || {_pad(8)})"
_FIGI = f"('BBG' || 'C' || {_pad(7)})"


@query("check_isin", f"SELECT o_orderkey, {S.isin_digit(_ISIN)} AS digit, "
                     f"{S.isin_digit(_ISIN)} = CAST(o_custkey % 10 AS VARCHAR) AS valid FROM orders")
def check_isin(spark, sf_dir):
    base = F.concat(F.lit("US"), F.substring(F.lit("ABCDEFGHJK"), (F.col("o_orderkey") % 10).cast("int") + 1, F.lit(1)), _padded(8))
    whole = F.concat(base, (F.col("o_custkey") % 10).cast("string"))
    return _keyed(spark, sf_dir).select("o_orderkey", C.isin_digit(base).alias("digit"), C.isin_valid(whole).alias("valid"))


@query("check_figi", f"SELECT o_orderkey, {S.isin_digit(_FIGI)} AS digit, "
                     f"{S.isin_digit(_FIGI)} = CAST(o_custkey % 10 AS VARCHAR) AS valid FROM orders")
def check_figi(spark, sf_dir):
    base = F.concat(F.lit("BBGC"), _padded(7))
    whole = F.concat(base, (F.col("o_custkey") % 10).cast("string"))
    return _keyed(spark, sf_dir).select("o_orderkey", C.figi_digit(base).alias("digit"), C.figi_valid(whole).alias("valid"))


_LEI = f"('HWUP00' || {_pad(12)})"


_LEI_WHOLE = f"({_LEI} || {_pad(2, 'o_custkey % 97')})"


@query("check_lei", f"SELECT o_orderkey, {S.mod97_digits(_LEI)} AS digits, "
                    f"{S.mod97(_LEI_WHOLE)} = 1 AS valid FROM orders")
def check_lei(spark, sf_dir):
    base = F.concat(F.lit("HWUP00"), _padded(12))
    whole = F.concat(base, F.lpad((F.col("o_custkey") % 97).cast("string"), 2, "0"))
    return _keyed(spark, sf_dir).select("o_orderkey", C.lei_digits(base).alias("digits"), C.lei_valid(whole).alias("valid"))


_CPF9 = _pad(9)
_CPF1 = S.cpf_digit(_CPF9, 9)
_CPF2 = S.cpf_digit("(b || d1)", 10)


@query("check_cpf",
       f"SELECT o_orderkey, d1 || {_CPF2} AS digits, (d1 || {_CPF2} = lpad(CAST(o_custkey % 100 AS VARCHAR), 2, '0') AND "
       f"b <> repeat(substr(b, 1, 1), 9)) AS valid FROM (SELECT o_orderkey, o_custkey, {_CPF9} AS b, {_CPF1} AS d1 FROM orders)")
def check_cpf(spark, sf_dir):
    base = _padded(9)
    whole = F.concat(base, F.lpad((F.col("o_custkey") % 100).cast("string"), 2, "0"))
    return _keyed(spark, sf_dir).select("o_orderkey", C.cpf_digits(base).alias("digits"), C.cpf_valid(whole).alias("valid"))


_TAX10 = f"('123456' || {_pad(4, 'o_orderkey % 10000')})"
_TAX_SHAPE = (f"len(list_filter(range(0, 10), lambda d: length(replace({_TAX10}, CAST(d AS VARCHAR), '')) < 9)) = 1 "
              f"AND len(list_distinct(string_split({_TAX10}, ''))) IN (8, 9)")


@query("check_de_tax_id",
       f"SELECT o_orderkey, {S.de_tax_digit(_TAX10)} AS digit, ({_TAX_SHAPE} AND {S.de_tax_digit(_TAX10)} = "
       f"CAST(o_custkey % 10 AS VARCHAR)) AS valid FROM orders")
def check_de_tax_id(spark, sf_dir):
    base = F.concat(F.lit("123456"), F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0"))
    whole = F.concat(base, (F.col("o_custkey") % 10).cast("string"))
    return _keyed(spark, sf_dir).select("o_orderkey", C.de_tax_digit(base).alias("digit"), C.de_tax_valid(whole).alias("valid"))


_MED8 = f"(CAST(o_orderkey % 9 AS VARCHAR) || {_pad(7)})"


@query("check_medicare",
       f"SELECT o_orderkey, {S.medicare_digit(_MED8)} AS digit, (substr({_MED8}, 1, 1) IN ('2', '3', '4', '5', '6') AND "
       f"{S.medicare_digit(_MED8)} = CAST(o_custkey % 10 AS VARCHAR)) AS valid FROM orders")
def check_medicare(spark, sf_dir):
    base = F.concat((F.col("o_orderkey") % 9).cast("string"), _padded(7))
    whole = F.concat(base, (F.col("o_custkey") % 10).cast("string"), F.lit("1"))
    return _keyed(spark, sf_dir).select("o_orderkey", C.medicare_digit(base).alias("digit"), C.medicare_valid(whole).alias("valid"))


_SSN = f"({_pad(3, 'o_orderkey % 1000')} || '-' || {_pad(2, 'o_custkey % 100')} || '-' || {_pad(4, 'o_orderkey % 10000')})"


@query("check_ssn", f"SELECT o_orderkey, {S.ssn_valid(_SSN)} AS valid FROM orders")
def check_ssn(spark, sf_dir):
    pad = lambda c, m, n: F.lpad((F.col(c) % m).cast("string"), n, "0")
    v = F.concat_ws("-", pad("o_orderkey", 1000, 3), pad("o_custkey", 100, 2), pad("o_orderkey", 10000, 4))
    return _keyed(spark, sf_dir).select("o_orderkey", C.ssn_valid(v).alias("valid"))


_NIN = (f"(substr('{fixed.UPPER}', CAST(o_orderkey % 26 AS INT) + 1, 1) || substr('{fixed.UPPER}', CAST(o_custkey % 26 AS INT) + 1, 1) "
        f"|| {_pad(6)} || substr('ABCDE', CAST(o_orderkey % 5 AS INT) + 1, 1))")


@query("check_nin", f"SELECT o_orderkey, (regexp_full_match({_NIN}, '[{fixed.NIN_FIRST}][{fixed.NIN_SECOND}][0-9]{{6}}[ABCD]') AND "
                    f"substr({_NIN}, 1, 2) NOT IN {S.in_list(fixed.NIN_DISALLOWED)}) AS valid FROM orders")
def check_nin(spark, sf_dir):
    letter = lambda c, m, a: F.substring(F.lit(a), (F.col(c) % m).cast("int") + 1, F.lit(1))
    v = F.concat(letter("o_orderkey", 26, fixed.UPPER), letter("o_custkey", 26, fixed.UPPER), _padded(6),
                 letter("o_orderkey", 5, "ABCDE"))
    return _keyed(spark, sf_dir).select("o_orderkey", C.nin_valid(v).alias("valid"))


@query("check_ramq", f"SELECT o_orderkey, (o_orderkey % 100 BETWEEN 1 AND 12 OR o_orderkey % 100 BETWEEN 51 AND 62) AS valid FROM orders")
def check_ramq(spark, sf_dir):
    month = F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0")
    v = F.concat(F.lit("BOUD 12"), month, F.lit(" 0101"))
    return _keyed(spark, sf_dir).select("o_orderkey", C.ramq_valid(v).alias("valid"))


# --- synthetic values -------------------------------------------------------------------------------------------------

ID = "c_custkey"


def _card_body(prefixes) -> str:
    at = f"{S.below(SEED, 'card.prefix', ID, len(prefixes))} + 1"
    return (f"substr(({S.array([p for p, _ in prefixes])})[{at}] || {S.digits(SEED, 'card', ID, 15)}, 1, "
            f"([{', '.join(str(n - 1) for _, n in prefixes)}])[{at}])")


def _sin_body() -> str:
    return f"(CAST({S.between(SEED, 'sin.first', ID, 1, 7)} AS VARCHAR) || {S.digits(SEED, 'sin', ID, 7)})"


def _group(e: str, *sizes: int, sep: str = " ") -> str:
    parts, at = [], 1
    for n in sizes:
        parts.append(f"substr({e}, {at}, {n})")
        at += n
    return f"concat_ws('{sep}', {', '.join(parts)})"


_COUNTRY = S.choice(SEED, "iban.country", ID, ("GB", "DE", "FR"))
_ACCOUNT = (f"(CASE WHEN {_COUNTRY} = 'GB' THEN {S.symbols(SEED, 'iban.bank', ID, 4, fixed.UPPER)} ELSE '' END || "
            f"substr({S.digits(SEED, 'iban', ID, 23)}, 1, CASE {_COUNTRY} WHEN 'GB' THEN 14 WHEN 'DE' THEN 18 ELSE 23 END))")
_two = lambda e: f"lpad(CAST({e} AS VARCHAR), 2, '0')"
_four = lambda e: f"lpad(CAST({e} AS VARCHAR), 4, '0')"
_odd, _even = S.symbols(SEED, "ramq.odd", ID, 2, fixed.RAMQ_CONSONANTS), S.symbols(SEED, "ramq.even", ID, 2, fixed.UPPER)
_NAME = f"(substr({_odd}, 1, 1) || substr({_even}, 1, 1) || substr({_odd}, 2, 1) || substr({_even}, 2, 1))"


def _ramq(month: str) -> str:
    return (f"{_NAME} || ' ' || {S.digits(SEED, 'ramq.year', ID, 2)} || {_two(month)} || ' ' || "
            f"{_two(S.between(SEED, 'ramq.day', ID, 1, 28))} || {_two(S.between(SEED, 'ramq.seq', ID, 1, 99))}")


_first, _last = S.choice(SEED, "mail.first", ID, fixed.FIRST_NAMES), S.choice(SEED, "mail.last", ID, fixed.LAST_NAMES)
_LOCAL = (f"CASE {S.below(SEED, 'mail.pattern', ID, 4)} WHEN 0 THEN {_first} || '.' || {_last} WHEN 1 THEN {_first} || '_' || {_last} "
          f"WHEN 2 THEN substr({_first}, 1, 1) || {_last} ELSE {_last} || substr({_first}, 1, 1) END")
_nin = "".join(a + b for a in fixed.NIN_FIRST for b in fixed.NIN_SECOND if a + b not in fixed.NIN_DISALLOWED)
_area = S.between(SEED, "ssn.area", ID, 1, 898)
_med = f"(CAST({S.between(SEED, 'medicare.first', ID, 2, 6)} AS VARCHAR) || {S.digits(SEED, 'medicare', ID, 7)})"
_dl = list(fixed.US_DL_FORMATS.values())
_DL = (f"CASE {S.choice(SEED, 'dl.state', ID, _dl)} "
       + " ".join(f"WHEN '{f}' THEN {S.from_format(SEED, 'dl', ID, f)}" for f in sorted(set(_dl))) + " END")
_cusip = f"({S.choice(SEED, 'cusip.issuer', ID, fixed.CUSIP_ISSUERS)} || {S.choice(SEED, 'cusip.issue', ID, fixed.CUSIP_ISSUES)})"
_cins = (f"({S.symbols(SEED, 'cins.prefix', ID, 1, fixed.CINS_PREFIXES)} || {S.digits(SEED, 'cins', ID, 5)} || "
         f"{S.choice(SEED, 'cins.issue', ID, fixed.CINS_ISSUES)})")
_sedol = (f"(CASE WHEN {S.uniform(SEED, 'sedol.kind', ID)} < 0.5 THEN {S.digits(SEED, 'sedol', ID, 6)} ELSE "
          f"{S.symbols(SEED, 'sedol.first', ID, 1, fixed.RAMQ_CONSONANTS)} || {S.symbols(SEED, 'sedol.rest', ID, 5, fixed.DIGITS + fixed.RAMQ_CONSONANTS)} END)")
_isin = f"({S.choice(SEED, 'isin.country', ID, fixed.ISIN_COUNTRIES)} || {S.symbols(SEED, 'isin', ID, 9, fixed.ISIN_BODY)})"
_figi = f"('BBG' || {S.symbols(SEED, 'figi', ID, 8, fixed.FIGI_BODY)})"
_an = fixed.DIGITS + fixed.UPPER
_lei = f"({S.symbols(SEED, 'lei.lou', ID, 4, _an)} || '00' || {S.symbols(SEED, 'lei', ID, 12, _an)})"
_ua = fixed.UPPER + fixed.DIGITS
_body, _sin9 = _card_body(fixed.CARD_PREFIXES), _sin_body()

_with_first = f"(b || {S.cpf_digit('b', 9)})"

# One expression per category; ``b`` is bound in an inner select where a check digit repeats its body.
SYNTH_SQL: dict[str, tuple[str, str]] = {
    "credit_card": (_body, f"b || {S.luhn_digit('b')}"),
    "sin": (f"{_sin9} || {S.luhn_digit(_sin9)}", _group("b", 3, 3, 3)),
    "iban": (f"{_COUNTRY} || '|' || {_ACCOUNT}",
             f"substr(b, 1, 2) || {S.mod97_digits('(substr(b, 4) || substr(b, 1, 2))')} || substr(b, 4)"),
    "phone": (S.choice(SEED, "phone.area", ID, [str(a) for a in fixed.CA_AREA_CODES]),
              f"'+1-' || b || '-' || CAST({S.between(SEED, 'phone.exchange', ID, 200, 999)} AS VARCHAR) || '-' || {S.digits(SEED, 'phone', ID, 4)}"),
    "email": (_LOCAL, f"b || CASE WHEN {S.uniform(SEED, 'mail.suffix', ID)} < 0.3 THEN CAST({S.between(SEED, 'mail.number', ID, 1, 99)} AS VARCHAR) "
                      f"ELSE '' END || '@' || {S.choice(SEED, 'mail.domain', ID, fixed.MAIL_DOMAINS)}"),
    "ca_ramq": (_ramq(f"({S.between(SEED, 'ramq.month', ID, 1, 12)} + CASE WHEN {S.uniform(SEED, 'ramq.half', ID)} < 0.5 THEN 50 ELSE 0 END)"), "b"),
    "ca_gst_hst": (f"{S.digits(SEED, 'gst', ID, 9)} || 'RT' || {_four(S.between(SEED, 'gst.account', ID, 1, 9999))}", "b"),
    "ca_bank_account": (f"substr({S.digits(SEED, 'account', ID, 12)}, 1, {S.between(SEED, 'account.n', ID, 7, 12)})", "b"),
    "ssn": (f"lpad(CAST({_area} + CASE WHEN {_area} >= 666 THEN 1 ELSE 0 END AS VARCHAR), 3, '0')",
            f"b || '-' || {_two(S.between(SEED, 'ssn.group', ID, 1, 99))} || '-' || {_four(S.between(SEED, 'ssn.serial', ID, 1, 9999))}"),
    "uk_nin": (f"substr('{_nin}', {S.below(SEED, 'nin.prefix', ID, len(_nin) // 2)} * 2 + 1, 2)",
               f"b || ' ' || {_group(S.digits(SEED, 'nin', ID, 6), 2, 2, 2)} || ' ' || {S.symbols(SEED, 'nin.suffix', ID, 1, fixed.NIN_SUFFIX)}"),
    "br_cpf": (S.digits(SEED, "cpf", ID, 9),
               f"{_group('b', 3, 3, 3, sep='.')} || '-' || {S.cpf_digit('b', 9)} || {S.cpf_digit(_with_first, 10)}"),
    "au_medicare": (_med, _group(f"(b || {S.medicare_digit('b')} || CAST({S.between(SEED, 'medicare.issue', ID, 1, 9)} AS VARCHAR))", 4, 5, 1)),
    "us_dl": (_DL, "b"),
    "cusip_num": (_cusip, f"b || {S.cusip_digit('b')}"), "cins_num": (_cins, f"b || {S.cusip_digit('b')}"),
    "sedol_num": (_sedol, f"b || {S.sedol_digit('b')}"), "isin": (_isin, f"b || {S.isin_digit('b')}"),
    "figi_num": (_figi, f"b || {S.isin_digit('b')}"), "lei_num": (_lei, f"b || {S.mod97_digits('b')}"),
    "ticker_symbol": (S.choice(SEED, "ticker", ID, fixed.TICKERS), "b"), "reuters_ric": (S.choice(SEED, "ric", ID, fixed.RICS), "b"),
    "valor_num": (f"CAST({S.between(SEED, 'valor', ID, 1_000_000, 59_999_999)} AS VARCHAR)", "b"),
    "mt103_ref": (S.symbols(SEED, "mt103", ID, S.between(SEED, "mt103.n", ID, 12, 16), _ua, 16), "b"),
    "mifid_tx_id": (S.symbols(SEED, "mifid", ID, S.between(SEED, "mifid.n", ID, 30, 52), _ua, 52), "b"),
}
SYNTH_SQL.update({c: (S.from_format(SEED, c, ID, spec), "b") for c, spec in fixed.FORMAT_SPECS.items()})

_slot = lambda i: f"md5('{SEED}|tax.slot|' || CAST(c_custkey AS VARCHAR) || '|{i}')"
_order = "list_sort([" + ", ".join(f"md5({S.key(SEED, f'tax.{i}', ID)}) || '{d}'" for i, d in enumerate(fixed.DIGITS)) + "])"
SYNTH_SQL["de_tax_id"] = (
    f"array_to_string(list_transform(list_sort(list_transform([{', '.join(f'{_slot(i)} || right(({_order})[{i + 1 if i < 9 else 1}], 1)' for i in range(10))}], lambda x: x)), lambda s: right(s, 1)), '')",
    "b")


def synth_sql(category: str) -> str:
    body, whole = SYNTH_SQL[category]
    if category == "de_tax_id":
        fix = ("CASE WHEN starts_with(b, '00') THEN substr(b, 3) || '00' WHEN starts_with(b, '0') THEN substr(b, 2, 1) || '0' || substr(b, 3) "
               "ELSE b END")
        return (f"SELECT c_custkey, '{category}' AS category, b || {S.de_tax_digit('b')} AS value FROM "
                f"(SELECT c_custkey, {fix} AS b FROM (SELECT c_custkey, {body} AS b FROM customer))")
    if category == "br_cpf":
        moved = "substr(b, 1, 8) || CAST((CAST(substr(b, 9, 1) AS INT) + 1) % 10 AS VARCHAR)"
        return (f"SELECT c_custkey, '{category}' AS category, {whole} AS value FROM (SELECT c_custkey, CASE WHEN b = repeat(substr(b, 1, 1), 9) "
                f"THEN {moved} ELSE b END AS b FROM (SELECT c_custkey, {body} AS b FROM customer))")
    return f"SELECT c_custkey, '{category}' AS category, {whole} AS value FROM (SELECT c_custkey, {body} AS b FROM customer)"


def _synth_query(categories):
    def run(spark, sf_dir):
        return synthetic_values(spread(read_table(spark, sf_dir, "customer").select("c_custkey")), "c_custkey", categories, SEED)

    return run


SYNTH_GROUPS = {
    "synth_credit_card": ["credit_card"], "synth_sin": ["sin"], "synth_iban": ["iban"], "synth_phone": ["phone"],
    "synth_email": ["email"], "synth_ramq": ["ca_ramq"],
    "synth_ca_health": ["ca_mb_health", "ca_sk_health", "ca_ns_health", "ca_nb_health", "ca_pei_health", "ca_nl_health"],
    "synth_ca_drivers": ["ca_mb_drivers", "ca_sk_drivers", "ca_ns_drivers", "ca_nb_drivers", "ca_pei_drivers", "ca_nl_drivers"],
    "synth_ca_corporate": ["ca_business_number", "ca_gst_hst", "ca_transit_number", "ca_bank_account"],
    "synth_national_ids": ["ssn", "uk_nin", "br_cpf", "au_medicare", "de_tax_id"], "synth_us_dl": ["us_dl"],
    "synth_securities": ["cusip_num", "cins_num", "sedol_num", "isin", "figi_num", "lei_num"],
    "synth_market_refs": ["ticker_symbol", "reuters_ric", "valor_num", "wkn_num", "mt103_ref", "mifid_tx_id"],
}
assert sorted(c for cats in SYNTH_GROUPS.values() for c in cats) == sorted(SYNTHS)
for _name, _cats in SYNTH_GROUPS.items():
    query(_name, " UNION ALL ".join(synth_sql(c) for c in _cats))(_synth_query(_cats))

# --- near-misses ------------------------------------------------------------------------------------------------------

_shift = S.between(SEED, "near.shift", ID, 1, 8)
_wrong = f"CAST((CAST({S.luhn_digit('b')} AS INT) + {_shift}) % 10 AS VARCHAR)"
_rotated = "(substr(b, 4) || substr(b, 1, 2))"
_wrong_iban = f"((CAST({S.mod97_digits(_rotated)} AS INT) % 97 + {S.between(SEED, 'near.iban', ID, 1, 96)}) % 97)"
_narea, _month = S.below(SEED, "near.area", ID, 102), S.below(SEED, "near.month", ID, 76)
_letters = "list_sort([" + ", ".join(f"md5({S.key(SEED, f'near.letters.{i}', ID)}) || '{c}'" for i, c in enumerate(fixed.UPPER.lower())) + "])"
NEAR_SQL = {
    "credit_card": (_card_body(tuple((p, 16) for p in fixed.NEAR_CARD_PREFIXES)), f"b || {_wrong}"),
    "ssn": (f"CASE {_narea} WHEN 0 THEN '000' WHEN 1 THEN '666' ELSE CAST({_narea} + 898 AS VARCHAR) END",
            f"b || '-' || {S.digits(SEED, 'near.ssn.group', ID, 2)} || '-' || {S.digits(SEED, 'near.ssn', ID, 4)}"),
    "sin": (_sin9, _group(f"(b || {_wrong})", 3, 3, 3)),
    "iban": (f"{_COUNTRY} || '|' || {_ACCOUNT}",
             f"substr(b, 1, 2) || {_two(_wrong_iban)} || substr(b, 4)"),
    "email": (S.symbols(SEED, "near.user", ID, S.between(SEED, "near.user.n", ID, 4, 10), fixed.UPPER.lower() + fixed.DIGITS, 10),
              f"b || '@' || {S.choice(SEED, 'near.domain', ID, fixed.NEAR_MAIL_DOMAINS)} || {S.choice(SEED, 'near.tld', ID, fixed.RESERVED_TLDS)}"),
    "phone": (S.choice(SEED, "near.code", ID, fixed.NEAR_AREA_CODES),
              f"'+1-' || b || '-' || CAST({S.between(SEED, 'near.exchange', ID, 200, 999)} AS VARCHAR) || '-' || {S.digits(SEED, 'near.phone', ID, 4)}"),
    "ca_ramq": (_ramq(f"CASE WHEN {_month} = 0 THEN 0 WHEN {_month} <= 38 THEN {_month} + 12 ELSE {_month} + 24 END"), "b"),
    "entropy": (f"CASE {S.below(SEED, 'near.kind', ID, 4)} WHEN 0 THEN array_to_string(list_transform(({_letters})[1:4], "
                f"lambda c: repeat(right(c, 1), {S.between(SEED, 'near.run', ID, 4, 8)})), '') "
                f"WHEN 1 THEN {_group(S.symbols(SEED, 'near.uuid', ID, 32, '0123456789abcdef'), 8, 4, 4, 4, 12, sep='-')} "
                f"WHEN 2 THEN {S.choice(SEED, 'near.hash', ID, fixed.KNOWN_HASHES)} ELSE {S.choice(SEED, 'near.base64', ID, fixed.KNOWN_BASE64)} END", "b"),
}


def near_sql(category: str) -> str:
    body, whole = NEAR_SQL[category]
    return f"SELECT c_custkey, '{category}' AS category, {whole} AS value FROM (SELECT c_custkey, {body} AS b FROM customer)"


def _near_query(categories):
    def run(spark, sf_dir):
        ids = spread(read_table(spark, sf_dir, "customer").select("c_custkey"))
        return near_miss_corpus(ids, "c_custkey", categories, SEED).drop("text")

    return run


for _c in NEAR_MISSES:
    query(f"near_miss_{_c}", near_sql(_c))(_near_query([_c]))

_WRAP = "CASE category " + " ".join(f"WHEN '{c}' THEN {S.lit(t)}" for c, t in fixed.WRAP_TEMPLATES.items()) + f" ELSE {S.lit(fixed.WRAP_FALLBACK)} END"


@query("near_miss_wrapped", "SELECT c_custkey, category, replace(" + _WRAP + ", '{value}', value) AS text FROM ("
       + near_sql("ssn") + " UNION ALL " + near_sql("email") + " UNION ALL SELECT c_custkey, 'other' AS category, c_name AS value FROM customer)")
def near_miss_wrapped(spark, sf_dir):
    ids = spread(read_table(spark, sf_dir, "customer").select("c_custkey", "c_name"))
    near = near_miss_corpus(ids, "c_custkey", ["ssn", "email"], SEED).select("c_custkey", "category", "value")
    other = ids.select("c_custkey", F.lit("other").alias("category"), F.col("c_name").alias("value"))
    return near.unionByName(other).select("c_custkey", "category", wrap_in_context(F.col("category"), F.col("value")).alias("text"))


_REL = "CASE category " + " ".join(
    f"WHEN '{c}' THEN lower(trim(sub)) IN {S.in_list(ls)} OR lower(trim(main)) IN {S.in_list(ls)}" for c, ls in fixed.RELEVANT_LABELS.items()) + " ELSE TRUE END"


@query("near_miss_relevance",
       f"SELECT event_id, category, {_REL} AS relevant FROM (SELECT event_id, (['credit_card', 'ssn', 'email', 'dob'])[CAST(event_id % 4 AS INT) + 1] AS category, "
       "(['Visa', 'USA SSN', ' email ', 'Other', ''])[CAST(event_id % 5 AS INT) + 1] AS sub, (['Email Address', 'JCB', 'x'])[CAST(event_id % 3 AS INT) + 1] AS main FROM events)")
def near_miss_relevance(spark, sf_dir):
    pick = lambda items: F.element_at(F.array(*[F.lit(i) for i in items]), (F.col("event_id") % len(items) + 1).cast("int"))
    e = read_table(spark, sf_dir, "events").select("event_id", pick(("credit_card", "ssn", "email", "dob")).alias("category"))
    return e.select("event_id", "category", is_relevant(
        F.col("category"), pick(("Visa", "USA SSN", " email ", "Other", "")), pick(("Email Address", "JCB", "x"))).alias("relevant"))
