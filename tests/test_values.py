"""Known answers of check digits, validity of synthetic values, invalidity of near-misses."""

import pytest
from pyspark.sql import functions as F

from detectlab.functions import checks as C
from detectlab.functions.nearmiss import NEAR_MISSES, near_miss
from detectlab.functions.synth import synth

VALID = {
    "credit_card": C.luhn_valid, "sin": C.sin_valid, "iban": C.iban_valid, "ca_ramq": C.ramq_valid, "ssn": C.ssn_valid,
    "uk_nin": C.nin_valid, "br_cpf": C.cpf_valid, "au_medicare": C.medicare_valid, "de_tax_id": C.de_tax_valid,
    "cusip_num": C.cusip_valid, "sedol_num": C.sedol_valid, "isin": C.isin_valid, "figi_num": C.figi_valid,
    "lei_num": C.lei_valid,
}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("base,digit", [("03783310", "0"), ("46625H10", "0"), ("78008710", "2")])
def test_cusip(spark, base, digit):
    assert one(spark, C.cusip_digit(F.lit(base))) == digit


@pytest.mark.parametrize("base,digit", [("200597", "3"), ("054052", "8"), ("092245", "0")])
def test_sedol(spark, base, digit):
    assert one(spark, C.sedol_digit(F.lit(base))) == digit


@pytest.mark.parametrize("value,ok", [("4532015112830366", True), ("4532015112830367", False), ("4532-0151", False), ("", False)])
def test_luhn(spark, value, ok):
    assert one(spark, C.luhn_valid(F.lit(value))) is ok


@pytest.mark.parametrize("value,ok", [("GB82WEST12345698765432", True), ("gb82 west 1234 5698 7654 32", True),
                                      ("GB82WEST12345698765433", False), ("GB8", False)])
def test_iban(spark, value, ok):
    assert one(spark, C.iban_valid(F.lit(value))) is ok


def test_us_isin(spark):
    assert one(spark, C.isin_digit(F.lit("US037833100"))) == "5"


def test_synthetic_values_are_valid(spark):
    ids = spark.range(500)
    row = ids.select(*[F.count_if(check(synth(c, 7, F.col("id")))).alias(c) for c, check in VALID.items()]).first()
    assert {c: row[c] for c in VALID} == dict.fromkeys(VALID, 500)


def test_near_misses_fail_their_check(spark):
    checked = [c for c in NEAR_MISSES if c in VALID]
    row = spark.range(500).select(*[F.count_if(VALID[c](near_miss(c, 7, F.col("id")))).alias(c) for c in checked]).first()
    assert {c: row[c] for c in checked} == dict.fromkeys(checked, 0)


def test_values_do_not_depend_on_partitioning(spark):
    wanted = ["credit_card", "de_tax_id", "mifid_tx_id"]
    draw = lambda df: sorted(tuple(r) for r in df.select("id", *[synth(c, 3, F.col("id")) for c in wanted]).collect())
    assert draw(spark.range(0, 200, 1, 1)) == draw(spark.range(0, 200, 1, 7).repartition(5))


def test_unknown_category_is_refused():
    with pytest.raises(ValueError):
        synth("nothing", 1, None)
