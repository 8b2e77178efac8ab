from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from millrace.functions import rules, text
from millrace.functions.countries import CODE_OF, CODES, SPELLINGS, iso_country
from millrace.functions.money import (
    BILLING_RATES,
    PROCUREMENT_RATES,
    amount_text,
    mean_decimal,
    ratio,
    to_usd,
)
from millrace.plans.country import require_known_countries, with_country_code
from millrace.plans.shipping import freight_usd, weight_kg


def apply(spark, values, function, kind="string"):
    """Results of a one-column function, in input order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(function("v")).collect()]


@pytest.mark.parametrize(
    ("raw", "expected"),
    [("1,250.00", "1250.00"), (" 99.5 ", "99.50"), ("1,234,567.891", "1234567.89"), (None, None)],
)
def test_amounts_in_text(spark, raw, expected):
    assert apply(spark, [raw], amount_text) == [expected and Decimal(expected)]


def test_an_unreadable_amount_raises(spark):
    with pytest.raises(PySparkException):
        apply(spark, ["ten"], amount_text)


@pytest.mark.parametrize(
    ("amount", "currency", "rates", "expected"),
    [
        ("1000.00", "gbp", BILLING_RATES, "1270.00"),
        ("10000.00", " JPY", PROCUREMENT_RATES, "67.00"),
        ("100.00", "eur", PROCUREMENT_RATES, "108.00"),
        ("0.50", "INR", BILLING_RATES, "0.01"),
        ("100.00", "JPY", BILLING_RATES, None),
        ("100.00", "XXX", PROCUREMENT_RATES, None),
        ("100.00", None, PROCUREMENT_RATES, None),
    ],
)
def test_conversion_to_usd(spark, amount, currency, rates, expected):
    df = spark.createDataFrame([(Decimal(amount), currency)], "a decimal(14,2), c string")
    assert df.select(to_usd("a", "c", rates)).first()[0] == (expected and Decimal(expected))


def test_ratio_of_zero_is_null(spark):
    df = spark.createDataFrame([(Decimal(1), Decimal(0))], "n decimal(10,2), d decimal(10,2)")
    assert df.select(ratio(F.col("n"), F.col("d"), 1)).first()[0] is None


def test_mean_rounds_once(spark):
    df = spark.createDataFrame([(Decimal("0.01"),), (Decimal("0.00"),)], "a decimal(10,2)")
    assert df.agg(mean_decimal(F.col("a"), "decimal(12,2)")).first()[0] == Decimal("0.01")


def test_white_space_of_every_kind_is_stripped(spark):
    values = ["\tUK\n", "  UK ", "\x1cUK\x1f", "U K", "", None]
    assert apply(spark, values, text.strip_ws) == ["UK", "UK", "UK", "U K", "", None]


def test_flags(spark):
    values = [" YES ", "1", "TRUE", "no", "0", "False", "maybe", "", None]
    assert apply(spark, values, text.yes_no) == [True, True, True, False, False, False, None, None, None]
    assert apply(spark, values, text.is_yes) == [True, True, True] + [False] * 5 + [None]


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("15", 15.0), (" 5\t", 5.0), ("+7", 7.0), ("-3", -3.0), ("1_000", 1000.0), ("007", 7.0),
        ("N/A", 0.0), ("", 0.0), (None, 0.0), ("10.5", 0.0), ("1__0", 0.0), ("_1", 0.0), ("1e3", 0.0),
        ("9" * 30, float("9" * 30)),
    ],
)
def test_whole_numbers_in_text(spark, raw, expected):
    assert apply(spark, [raw], text.whole_number_or_zero) == [expected]


def test_email_domains(spark):
    values = ["a@x.com", "a@x.com@y.org", "no-at", "a@", None]
    assert apply(spark, values, text.email_domain) == ["x.com", "x.com", None, "", None]


def test_lenient_and_strict_dates(spark):
    assert apply(spark, [" 2026-01-02 ", "soon", None], lambda c: text.lenient(c, "date")) == [
        date(2026, 1, 2), None, None,
    ]
    assert apply(spark, ["2026-01-02", "  "], text.strict_date_or_null) == [date(2026, 1, 2), None]
    with pytest.raises(PySparkException):
        apply(spark, ["soon"], text.strict_date)


def test_every_spelling_has_its_code(spark):
    assert len(CODES) == 26 and len(CODE_OF) == sum(len(v) for v in SPELLINGS.values())
    padded = [f" \t{s}\n" for s in CODE_OF]
    assert apply(spark, padded, iso_country) == list(CODE_OF.values())


def test_unknown_spellings_have_no_code(spark):
    assert apply(spark, ["UNITED STATES", "XX", "", "usa", None], iso_country) == [None] * 5


@pytest.mark.parametrize("bad", ["UNITED STATES", "XX", " ", None])
def test_an_unknown_country_stops_the_job(spark, bad):
    df = spark.createDataFrame([("USA",), (bad,)], "country string")
    with pytest.raises(PySparkException, match="unknown country spelling"):
        with_country_code(df).collect()
    with pytest.raises(AssertionError, match="country"):
        require_known_countries(df)


@pytest.mark.parametrize(
    ("days", "region", "fee"),
    [
        (0, "domestic", 0), (1, "domestic", 5), (12, "domestic", 60), (20, "domestic", 100),
        (365, "domestic", 100), (9, "international", 45), (10, "international", 50),
        (365, "international", 50), (30, None, 100), (None, "domestic", None),
    ],
)
def test_late_fee(spark, days, region, fee):
    df = spark.createDataFrame([(days, region)], "d bigint, r string")
    assert df.select(rules.late_fee("d", "r")).first()[0] == fee


@pytest.mark.parametrize(
    ("gap", "tier", "risky"),
    [
        (100.0, "standard", False), (100.01, "standard", True), (-150.0, "standard", True),
        (300.0, "vip", False), (300.5, "vip", True), (-400.0, "vip", True),
        (150.0, "", True), (150.0, None, True), (150.0, "VIP", True), (None, "vip", None),
    ],
)
def test_high_risk(spark, gap, tier, risky):
    df = spark.createDataFrame([(gap, tier)], "g double, t string")
    assert df.select(rules.is_high_risk("g", "t")).first()[0] is risky


@pytest.mark.parametrize(
    ("carrier", "days", "expected"),
    [
        ("Northwind Freight", 3, True), ("Northwind Freight", 4, False), ("Kestrel Express", 2, True),
        ("Harbor Line", 6, False), ("Atlas Parcel", 4, True), ("Atlas Parcel", None, None),
        ("Unknown", 1, None),
    ],
)
def test_on_time(spark, carrier, days, expected):
    df = spark.createDataFrame([(carrier, days)], "c string, d int")
    assert df.select(rules.on_time("c", "d")).first()[0] is expected


@pytest.mark.parametrize(
    ("raw", "country", "expected"),
    [
        ("9876543210", "IN", "+919876543210"), ("07911123456", "GB", "+447911123456"),
        ("2025550123", "US", "+12025550123"), ("1 (202) 555-0123", "us", "+12025550123"),
        ("0170123456", "DE", "+49170123456"), ("0412345678", "AU", "+61412345678"),
        ("+44 7911 123456", "GB", "+447911123456"), ("12345", "US", None), ("0123", "FR", None),
        (None, "US", None), ("2025550123", None, None),
    ],
)
def test_phone_numbers(spark, raw, country, expected):
    df = spark.createDataFrame([(raw, country)], "p string, c string")
    assert df.select(rules.phone_e164("p", "c")).first()[0] == expected


@pytest.mark.parametrize(
    ("raw", "kg"), [("1,235.95 kg", 1235.95), ("31150 g", 31.15), (" 12.50 ", 12.5), ("2KG", 2.0)]
)
def test_weights(spark, raw, kg):
    assert apply(spark, [raw], weight_kg) == [kg]


def test_freight(spark):
    assert apply(spark, ["$1,184.20", "17.5"], freight_usd) == [Decimal("1184.20"), Decimal("17.50")]
    with pytest.raises(PySparkException):
        apply(spark, ["12 lb"], weight_kg)
