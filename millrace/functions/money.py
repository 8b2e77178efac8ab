"""Amounts: text to decimals, currencies to USD, ratios that do not fail on zero."""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import col, lookup

# USD per unit of each currency.
BILLING_RATES = {
    "USD": Decimal("1"),
    "EUR": Decimal("1.08"),
    "GBP": Decimal("1.27"),
    "INR": Decimal("0.012"),
    "AUD": Decimal("0.66"),
}
PROCUREMENT_RATES = {
    "USD": Decimal("1"),
    "GBP": Decimal("1.27"),
    "EUR": Decimal("1.08"),
    "INR": Decimal("0.012"),
    "JPY": Decimal("0.0067"),
    "AED": Decimal("0.27"),
    "CAD": Decimal("0.73"),
    "AUD": Decimal("0.66"),
}


def amount_text(c: Column | str, data_type: str = "decimal(14,2)") -> Column:
    """A typed amount from text such as ` 1,250.00 `; unreadable text raises."""
    return F.translate(F.trim(col(c)), ",", "").cast(data_type)


def usd_exact(
    amount: Column | str, currency: Column | str, rates: Mapping[str, Decimal]
) -> Column:
    """Unrounded amount in USD, null for an unknown currency.

    Rates are decimals: a double product lands on either side of a half cent.
    """
    code = F.upper(F.trim(col(currency)))
    return col(amount) * lookup(code, rates, "decimal(8,4)")


def to_usd(
    amount: Column | str,
    currency: Column | str,
    rates: Mapping[str, Decimal],
    data_type: str = "decimal(14,2)",
) -> Column:
    """Amount in USD, rounded half up."""
    return F.round(usd_exact(amount, currency, rates), 2).cast(data_type)


def ratio(numerator: Column, denominator: Column, scale: int) -> Column:
    """Rounded quotient, null when the denominator is zero or null."""
    return F.round(F.try_divide(numerator, denominator), scale)


def sum_where(condition: Column, amount: Column) -> Column:
    """Sum of `amount` over the rows meeting `condition`; null when none does."""
    return F.sum(F.when(condition, amount))


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def mean_decimal(amount: Column, data_type: str) -> Column:
    """Mean of a decimal column, rounded half up once to the scale of `data_type`.

    `avg` would round to four more digits than its input first, then again here.
    """
    scale = int(data_type.rstrip(")").split(",")[1])
    return ratio(F.sum(amount), F.count(amount).cast("decimal(20,0)"), scale).cast(data_type)


def mean(amount: Column | str) -> Column:
    """Sum over count. Beside a sum of the same column Spark computes that sum once, which `avg` would
    repeat."""
    return F.try_divide(F.sum(amount), F.count(amount))
