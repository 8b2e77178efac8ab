"""Business rules, one function per rule, each returning a Column."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import col, lookup, lower_code

# Late fee per day and its caps.
FEE_PER_DAY = 5.0
FEE_CAP_DOMESTIC = 100.0
FEE_CAP_INTERNATIONAL = 50.0

# A discrepancy above these is high risk.
RISK_LIMIT_STANDARD = 100.0
RISK_LIMIT_VIP = 300.0

# Retention multiplier per customer tier, 1 for any other tier.
RETENTION = {"gold": Decimal("3.5"), "silver": Decimal("2.0"), "bronze": Decimal("1.2")}

# Churn factor weights, the count at which a factor saturates, tier exposure.
CHURN_INACTIVITY_WEIGHT, CHURN_INACTIVITY_DAYS = 0.40, 90.0
CHURN_SUPPORT_WEIGHT, CHURN_SUPPORT_TICKETS = 0.25, 10.0
CHURN_TIER_WEIGHT = 0.15
CHURN_PAYMENT_WEIGHT, CHURN_PAYMENT_FAILURES = 0.20, 3.0
CHURN_TIER_EXPOSURE = {"free": 1.0, "basic": 0.7, "premium": 0.4, "enterprise": 0.2}
CHURN_HIGH, CHURN_MEDIUM = 70, 40

# Promised transit days per carrier.
PROMISED_DAYS = {"Northwind Freight": 3, "Kestrel Express": 2, "Harbor Line": 5, "Atlas Parcel": 4}

# Calling code, trunk prefix and the national number lengths accepted.
PHONE_PLANS = {
    "IN": ("91", "0", 10, 10),
    "GB": ("44", "0", 9, 10),
    "US": ("1", "1", 10, 10),
    "DE": ("49", "0", 6, 13),
    "AU": ("61", "0", 9, 9),
}


def late_fee_cap(region: Column | str) -> Column:
    return F.when(col(region) == "international", FEE_CAP_INTERNATIONAL).otherwise(FEE_CAP_DOMESTIC)


def late_fee(days_overdue: Column | str, region: Column | str) -> Column:
    # `least` skips nulls, which would turn a missing day count into the full cap.
    days = col(days_overdue)
    return F.when(days.isNotNull(), F.least(days * FEE_PER_DAY, late_fee_cap(region)))


def is_high_risk(discrepancy: Column | str, tier: Column | str) -> Column:
    limit = F.when(col(tier) == "vip", RISK_LIMIT_VIP).otherwise(RISK_LIMIT_STANDARD)
    return F.abs(col(discrepancy)) > limit


def lifetime_value(order_value: Column | str, orders: Column | str, tier: Column | str) -> Column:
    multiplier = F.coalesce(lookup(tier, RETENTION, "decimal(2,1)"), F.lit(Decimal("1.0")))
    return F.coalesce(col(order_value), F.lit(0)) * col(orders) * multiplier


def _saturating(count: Column | str, full_at: float) -> Column:
    """0 to 100, reaching 100 at `full_at`. A null count scores 100, as `least` skips nulls."""
    return F.least(col(count) / F.lit(full_at) * 100, F.lit(100.0))


def churn_score(
    days_idle: Column | str, tickets: Column | str, tier: Column | str, failures: Column | str
) -> Column:
    """Weighted risk from 0 to 100, one decimal. No second login yet (null days) is no inactivity."""
    inactivity = F.when(col(days_idle).isNull(), 0.0).otherwise(
        _saturating(days_idle, CHURN_INACTIVITY_DAYS)
    )
    exposure = F.coalesce(lookup(F.lower(col(tier)), CHURN_TIER_EXPOSURE, "double"), F.lit(1.0))
    score = (
        inactivity * CHURN_INACTIVITY_WEIGHT
        + _saturating(tickets, CHURN_SUPPORT_TICKETS) * CHURN_SUPPORT_WEIGHT
        + exposure * 100.0 * CHURN_TIER_WEIGHT
        + _saturating(failures, CHURN_PAYMENT_FAILURES) * CHURN_PAYMENT_WEIGHT
    )
    return F.round(score, 1)


def churn_band(score: Column | str) -> Column:
    s = col(score)
    return F.when(s >= CHURN_HIGH, "High").when(s >= CHURN_MEDIUM, "Medium").otherwise("Low")


def promised_days(carrier: Column | str) -> Column:
    return lookup(carrier, PROMISED_DAYS, "int")


def on_time(carrier: Column | str, transit_days: Column | str) -> Column:
    """Null while in transit and for a carrier without a promise; a delivery before its shipping raises."""
    days = col(transit_days)
    wrong = F.raise_error(F.concat(F.lit("transit days cannot be negative: "), days.cast("string")))
    return F.when(days < 0, wrong.cast("boolean")).otherwise(days <= promised_days(carrier))


def is_active_flag(c: Column | str, word: str) -> Column:
    """A text flag equal to `word` in any letter case, blanks around it ignored."""
    return lower_code(c) == word.lower()


def phone_e164(raw: Column | str, country: Column | str) -> Column:
    """`+<calling code><national number>`, null when the country or the length is not known.

    A number written with a leading `+` already carries its calling code.
    """
    text, code = F.trim(col(raw)), F.upper(F.trim(col(country)))
    digits = F.regexp_replace(text, "[^0-9]", "")
    formatted = F.lit(None).cast("string")
    for name, (calling, trunk, shortest, longest) in PHONE_PLANS.items():
        national = F.when(
            digits.startswith(trunk) & (F.length(digits) > shortest),
            F.substring(digits, len(trunk) + 1, 32),
        ).otherwise(digits)
        fits = F.length(national).between(shortest, longest)
        formatted = F.when((code == name) & fits, F.concat(F.lit("+" + calling), national)).otherwise(
            formatted
        )
    international = F.when(F.length(digits).between(7, 15), F.concat(F.lit("+"), digits))
    return F.when(text.startswith("+"), international).otherwise(formatted)
