"""Customer jobs: value, churn risk, age band, contacts, e-mail domains, balances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import rules
from millrace.functions.text import email_domain
from millrace.operators.joins import enrich

# The age band, both ends included.
AGE_FROM, AGE_TO = 30, 45

CHURN_COLUMNS = [
    "customer_id",
    "subscription_tier",
    "days_since_last_login",
    "support_tickets_opened_90d",
    "payment_failures_90d",
    "churn_risk_score",
    "risk_tier",
]


def customer_ltv(summaries: DataFrame) -> DataFrame:
    value = rules.lifetime_value("avg_order_value", "orders_last_year", "customer_tier")
    return summaries.select("customer_id", "customer_tier", value.alias("estimated_ltv"))


def churn_risk(activity: DataFrame) -> DataFrame:
    """Risk score and band per customer; the band follows the rounded score."""
    score = rules.churn_score(
        "days_since_last_login",
        "support_tickets_opened_90d",
        "subscription_tier",
        "payment_failures_90d",
    )
    scored = activity.withColumn("churn_risk_score", score)
    return scored.withColumn("risk_tier", rules.churn_band("churn_risk_score")).select(*CHURN_COLUMNS)


def age_band(customers: DataFrame, low: int = AGE_FROM, high: int = AGE_TO) -> DataFrame:
    """Customers in the band, all columns as they are; an unknown age is out."""
    return customers.where(F.col("age").between(low, high))


def customer_contacts(contacts: DataFrame) -> DataFrame:
    return contacts.withColumn("formatted_phone", rules.phone_e164("raw_phone", "country_code"))


def customer_domains(customers: DataFrame) -> DataFrame:
    return customers.withColumn("domain", email_domain("email"))


def customers_per_domain(customers: DataFrame) -> DataFrame:
    """Customers per e-mail domain; those without one form the null row."""
    return customer_domains(customers).groupBy("domain").agg(F.count("*").alias("customers"))


def late_fees(accounts: DataFrame) -> DataFrame:
    """Fee per overdue account and whether it reached the region's cap."""
    charged = accounts.withColumn("late_fee", rules.late_fee("days_overdue", "region"))
    return charged.withColumn("fee_capped", F.col("late_fee") == rules.late_fee_cap("region"))


def high_risk_accounts(accounts: DataFrame) -> DataFrame:
    return accounts.where(rules.is_high_risk("discrepancy", "tier"))


def balances_with_region(balances: DataFrame, history: DataFrame) -> DataFrame:
    """Every balance with its customer's current region, null without one.

    Gate the history with `require_single_current` first: two current rows would repeat a customer.
    """
    current = history.where(F.col("is_current")).select("customer_id", "region")
    return enrich(balances, current, ["customer_id"])
