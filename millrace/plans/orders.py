"""Order jobs: discounts, customer summaries, enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import whole_number_or_zero
from millrace.operators.keyed import first_per_key, latest_per_key
from millrace.operators.skew import enrich_hot


def adjusted_orders(orders: DataFrame) -> DataFrame:
    """Each order's amount after its discount; a missing amount is 0."""
    amount = F.coalesce(F.col("order_amount"), F.lit(0))
    return orders.select(
        "order_id", "customer_id", (amount * (1 - F.col("discount_pct"))).alias("adjusted_amount")
    )


def customer_summary(orders: DataFrame, customer: str = "customer_id") -> DataFrame:
    return orders.groupBy(customer).agg(
        F.sum("order_amount").alias("total_order_amount"),
        F.avg("discount_pct").alias("avg_discount_pct"),
        F.count("order_id").alias("order_count"),
    )


def order_discount(orders: DataFrame) -> DataFrame:
    """Orders after a discount given as text; text that is no whole number means no discount."""
    percent = whole_number_or_zero("discount_pct_str")
    return orders.withColumn("final_total", F.col("order_total") * (1 - percent / 100.0))


def enriched_orders(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders with their customer's latest record, one row per order."""
    latest = latest_per_key(customers, ["customer_id"], "_ingest_seq").drop("_ingest_seq")
    return enrich_hot(orders, latest, ["customer_id"], "inner", spread_by=["order_id"])


def silver_customers(customers: DataFrame) -> DataFrame:
    """One row per customer with a trimmed name. No country is left out."""
    tidy = customers.withColumn("customer_name", F.trim("customer_name"))
    return first_per_key(tidy, ["customer_id"])


def global_reporting(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders of known customers. `customers` holds one row per customer."""
    return enrich_hot(orders, customers, ["customer_id"], "inner", spread_by=["order_id"])
