"""Suppliers, purchase orders and spend per supplier country."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.money import (
    PROCUREMENT_RATES,
    amount_text,
    count_where,
    mean_decimal,
    sum_where,
    to_usd,
)
from millrace.functions.text import is_yes, lower_code, strict_date, upper_code
from millrace.operators.joins import enrich
from millrace.operators.keyed import first_per_trimmed_key
from millrace.operators.skew import enrich_hot

# Columns of the published tables, in order.
SUPPLIER_COLUMNS = [
    "supplier_id",
    "supplier_name",
    "country",
    "city",
    "category",
    "payment_terms_days",
    "onboarded_date",
    "is_preferred",
    "annual_contract_usd",
    "currency",
]
PO_COLUMNS = [
    "po_id",
    "supplier_id",
    "supplier_name",
    "supplier_country",
    "po_date",
    "status",
    "buyer_team",
    "line_items",
    "amount",
    "amount_usd",
]
SPEND_COLUMNS = [
    "supplier_country",
    "suppliers_count",
    "preferred_suppliers",
    "po_count",
    "total_spend_usd",
    "avg_po_usd",
    "open_po_usd",
    "first_po_date",
    "last_po_date",
]
# Fixed value: the days of `Net 45` or `2/10 Net 30`.
_NET_DAYS = r"Net (\d+)"


def clean_suppliers(raw: DataFrame) -> DataFrame:
    """One typed row per supplier. The country stays as typed; terms without net days are null."""
    used = raw.select(
        "supplier_id",
        "supplier_name",
        "country",
        "city",
        "category",
        "payment_terms",
        "onboarded_date",
        "is_preferred",
        "annual_contract_value",
        "currency",
    )
    one = first_per_trimmed_key(used, "supplier_id")
    contract = amount_text("annual_contract_value")
    return one.select(
        "supplier_id",
        F.trim("supplier_name").alias("supplier_name"),
        F.trim("country").alias("country"),
        F.trim("city").alias("city"),
        F.trim("category").alias("category"),
        F.regexp_extract("payment_terms", _NET_DAYS, 1).try_cast("int").alias("payment_terms_days"),
        strict_date("onboarded_date").alias("onboarded_date"),
        is_yes("is_preferred").alias("is_preferred"),
        to_usd(contract, "currency", PROCUREMENT_RATES).alias("annual_contract_usd"),
        upper_code("currency").alias("currency"),
    )


def purchase_orders(raw: DataFrame, suppliers: DataFrame) -> DataFrame:
    """One typed row per purchase order with its supplier; an unknown supplier leaves nulls."""
    amount = amount_text("amount")
    used = raw.select(
        "po_id",
        "supplier_id",
        "po_date",
        "amount",
        "currency",
        "status",
        "buyer_team",
        "line_items",
    )
    typed = first_per_trimmed_key(used, "po_id").select(
        "po_id",
        F.trim("supplier_id").alias("supplier_id"),
        strict_date("po_date").alias("po_date"),
        lower_code("status").alias("status"),
        F.trim("buyer_team").alias("buyer_team"),
        F.trim("line_items").cast("int").alias("line_items"),
        amount.alias("amount"),
        to_usd(amount, "currency", PROCUREMENT_RATES).alias("amount_usd"),
    )
    named = suppliers.select(
        "supplier_id", "supplier_name", F.col("country").alias("supplier_country")
    )
    trimmed = raw.select(F.trim("supplier_id").alias("supplier_id"))
    joined = enrich_hot(typed, named, ["supplier_id"], counted=trimmed, spread_by=["po_id"])
    return joined.select(*PO_COLUMNS)


def spend_by_country(orders: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Suppliers and their live orders per country as typed; a country without orders shows zeros.

    Both sides are aggregated to countries first, so the join is of two short tables.
    """
    amount, is_open = F.col("amount_usd"), F.col("status") == "open"
    base = suppliers.groupBy(F.col("country").alias("supplier_country")).agg(
        F.count("*").alias("suppliers_count"),
        count_where(F.col("is_preferred")).alias("preferred_suppliers"),
    )
    spend = (
        orders.where(F.col("status") != "cancelled")
        .groupBy("supplier_country")
        .agg(
            F.count("*").alias("po_count"),
            F.sum(amount).cast("decimal(16,2)").alias("total_spend_usd"),
            mean_decimal(amount, "decimal(14,2)").alias("avg_po_usd"),
            sum_where(is_open, amount).cast("decimal(16,2)").alias("open_po_usd"),
            F.min("po_date").alias("first_po_date"),
            F.max("po_date").alias("last_po_date"),
        )
    )
    zeros = {"po_count": 0, "total_spend_usd": 0, "open_po_usd": 0}
    return enrich(base, spend, ["supplier_country"]).fillna(zeros).select(*SPEND_COLUMNS)
