"""Store sales: daily summary and regional revenue."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.money import mean
from millrace.operators.maintained import Maintained

DAILY_KEYS = ["store_id", "product_category", "sale_date"]


def daily_sales(transactions: DataFrame, run_date: date | None = None) -> DataFrame:
    """Sales per store, category and day; of one day when `run_date` is given."""
    if run_date is not None:
        transactions = transactions.where(F.col("sale_date") == F.lit(run_date))
    return transactions.groupBy(*DAILY_KEYS).agg(
        F.sum("revenue").alias("total_revenue"),
        F.sum("quantity").alias("total_units"),
        mean("revenue").alias("avg_order_value"),
        F.count("transaction_id").alias("transaction_count"),
    )


#: The daily summary as states that batches and their corrections are added to.
DAILY_STATES = Maintained(
    keys=DAILY_KEYS,
    sums={"revenue_sum": "revenue", "units_sum": "quantity"},
    counts={"transactions": "transaction_id"},
)


def daily_sales_of(states: DataFrame) -> DataFrame:
    """The daily summary, from its states."""
    return DAILY_STATES.report(
        states,
        DAILY_STATES.total("revenue_sum").alias("total_revenue"),
        DAILY_STATES.total("units_sum").alias("total_units"),
        DAILY_STATES.average("revenue_sum").alias("avg_order_value"),
        F.col("transactions").alias("transaction_count"),
    )


def regional_revenue(orders: DataFrame) -> DataFrame:
    return orders.groupBy("region_code").agg(F.sum("order_amount").alias("total_revenue"))
