"""Products, sales and orders."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from millrace.checks.gates import require_no_nulls, require_same_count
from millrace.jobs.base import NOT_EMPTY, Store, exact_rows, unique
from millrace.operators.rolling import rolling_days, rolling_rows
from millrace.plans import customers, orders, products, sales
from millrace.sinks.merge import create_or_merge


def price_alerts(store: Store, expected_active: int | None = None) -> None:
    """raw_product_feed, active_promotions -> bronze_active_products -> silver_pricing ->
    gold_price_alerts."""
    checks = [] if expected_active is None else [exact_rows(expected_active)]
    active = store.publish(
        "bronze_active_products", products.active_products(store.read("raw_product_feed")), *checks
    )
    pricing = store.publish(
        "silver_pricing", products.silver_pricing(active, store.read("active_promotions"))
    )
    store.publish("gold_price_alerts", products.price_alerts(pricing), NOT_EMPTY)


def inventory_alerts(store: Store) -> None:
    """bronze_products, bronze_order_lines -> silver_active_products -> gold_inventory_alerts."""
    feed = store.read("bronze_products")
    active = store.publish(
        "silver_active_products", products.active_products(feed, "status", "active", "unit_price")
    )
    alerts = products.inventory_alerts(store.read("bronze_order_lines"), active)
    store.publish("gold_inventory_alerts", alerts, NOT_EMPTY)


def global_reporting(store: Store) -> None:
    """bronze_customers, bronze_orders_global -> silver_customers -> gold_global_reporting."""
    silver = store.publish(
        "silver_customers",
        orders.silver_customers(store.read("bronze_customers")),
        unique("customer_id"),
    )
    report = orders.global_reporting(store.read("bronze_orders_global"), silver)
    store.publish("gold_global_reporting", report, NOT_EMPTY)


def daily_sales(store: Store, run_date: date) -> None:
    """One day of bronze_sales_transactions merged into gold_daily_sales_summary.

    The summary is partitioned by day, so a run reads and rewrites the folder of its day only.
    """
    day = store.read("bronze_sales_transactions").where(F.col("sale_date") == F.lit(run_date))
    require_no_nulls(day, ["transaction_id", "store_id", "revenue"])
    create_or_merge(
        store.spark,
        store.name("gold_daily_sales_summary"),
        sales.daily_sales(day),
        sales.DAILY_KEYS,
        ["sale_date"],
    )


def enriched_orders(store: Store) -> None:
    """raw_orders, dim_customer -> gold_enriched_orders, one row per order."""
    raw = store.read("raw_orders")
    store.publish(
        "gold_enriched_orders", orders.enriched_orders(raw, store.read("dim_customer")),
        audit=lambda rows: require_same_count(rows, raw),
    )


def customer_orders(store: Store) -> None:
    """bronze_orders -> silver_orders -> gold_customer_summary, gold_adjusted_orders."""
    bronze = store.read("bronze_orders")
    silver = bronze.withColumnRenamed("customer_id", "cust_id").where(F.col("order_id").isNotNull())
    silver = store.publish("silver_orders", silver)
    store.publish("gold_customer_summary", orders.customer_summary(silver, "cust_id"))
    store.publish("gold_adjusted_orders", orders.adjusted_orders(bronze))


def order_discounts(store: Store) -> None:
    """text_discount_orders -> orders_with_discount."""
    store.publish("orders_with_discount", orders.order_discount(store.read("text_discount_orders")))


def customer_ltv(store: Store) -> None:
    """bronze_customer_summaries -> gold_customer_ltv."""
    summaries = store.read("bronze_customer_summaries")
    store.publish("gold_customer_ltv", customers.customer_ltv(summaries))


def rolling_metrics(store: Store) -> None:
    """daily_store_sales -> rolling_store_metrics (by rows), rolling_store_days (by calendar days)."""
    daily = store.read("daily_store_sales").withColumnRenamed("txn_date", "transaction_date")
    by_rows = rolling_rows(daily, "store_id", "transaction_date", "revenue")
    store.publish("rolling_store_metrics", by_rows)
    store.publish(
        "rolling_store_days", rolling_days(daily, "store_id", "transaction_date", "revenue")
    )


def regional_revenue(store: Store) -> None:
    """regional_orders -> regional_summary."""
    clean = store.read("regional_orders").drop("region_code_legacy")
    store.publish("regional_summary", sales.regional_revenue(clean), unique("region_code"))
