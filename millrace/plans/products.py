"""Product feed to active products, promotion prices, price alerts and inventory alerts."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.rules import is_active_flag
from millrace.operators.joins import match

# Fixed value: a price is an alert when it is below this share of the base price.
ALERT_SHARE = Decimal("0.9")


def active_products(
    products: DataFrame, flag: str = "is_active", word: str = "true", price: str = "base_price"
) -> DataFrame:
    """Products whose flag says active, in any letter case."""
    return products.where(is_active_flag(flag, word)).select("product_id", "product_name", price)


def silver_pricing(products: DataFrame, promotions: DataFrame) -> DataFrame:
    """Promoted products with the price after the promotion."""
    price = F.col("base_price") * (1 - F.col("discount_pct"))
    return match(products, promotions, ["product_id"]).withColumn("discounted_price", price)


def price_alerts(pricing: DataFrame) -> DataFrame:
    """Prices more than a tenth below the base price.

    Compared as decimals, so a price exactly a tenth below is not an alert however it is stored.
    """
    price = F.col("discounted_price").cast("decimal(20,6)")
    return pricing.where(price < F.col("base_price").cast("decimal(18,4)") * F.lit(ALERT_SHARE))


def inventory_alerts(order_lines: DataFrame, active: DataFrame) -> DataFrame:
    """Ordered lines of active products."""
    return match(order_lines, active, ["product_id"])
