"""Carrier feed to shipments, carrier punctuality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.money import count_where, ratio
from millrace.functions.rules import on_time
from millrace.functions.text import col, strict_date, strict_date_or_null

FEED_COLUMNS = [
    "feed_row_id",
    "shipment_ref",
    "warehouse_code",
    "carrier_name",
    "shipped_at",
    "delivered_at",
    "weight",
    "freight_charge",
]


def weight_kg(c: Column | str) -> Column:
    """Kilograms from `1,235.95 kg`, `31150 g` or a bare number of kilograms; other text raises."""
    text = F.lower(F.translate(F.trim(col(c)), ",", ""))
    unit = F.when(text.endswith("kg"), 2).when(text.endswith("g"), 1).otherwise(0)
    number = F.trim(F.left(text, F.length(text) - unit)).cast("double")
    return number / F.when(unit == 1, 1000.0).otherwise(1.0)


def freight_usd(c: Column | str) -> Column:
    """Dollars from `$1,184.20` or a bare amount; other text raises."""
    return F.translate(F.trim(col(c)), ",$", "").cast("decimal(12,2)")


def shipments_silver(feed: DataFrame) -> DataFrame:
    """Every feed row, typed. A blank delivery date means still in transit."""
    shipped, delivered = strict_date("shipped_at"), strict_date_or_null("delivered_at")
    return feed.select(
        F.col("shipment_ref").alias("shipment_id"),
        F.col("warehouse_code").alias("warehouse_id"),
        F.col("carrier_name").alias("carrier"),
        shipped.alias("shipped_on"),
        delivered.alias("delivered_on"),
        weight_kg("weight").alias("weight_kg"),
        freight_usd("freight_charge").alias("freight_usd"),
        F.datediff(delivered, shipped).alias("transit_days"),
    )


def carrier_sla(shipments: DataFrame) -> DataFrame:
    """Punctuality and freight per carrier. Percentages are of delivered shipments, null without any;
    freight per kg is total freight over total weight."""
    punctual = count_where(on_time("carrier", "transit_days"))
    delivered = F.count("delivered_on")
    # Weights are summed as decimals: the order of a double sum would change its last digits.
    weight = F.sum(F.col("weight_kg").cast("decimal(18,6)"))
    return shipments.groupBy("carrier").agg(
        F.count("*").alias("shipments_count"),
        delivered.alias("delivered_count"),
        punctual.alias("on_time_count"),
        ratio(punctual * 100, delivered.cast("decimal(20,0)"), 1)
        .cast("decimal(5,1)")
        .alias("on_time_pct"),
        ratio(F.sum("transit_days"), F.count("transit_days").cast("decimal(20,0)"), 2)
        .cast("decimal(6,2)")
        .alias("avg_transit_days"),
        F.sum("freight_usd").cast("decimal(14,2)").alias("total_freight_usd"),
        ratio(F.sum("freight_usd"), weight, 2).cast("decimal(10,2)").alias("freight_per_kg"),
    )
