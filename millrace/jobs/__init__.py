"""Runnable jobs: named tables in, checked tables out."""

from millrace.jobs import commerce, feeds, finance, records

JOBS = {
    "price_alerts": commerce.price_alerts,
    "inventory_alerts": commerce.inventory_alerts,
    "global_reporting": commerce.global_reporting,
    "daily_sales": commerce.daily_sales,
    "enriched_orders": commerce.enriched_orders,
    "customer_orders": commerce.customer_orders,
    "order_discounts": commerce.order_discounts,
    "customer_ltv": commerce.customer_ltv,
    "rolling_metrics": commerce.rolling_metrics,
    "regional_revenue": commerce.regional_revenue,
    "reconciliation": finance.reconciliation,
    "balances": finance.balances,
    "late_fees": finance.late_fees,
    "high_risk": finance.high_risk,
    "billing_bronze": finance.billing_bronze,
    "billing_silver": finance.billing_silver,
    "billing_gold": finance.billing_gold,
    "accounts": records.accounts_medallion,
    "supplier_spend": records.supplier_spend,
    "carrier_sla": records.carrier_sla,
    "country_revenue": records.country_revenue,
    "country_revenue_v2": records.country_revenue_v2,
    "age_band": records.customers_in_age_band,
    "churn_scores": records.churn_scores,
    "contacts": records.customer_contacts,
    "email_domains": records.email_domains,
    "carrier_feed": feeds.carrier_feed,
    "warehouses": feeds.warehouses,
    "order_items": feeds.order_items,
    "catalog_enrichment": feeds.catalog_enrichment,
    "journeys": feeds.journeys,
    "loyalty": feeds.loyalty,
    "audit_snapshot": feeds.audit_snapshot,
}
