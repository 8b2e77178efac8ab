"""Filters and row-wise rules."""

from __future__ import annotations

from pyspark.sql import DataFrame

from millrace.plans import customers, orders, products, reconcile
from millrace.registry.base import Inputs, query, typed


@query(
    "active_products",
    views=["product_feed"],
    oracle="""SELECT product_id, product_name, base_price FROM product_feed
    WHERE upper(trim(is_active)) = 'TRUE'""",
)
def _(v: Inputs) -> DataFrame:
    return products.active_products(v.product_feed)


@query(
    "age_band",
    views=["customer_ages"],
    oracle="SELECT * FROM customer_ages WHERE age >= 30 AND age <= 45",
)
def _(v: Inputs) -> DataFrame:
    return customers.age_band(v.customer_ages)


@query(
    "drop_null_amounts",
    views=["transactions"],
    oracle="SELECT * FROM transactions WHERE NOT (amount IS NULL)",
)
def _(v: Inputs) -> DataFrame:
    return reconcile.drop_null_amounts(v.transactions)


@query(
    "price_alerts",
    views=["product_feed", "promotions"],
    oracle="""SELECT product_id, product_name, base_price, discount_pct,
      CAST(base_price * (1 - discount_pct) AS DECIMAL(16,4)) AS discounted_price
    FROM product_feed JOIN promotions USING (product_id)
    WHERE lower(trim(is_active)) = 'true' AND discount_pct > 0.10 AND base_price > 0""",
)
def _(v: Inputs) -> DataFrame:
    pricing = products.silver_pricing(products.active_products(v.product_feed), v.promotions)
    return typed(products.price_alerts(pricing), discounted_price="decimal(16,4)")


@query(
    "high_risk_accounts",
    views=["risk_snapshot"],
    oracle="""SELECT * FROM risk_snapshot
    WHERE (tier = 'vip' AND (discrepancy > 300 OR discrepancy < -300))
       OR (tier IS DISTINCT FROM 'vip' AND (discrepancy > 100 OR discrepancy < -100))""",
)
def _(v: Inputs) -> DataFrame:
    return customers.high_risk_accounts(v.risk_snapshot)


@query(
    "adjusted_orders",
    views=["discount_amount_orders"],
    oracle="""SELECT order_id, customer_id,
      CAST(CASE WHEN order_amount IS NULL THEN 0 ELSE order_amount * (1 - discount_pct) END
           AS DECIMAL(18,4)) AS adjusted_amount FROM discount_amount_orders""",
)
def _(v: Inputs) -> DataFrame:
    return typed(orders.adjusted_orders(v.discount_amount_orders), adjusted_amount="decimal(18,4)")


@query(
    "customer_ltv",
    views=["customer_summaries"],
    oracle="""SELECT customer_id, customer_tier,
      CAST(coalesce(avg_order_value, 0) * orders_last_year
        * CASE customer_tier WHEN 'gold' THEN 3.5 WHEN 'silver' THEN 2.0 WHEN 'bronze' THEN 1.2
          ELSE 1.0 END AS DECIMAL(24,3)) AS estimated_ltv FROM customer_summaries""",
)
def _(v: Inputs) -> DataFrame:
    return typed(customers.customer_ltv(v.customer_summaries), estimated_ltv="decimal(24,3)")


@query(
    "churn_risk",
    views=["customer_activity"],
    oracle="""
    , scored AS (SELECT *, CAST(round(
      CASE WHEN days_since_last_login IS NULL THEN 0
           WHEN days_since_last_login > 90 THEN 40 ELSE days_since_last_login * 40 / 90.0 END
      + CASE WHEN support_tickets_opened_90d <= 10 THEN support_tickets_opened_90d * 2.5 ELSE 25 END
      + CASE lower(subscription_tier) WHEN 'basic' THEN 10.5 WHEN 'premium' THEN 6
          WHEN 'enterprise' THEN 3 ELSE 15 END
      + CASE WHEN payment_failures_90d <= 3 THEN payment_failures_90d * 20 / 3.0 ELSE 20 END, 1)
      AS DOUBLE) AS churn_risk_score FROM customer_activity)
    SELECT customer_id, subscription_tier, days_since_last_login, support_tickets_opened_90d,
      payment_failures_90d, churn_risk_score,
      CASE WHEN churn_risk_score >= 70 THEN 'High' WHEN churn_risk_score >= 40 THEN 'Medium'
           ELSE 'Low' END AS risk_tier FROM scored""",
)
def _(v: Inputs) -> DataFrame:
    return customers.churn_risk(v.customer_activity)


@query(
    "order_discount",
    views=["text_discount_orders"],
    oracle="""SELECT order_id, order_total, discount_pct_str,
      CAST(order_total AS DOUBLE) * (CAST(1 AS DOUBLE) - CASE trim(discount_pct_str)
        WHEN '10' THEN 10 WHEN '5' THEN 5 WHEN '1_5' THEN 15 WHEN '+20' THEN 20 ELSE 0 END
        / CAST(100 AS DOUBLE)) AS final_total FROM text_discount_orders""",
)
def _(v: Inputs) -> DataFrame:
    return orders.order_discount(v.text_discount_orders)


@query(
    "late_fees",
    views=["overdue_accounts"],
    oracle="""SELECT *, CAST(CASE
        WHEN region = 'international' THEN CASE WHEN days_overdue < 10 THEN days_overdue * 5 ELSE 50 END
        ELSE CASE WHEN days_overdue < 20 THEN days_overdue * 5 ELSE 100 END END AS DOUBLE) AS late_fee,
      days_overdue >= CASE WHEN region = 'international' THEN 10 ELSE 20 END AS fee_capped
    FROM overdue_accounts""",
)
def _(v: Inputs) -> DataFrame:
    return customers.late_fees(v.overdue_accounts)


@query(
    "email_domain",
    views=["customer_emails"],
    oracle="""SELECT *, CASE WHEN contains(email, '@') THEN string_split(email, '@')[2] END AS domain
    FROM customer_emails""",
)
def _(v: Inputs) -> DataFrame:
    return customers.customer_domains(v.customer_emails)


@query(
    "email_domain_report",
    views=["customer_emails"],
    oracle="""SELECT nullif(split_part(email, '@', 2), '') AS domain, count(*) AS customers
    FROM customer_emails GROUP BY 1""",
)
def _(v: Inputs) -> DataFrame:
    return customers.customers_per_domain(v.customer_emails)


@query(
    "contact_e164",
    views=["customer_contacts"],
    oracle="""
    , d AS (SELECT *, regexp_replace(raw_phone, '[^0-9]', '', 'g') AS digits,
        upper(trim(country_code)) AS cc FROM customer_contacts)
    SELECT customer_id, raw_phone, country_code, CASE
      WHEN raw_phone LIKE '+%' THEN '+' || digits
      WHEN cc = 'US' AND length(digits) = 10 THEN '+1' || digits
      WHEN cc = 'IN' AND length(digits) = 10 THEN '+91' || digits
      WHEN cc = 'GB' AND length(digits) = 11 AND digits LIKE '0%' THEN '+44' || substr(digits, 2)
      WHEN cc = 'DE' AND length(digits) = 10 AND digits LIKE '0%' THEN '+49' || substr(digits, 2)
      END AS formatted_phone FROM d""",
)
def _(v: Inputs) -> DataFrame:
    return customers.customer_contacts(v.customer_contacts)
