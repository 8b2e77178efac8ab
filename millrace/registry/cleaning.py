"""Text to typed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.countries import CODE_OF
from millrace.functions.money import PROCUREMENT_RATES, amount_text, to_usd
from millrace.functions.text import upper_code
from millrace.plans import accounts, billing, country, procurement, shipping
from millrace.registry.base import Inputs, query
from millrace.registry.joins import ACCOUNTS_CTE, TIERS_CTE


def _rate(column: str, rates: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{code}' THEN {rate}" for code, rate in rates.items())
    return f"CAST(CASE upper(trim({column})) {cases} END AS DECIMAL(8,4))"


def _amount(column: str) -> str:
    return f"CAST(replace(trim({column}), ',', '') AS DECIMAL(14,2))"


_PROCUREMENT = {
    "USD": "1", "GBP": "1.27", "EUR": "1.08", "INR": "0.012",
    "JPY": "0.0067", "AED": "0.27", "CAD": "0.73", "AUD": "0.66",
}
_BILLING = {"USD": "1", "EUR": "1.08", "GBP": "1.27", "INR": "0.012", "AUD": "0.66"}


def first_rows(view: str, key: str, order: list[str], columns: list[str]) -> str:
    """The first row per trimmed key of a view, ties broken by the other columns used, in order."""
    by = [f"{c} ASC NULLS FIRST" for c in order + [c for c in columns if c not in order]]
    return (
        f"(SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY trim({key}) "
        f"ORDER BY {', '.join(by)}) AS n FROM {view}) WHERE n = 1)"
    )


_SUPPLIERS = first_rows(
    "suppliers_raw",
    "supplier_id",
    [],
    ["supplier_name", "country", "city", "category", "payment_terms",
     "onboarded_date", "is_preferred", "annual_contract_value", "currency"],
)
SUPPLIERS_CTE = f"""clean_suppliers AS (
    SELECT trim(supplier_id) AS supplier_id, trim(supplier_name) AS supplier_name,
      trim(country) AS country, trim(city) AS city, trim(category) AS category,
      TRY_CAST(regexp_extract(payment_terms, 'Net ([0-9]+)', 1) AS INTEGER) AS payment_terms_days,
      CAST(onboarded_date AS DATE) AS onboarded_date,
      lower(trim(is_preferred)) IN ('yes', '1', 'true') AS is_preferred,
      CAST(round({_amount("annual_contract_value")} * {_rate("currency", _PROCUREMENT)}, 2)
        AS DECIMAL(14,2)) AS annual_contract_usd,
      upper(trim(currency)) AS currency
    FROM {_SUPPLIERS})"""
_POS = first_rows(
    "purchase_orders_raw",
    "po_id",
    [],
    ["supplier_id", "po_date", "amount", "currency", "status", "buyer_team", "line_items"],
)
PURCHASES_CTE = f"""{SUPPLIERS_CTE}, purchases AS (
    SELECT trim(p.po_id) AS po_id, trim(p.supplier_id) AS supplier_id, s.supplier_name,
      s.country AS supplier_country, CAST(p.po_date AS DATE) AS po_date,
      lower(trim(p.status)) AS status, trim(p.buyer_team) AS buyer_team,
      CAST(trim(p.line_items) AS INTEGER) AS line_items, {_amount("p.amount")} AS amount,
      CAST(round({_amount("p.amount")} * {_rate("p.currency", _PROCUREMENT)}, 2) AS DECIMAL(14,2))
        AS amount_usd
    FROM {_POS} p LEFT JOIN clean_suppliers s ON trim(p.supplier_id) = s.supplier_id)"""
_HOLDERS = first_rows(
    "billing_accounts_raw",
    "account_id",
    ["account_name"],
    ["country", "industry"],
)
HOLDERS_CTE = f"""holders AS (
    SELECT trim(account_id) AS account_id, upper(trim(country)) AS country,
      lower(trim(industry)) AS industry FROM {_HOLDERS})"""
_PLANS = first_rows(
    "plans_raw",
    "plan_id",
    ["plan_name"],
    ["tier", "billing_period", "list_price"],
)
_SUBS = first_rows(
    "subscriptions_raw",
    "subscription_id",
    ["start_date"],
    ["account_id", "plan_id", "end_date", "seats", "discount_pct", "status"],
)
# Monthly revenue in whole cents: hundredths of a cent over 100, or over 1200 for an annual plan.
SUBSCRIPTIONS_CTE = f"""{HOLDERS_CTE}, plan AS (
    SELECT trim(plan_id) AS plan_id, lower(trim(tier)) AS plan_tier,
      lower(trim(billing_period)) AS billing_period,
      CAST({_amount("list_price")} * 100 AS HUGEINT) AS cents FROM {_PLANS}),
  sub AS (
    SELECT trim(subscription_id) AS subscription_id, trim(account_id) AS account_id,
      trim(plan_id) AS plan_id, CAST(trim(start_date) AS DATE) AS start_date,
      CAST(nullif(trim(end_date), '') AS DATE) AS end_date, CAST(trim(seats) AS INTEGER) AS seats,
      CAST(trim(discount_pct) AS INTEGER) AS discount_pct, lower(trim(status)) AS status FROM {_SUBS}),
  subscriptions AS (
    SELECT s.subscription_id, s.account_id, s.plan_id, p.plan_tier, p.billing_period, s.start_date,
      s.end_date, s.seats, s.discount_pct, s.status, h.country AS account_country,
      h.industry AS account_industry,
      CAST(CASE p.billing_period
        WHEN 'annual' THEN (2 * p.cents * s.seats * (100 - s.discount_pct) + 1200) // 2400
        ELSE (2 * p.cents * s.seats * (100 - s.discount_pct) + 100) // 200 END AS DOUBLE) / 100 AS mrr_usd
    FROM sub s LEFT JOIN plan p ON s.plan_id = p.plan_id
      LEFT JOIN holders h ON s.account_id = h.account_id)"""
_INVOICES = first_rows(
    "invoices_raw",
    "invoice_id",
    ["issue_date"],
    ["account_id", "subscription_id", "invoice_type", "credit_for", "amount", "currency"],
)
_PAYMENTS = first_rows(
    "payments_raw",
    "payment_id",
    ["paid_date"],
    ["invoice_id", "amount", "currency"],
)
PAID_CTE = f"""paid AS (
    SELECT trim(invoice_id) AS invoice_id,
      CAST(round(sum({_amount("amount")} * {_rate("currency", _BILLING)}), 2) AS DECIMAL(12,2)) AS paid_usd,
      max(CAST(trim(paid_date) AS DATE)) AS last_paid_date
    FROM {_PAYMENTS} GROUP BY trim(invoice_id))"""
INVOICES_CTE = f"""{HOLDERS_CTE}, {PAID_CTE}, inv AS (
    SELECT trim(invoice_id) AS invoice_id, trim(account_id) AS account_id,
      trim(subscription_id) AS subscription_id, lower(trim(invoice_type)) AS invoice_type,
      nullif(trim(credit_for), '') AS credit_for, CAST(trim(issue_date) AS DATE) AS issue_date,
      upper(trim(currency)) AS currency,
      CAST(round({_amount("amount")} * {_rate("currency", _BILLING)}, 2) AS DECIMAL(12,2)) AS amount_usd
    FROM {_INVOICES}),
  invoices AS (
    SELECT i.invoice_id, i.account_id, i.subscription_id, i.invoice_type, i.credit_for, i.issue_date,
      i.currency, i.amount_usd, CAST(coalesce(p.paid_usd, 0) AS DECIMAL(12,2)) AS paid_usd,
      p.last_paid_date,
      CASE WHEN i.invoice_type = 'credit_note' THEN 'credit'
           WHEN coalesce(p.paid_usd, 0) >= i.amount_usd THEN 'paid'
           WHEN coalesce(p.paid_usd, 0) > 0 THEN 'partial' ELSE 'open' END AS status,
      h.country AS account_country
    FROM inv i LEFT JOIN paid p ON i.invoice_id = p.invoice_id
      LEFT JOIN holders h ON i.account_id = h.account_id)"""
SHIPMENTS_CTE = """shipments AS (
    SELECT shipment_ref AS shipment_id, warehouse_code AS warehouse_id, carrier_name AS carrier,
      CAST(shipped_at AS DATE) AS shipped_on, CAST(nullif(delivered_at, '') AS DATE) AS delivered_on,
      CASE WHEN weight LIKE '% kg' THEN CAST(replace(replace(weight, ' kg', ''), ',', '') AS DOUBLE)
           WHEN weight LIKE '% g' THEN CAST(replace(weight, ' g', '') AS DOUBLE) / 1000
           ELSE CAST(weight AS DOUBLE) END AS weight_kg,
      CAST(replace(replace(freight_charge, '$', ''), ',', '') AS DECIMAL(12,2)) AS freight_usd,
      CAST(date_diff('day', CAST(shipped_at AS DATE), CAST(nullif(delivered_at, '') AS DATE)) AS INTEGER)
        AS transit_days
    FROM carrier_feed)"""
_ESCAPED = {s.replace("'", "''"): code for s, code in CODE_OF.items()}
_CODES = ", ".join(f"('{s}', '{code}')" for s, code in _ESCAPED.items())
CODES_CTE = f"codes(spelling, code) AS (VALUES {_CODES})"
_SPELT = "trim(country, ' ' || chr(9) || chr(10))"

BILLING_VIEWS = ["billing_accounts_raw", "plans_raw", "subscriptions_raw"]
INVOICE_VIEWS = ["billing_accounts_raw", "invoices_raw", "payments_raw"]


def suppliers(v: Inputs) -> DataFrame:
    return procurement.clean_suppliers(v.suppliers_raw)


def purchases(v: Inputs) -> DataFrame:
    return procurement.purchase_orders(v.purchase_orders_raw, suppliers(v))


def subscriptions(v: Inputs) -> DataFrame:
    return billing.subscriptions_silver(v.subscriptions_raw, v.plans_raw, v.billing_accounts_raw)


def invoices(v: Inputs) -> DataFrame:
    return billing.invoices_silver(v.invoices_raw, v.payments_raw, v.billing_accounts_raw)


def shipments(v: Inputs) -> DataFrame:
    return shipping.shipments_silver(v.carrier_feed)


@query(
    "clean_crm_accounts",
    views=["crm_accounts_raw"],
    oracle=f", {ACCOUNTS_CTE} SELECT * FROM clean_accounts",
)
def _(v: Inputs) -> DataFrame:
    return accounts.clean_crm_accounts(v.crm_accounts_raw)


@query("clean_tiers", views=["crm_tiers_raw"], oracle=f", {TIERS_CTE} SELECT * FROM clean_tiers")
def _(v: Inputs) -> DataFrame:
    return accounts.clean_tiers(v.crm_tiers_raw)


@query(
    "clean_suppliers",
    views=["suppliers_raw"],
    oracle=f", {SUPPLIERS_CTE} SELECT * FROM clean_suppliers",
)
def _(v: Inputs) -> DataFrame:
    return suppliers(v)


@query(
    "purchase_orders",
    views=["suppliers_raw", "purchase_orders_raw"],
    oracle=f", {PURCHASES_CTE} SELECT * FROM purchases",
)
def _(v: Inputs) -> DataFrame:
    return purchases(v)


@query(
    "clean_billing_accounts",
    views=["billing_accounts_raw"],
    oracle=f", {HOLDERS_CTE} SELECT * FROM holders",
)
def _(v: Inputs) -> DataFrame:
    return billing.clean_billing_accounts(v.billing_accounts_raw)


@query(
    "subscriptions_silver",
    views=BILLING_VIEWS,
    oracle=f", {SUBSCRIPTIONS_CTE} SELECT * FROM subscriptions",
)
def _(v: Inputs) -> DataFrame:
    return subscriptions(v)


@query("paid_per_invoice", views=["payments_raw"], oracle=f", {PAID_CTE} SELECT * FROM paid")
def _(v: Inputs) -> DataFrame:
    return billing.paid_per_invoice(v.payments_raw)


@query(
    "invoices_silver", views=INVOICE_VIEWS, oracle=f", {INVOICES_CTE} SELECT * FROM invoices"
)
def _(v: Inputs) -> DataFrame:
    return invoices(v)


@query(
    "shipments_silver",
    views=["carrier_feed"],
    oracle=f", {SHIPMENTS_CTE} SELECT * FROM shipments",
)
def _(v: Inputs) -> DataFrame:
    return shipments(v)


@query(
    "country_iso",
    views=["country_customers_raw"],
    oracle=f""", {CODES_CTE} SELECT customer_id, code AS country FROM country_customers_raw
    JOIN codes ON spelling = {_SPELT}""",
)
def _(v: Inputs) -> DataFrame:
    return country.with_country_code(v.country_customers_raw.select("customer_id", "country"))


@query(
    "cc_customers",
    views=["country_customers_raw"],
    oracle=f""", {CODES_CTE} SELECT customer_id, customer_name, code AS country,
      CAST(signed_up_on AS DATE) AS signed_up_on
    FROM country_customers_raw JOIN codes ON spelling = {_SPELT}""",
)
def _(v: Inputs) -> DataFrame:
    return country.country_customers(v.country_customers_raw)


@query(
    "cc2_customers",
    views=["country_customers_raw"],
    oracle=f""", {CODES_CTE} SELECT customer_id, customer_name, segment, code AS country, city,
      CAST(signed_up_on AS DATE) AS signed_up_on, CAST(credit_limit AS DECIMAL(12,2)) AS credit_limit,
      is_active = 'true' AS is_active
    FROM country_customers_raw JOIN codes ON spelling = {_SPELT}""",
)
def _(v: Inputs) -> DataFrame:
    return country.country_customers_v2(v.country_customers_raw)


ORDERS_CTE = f"""{CODES_CTE}, coded_orders AS (
    SELECT order_id, customer_id, CAST(ordered_on AS DATE) AS ordered_on, product_category,
      CAST(quantity AS INTEGER) AS quantity, CAST(amount AS DECIMAL(12,2)) AS amount, channel,
      code AS country
    FROM country_orders_raw JOIN codes ON spelling = {_SPELT})"""


@query(
    "cc_orders",
    views=["country_orders_raw"],
    oracle=f", {ORDERS_CTE} SELECT order_id, customer_id, ordered_on, amount, country FROM coded_orders",
)
def _(v: Inputs) -> DataFrame:
    return country.country_orders(v.country_orders_raw)


@query(
    "cc2_orders", views=["country_orders_raw"], oracle=f", {ORDERS_CTE} SELECT * FROM coded_orders"
)
def _(v: Inputs) -> DataFrame:
    return country.country_orders_v2(v.country_orders_raw)


@query(
    "money_text",
    views=["purchase_orders_raw"],
    oracle=f"SELECT po_id, {_amount('amount')} AS amount FROM purchase_orders_raw",
)
def _(v: Inputs) -> DataFrame:
    return v.purchase_orders_raw.select("po_id", amount_text("amount").alias("amount"))


@query(
    "fx_to_usd",
    views=["purchase_orders_raw"],
    oracle=f"""SELECT po_id, upper(trim(currency)) AS currency,
      CAST(round({_amount("amount")} * {_rate("currency", _PROCUREMENT)}, 2) AS DECIMAL(14,2)) AS amount_usd
    FROM purchase_orders_raw""",
)
def _(v: Inputs) -> DataFrame:
    usd = to_usd(amount_text("amount"), "currency", PROCUREMENT_RATES)
    return v.purchase_orders_raw.select(
        "po_id", upper_code("currency").alias("currency"), usd.alias("amount_usd")
    )
