"""Master data: accounts, procurement, shipping, countries, customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.checks.gates import (
    require_equal_totals,
    require_no_orphans,
    require_same_count,
    require_totals,
)
from millrace.functions.countries import CODES
from millrace.functions.rules import PROMISED_DAYS
from millrace.jobs.base import (
    NOT_EMPTY,
    Store,
    exact_columns,
    exact_rows,
    known,
    never_null,
    pattern,
    rule,
    unique,
)
from millrace.plans import accounts, country, customers, procurement, shipping
from millrace.sinks import tables


def accounts_medallion(store: Store, expected_accounts: int | None = None) -> None:
    """sf_accounts_raw, sf_account_tier_raw -> bronze -> accounts_silver -> account_summary."""
    tables.land(store.read("sf_accounts_raw"), store.name("accounts_bronze"), "salesforce.Account")
    tables.land(
        store.read("sf_account_tier_raw"), store.name("accounts_tier_bronze"), "salesforce.AccountTier"
    )
    silver = accounts.add_tiers(
        accounts.clean_crm_accounts(store.read("accounts_bronze")),
        accounts.clean_tiers(store.read("accounts_tier_bronze")),
    )
    count = [] if expected_accounts is None else [exact_rows(expected_accounts)]
    silver = store.publish(
        "accounts_silver",
        silver,
        exact_columns([*accounts.ACCOUNT_COLUMNS, *accounts.TIER_COLUMNS]),
        unique("account_id"),
        known("industry", accounts.INDUSTRIES),
        known("tier", [*accounts.TIERS, accounts.NO_TIER]),
        *count,
    )
    kept = F.coalesce(F.sum("accounts_count"), F.lit(0))
    store.publish(
        "account_summary",
        accounts.account_summary(silver),
        audit=lambda rows: require_equal_totals(rows, kept, silver, F.count(F.lit(1))),
    )


def supplier_spend(store: Store) -> None:
    """sp_suppliers_raw, sp_purchase_orders_raw -> sp_suppliers, sp_purchase_orders ->
    sp_spend_by_country."""
    raw = store.read("sp_suppliers_raw")
    suppliers = store.publish(
        "sp_suppliers",
        procurement.clean_suppliers(raw),
        exact_columns(procurement.SUPPLIER_COLUMNS),
        never_null("annual_contract_usd"),
        audit=lambda rows: require_same_count(rows, raw.select(F.trim("supplier_id")).distinct()),
    )
    raw = store.read("sp_purchase_orders_raw")
    orders = store.publish(
        "sp_purchase_orders",
        procurement.purchase_orders(raw, suppliers),
        exact_columns(procurement.PO_COLUMNS),
        never_null("supplier_name"),
        never_null("amount_usd"),
        audit=lambda rows: require_same_count(rows, raw.select(F.trim("po_id")).distinct()),
    )
    live = orders.where(F.col("status") != "cancelled")
    count = F.count(F.lit(1))
    total = F.coalesce(F.sum("amount_usd"), F.lit(0))

    def agrees(spend: DataFrame) -> None:
        require_equal_totals(spend, F.sum("suppliers_count"), suppliers, count)
        require_totals(spend, live, orders=(F.sum("po_count"), count), spend=(F.sum("total_spend_usd"), total))

    store.publish(
        "sp_spend_by_country",
        procurement.spend_by_country(orders, suppliers),
        exact_columns(procurement.SPEND_COLUMNS),
        audit=agrees,
    )


def carrier_sla(store: Store) -> None:
    """sd_carrier_feed, sd_warehouses -> sd_shipments -> sd_carrier_sla.

    A delivery before its shipping stops the job before the report.
    """
    feed = store.read("sd_carrier_feed")
    shipments = store.publish(
        "sd_shipments",
        shipping.shipments_silver(feed),
        never_null("weight_kg"),
        exact_rows(feed.count()),
        rule("transit_days IS NULL OR transit_days >= 0"),
        known("carrier", list(PROMISED_DAYS)),
        audit=lambda rows: require_no_orphans(rows, store.read("sd_warehouses"), ["warehouse_id"]),
    )
    store.publish(
        "sd_carrier_sla",
        shipping.carrier_sla(shipments),
        audit=lambda rows: require_totals(
            rows,
            shipments,
            shipments=(F.sum("shipments_count"), F.count(F.lit(1))),
            freight=(F.sum("total_freight_usd"), F.sum("freight_usd")),
        ),
    )


_CODE = (known("country", CODES), pattern("country", "^[A-Z]{3}$"))


def country_revenue(store: Store) -> None:
    """cc_customers_raw, cc_orders_raw -> cc_customers, cc_orders -> cc_revenue_by_country."""
    people = store.publish(
        "cc_customers",
        country.country_customers(store.read("cc_customers_raw")),
        exact_columns(country.CUSTOMER_COLUMNS),
        unique("customer_id"),
        *_CODE,
    )
    orders = store.publish(
        "cc_orders",
        country.country_orders(store.read("cc_orders_raw")),
        exact_columns(country.ORDER_COLUMNS),
        unique("order_id"),
        *_CODE,
        audit=lambda rows: require_no_orphans(rows, people, ["customer_id"]),
    )
    store.publish(
        "cc_revenue_by_country",
        country.country_revenue(orders),
        unique("country"),
        *_CODE,
        audit=lambda rows: require_totals(
            rows,
            orders,
            revenue=(F.sum("revenue"), F.sum("amount")),
            orders=(F.sum("orders_count"), F.count(F.lit(1))),
        ),
    )


def country_revenue_v2(store: Store) -> None:
    """cc2_customers_raw, cc2_orders_raw -> cc2_customers, cc2_orders -> cc2_revenue_by_country."""
    people = store.publish(
        "cc2_customers",
        country.country_customers_v2(store.read("cc2_customers_raw")),
        exact_columns(country.CUSTOMER_COLUMNS_V2),
        unique("customer_id"),
        *_CODE,
    )
    orders = store.publish(
        "cc2_orders",
        country.country_orders_v2(store.read("cc2_orders_raw")),
        exact_columns(country.ORDER_COLUMNS_V2),
        unique("order_id"),
        *_CODE,
        audit=lambda rows: require_no_orphans(rows, people, ["customer_id"]),
    )
    store.publish(
        "cc2_revenue_by_country",
        country.country_revenue_v2(orders),
        unique("country"),
        *_CODE,
        audit=lambda rows: require_totals(
            rows,
            orders,
            revenue=(F.sum("revenue"), F.sum("amount")),
            orders=(F.sum("orders_count"), F.count(F.lit(1))),
            quantity=(F.sum("total_quantity"), F.sum("quantity")),
        ),
    )


def customers_in_age_band(store: Store) -> None:
    """customers -> customers_30_45."""
    store.publish("customers_30_45", customers.age_band(store.read("customers")))


def churn_scores(store: Store) -> None:
    """customer_activity -> customer_churn_scores."""
    scores = customers.churn_risk(store.read("customer_activity"))
    store.publish("customer_churn_scores", scores)


def customer_contacts(store: Store) -> None:
    """bronze_customer_contacts -> silver_customer_contacts; every number must format."""
    contacts = customers.customer_contacts(store.read("bronze_customer_contacts"))
    store.publish(
        "silver_customer_contacts", contacts, never_null("formatted_phone"), NOT_EMPTY
    )


def email_domains(store: Store) -> None:
    """customers -> customers_per_domain."""
    store.publish("customers_per_domain", customers.customers_per_domain(store.read("customers")))
