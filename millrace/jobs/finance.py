"""Reconciliation, balances, fees, risk and billing."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.checks.gates import (
    require_equal_totals,
    require_same_count,
    require_single_current,
)
from millrace.checks.reports import raw_vs_clean_counts
from millrace.functions.dates import month_start
from millrace.jobs.base import Store, exact_columns, never_null, rule, unique
from millrace.operators.keyed import net_changes
from millrace.plans import billing, customers, reconcile
from millrace.sinks import merge, tables
from millrace.sources.readers import day_slice


def reconciliation(store: Store, run_date: date) -> dict[str, int]:
    """daily_txn_raw, ledger -> daily_txn_extract -> daily_txn_clean -> daily_reconciliation_report ->
    daily_reconciliation_summary; returns the rows before and after cleaning."""
    raw = store.read("daily_txn_raw")
    extract = store.publish("daily_txn_extract", day_slice(raw, "txn_date", run_date.isoformat()))
    clean_name = store.name("daily_txn_clean")
    tables.write_checked(
        reconcile.drop_null_amounts(extract), clean_name, reconcile.AMOUNT_RULE
    )
    clean = store.read("daily_txn_clean")
    tables.overwrite_same_schema(
        reconcile.reconcile_ledger(clean, store.read("ledger")),
        store.name("daily_reconciliation_report"),
    )
    report = store.read("daily_reconciliation_report")
    store.publish("daily_reconciliation_summary", reconcile.recon_summary(report))
    return raw_vs_clean_counts(raw, clean).first().asDict()


def balances(store: Store) -> None:
    """opening_balances, customer_regions, balance_changes -> customer_balances."""
    history, opening = store.read("customer_regions"), store.read("opening_balances")
    require_single_current(history, "customer_id", "is_current")
    store.publish(
        "customer_balances", customers.balances_with_region(opening, history),
        audit=lambda rows: require_same_count(rows, opening),
    )
    changes = net_changes(store.read("balance_changes"), ["customer_id"], "change_amount")
    merge.merge_increment(
        store.spark, store.name("customer_balances"), changes, "customer_id", "balance", "change_amount"
    )


def late_fees(store: Store) -> None:
    """overdue_accounts -> late_fee_assessments_demo."""
    cap = "if(region = 'international', 50, 100)"
    store.publish(
        "late_fee_assessments_demo",
        customers.late_fees(store.read("overdue_accounts")),
        rule(f"fee_capped = (late_fee = {cap})"),
        rule("region <> 'international' OR late_fee <= 50"),
    )


def high_risk(store: Store) -> None:
    """risk_snapshot -> high_risk_accounts."""
    store.publish(
        "high_risk_accounts",
        customers.high_risk_accounts(store.read("risk_snapshot")),
        rule("NOT (tier <=> 'vip') OR abs(discrepancy) > 300"),
    )


BILLING_SOURCES = {
    "accounts": "billing.Account",
    "plans": "billing.Plan",
    "subscriptions": "billing.Subscription",
    "invoices": "billing.Invoice",
    "payments": "billing.Payment",
}


def billing_bronze(store: Store) -> None:
    """Five bl_*_raw tables -> bl_*_bronze."""
    for table, source in BILLING_SOURCES.items():
        tables.land(store.read(f"bl_{table}_raw"), store.name(f"bl_{table}_bronze"), source)


def billing_silver(store: Store) -> None:
    """Bronze -> bl_subscriptions_silver, bl_invoices_silver."""
    bronze = {table: store.read(f"bl_{table}_bronze") for table in BILLING_SOURCES}
    silver = store.publish(
        "bl_subscriptions_silver",
        billing.subscriptions_silver(bronze["subscriptions"], bronze["plans"], bronze["accounts"]),
        exact_columns(billing.SUBSCRIPTION_COLUMNS),
        unique("subscription_id"),
        never_null("mrr_usd"),
        audit=lambda rows: require_same_count(rows, bronze["subscriptions"].select(F.trim("subscription_id")).distinct()),
    )
    silver = store.publish(
        "bl_invoices_silver",
        billing.invoices_silver(bronze["invoices"], bronze["payments"], bronze["accounts"]),
        exact_columns(billing.INVOICE_COLUMNS),
        unique("invoice_id"),
        never_null("amount_usd"),
        audit=lambda rows: require_same_count(rows, bronze["invoices"].select(F.trim("invoice_id")).distinct()),
    )


def billing_gold(store: Store, as_of: date = billing.AS_OF) -> None:
    """Silver -> bl_mrr_monthly, bl_churn_cohorts, bl_ar_aging -> bl_finance_kpis."""
    subscriptions = store.read("bl_subscriptions_silver")
    this_month = F.col("month") == F.lit(month_start(as_of))
    # In the reporting month: started by then, and not ended in it or before.
    month = F.lit(month_start(as_of))
    running = subscriptions.where(
        (F.trunc("start_date", "month") <= month)
        & (F.col("end_date").isNull() | (F.trunc("end_date", "month") > month))
    )
    active = F.coalesce(F.sum("active_subscriptions"), F.lit(0))
    mrr = store.publish(
        "bl_mrr_monthly",
        billing.mrr_monthly(subscriptions, as_of),
        audit=lambda rows: require_equal_totals(rows.where(this_month), active, running, F.count(F.lit(1))),
    )

    started = F.coalesce(F.sum("subscriptions_started"), F.lit(0))
    store.publish(
        "bl_churn_cohorts",
        billing.churn_cohorts(subscriptions),
        audit=lambda rows: require_equal_totals(rows, started, subscriptions, F.count(F.lit(1))),
    )

    parts = " + ".join(name for name, _, _ in billing.AGE_BUCKETS)
    aging = store.publish(
        "bl_ar_aging",
        billing.ar_aging(store.read("bl_invoices_silver"), as_of),
        rule(f"open_usd = {parts}"),
    )

    def agrees(rows: DataFrame) -> None:
        require_equal_totals(rows, F.sum("open_ar_usd"), aging, F.sum("open_usd"))
        require_equal_totals(rows, F.sum("mrr_usd"), mrr.where(this_month), F.sum("mrr_usd"))

    store.publish("bl_finance_kpis", billing.finance_kpis(mrr, aging, as_of), unique("account_country"), audit=agrees)
