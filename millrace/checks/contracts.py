"""The contract of every published table, as check specs for `run_check_suite`."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from millrace.checks.suite import PHASES
from millrace.functions.countries import CODES
from millrace.functions.rules import PROMISED_DAYS

LATER_PHASES = ("uat", "postprod")


def contract(
    table: str,
    columns: Mapping[str, str] | None = None,
    *,
    key: Sequence[str] = (),
    rows: tuple[int, int | None] | None = None,
    never_null: Sequence[str] = (),
    known: Mapping[str, Sequence[str]] | None = None,
    within: Mapping[str, tuple[float | None, float | None]] | None = None,
    extra_columns: bool = True,
    later: Mapping[str, str] | None = None,
    phases: Sequence[str] = PHASES,
) -> dict[str, Any]:
    """Spec of one table. All checks are required except the full schema; `later` names columns that
    are checked after the branch phase only; `phases` are those of the other checks."""
    checks: list[dict[str, Any]] = []
    if columns:
        checks.append(_schema("expected_schema", columns, extra_columns, phases))
    if rows:
        low, high = rows
        limits = {"min": low} if high is None else {"min": low, "max": high}
        checks.append({"id": "row_count", "type": "row_count", **limits})
    if key:
        checks.append({"id": "one_row_per_key", "type": "uniqueness", "columns": list(key)})
    for name in never_null:
        checks.append({"id": f"{name}_not_null", "type": "null_rate", "column": name, "max_pct": 0})
    for name, values in (known or {}).items():
        checks.append(
            {"id": f"{name}_is_known", "type": "accepted_values", "column": name, "values": list(values)}
        )
    for name, (low, high) in (within or {}).items():
        checks.append({"id": f"{name}_in_range", "type": "range", "column": name, "min": low, "max": high})
    if later:
        checks.append(_schema("later_schema", later, True, LATER_PHASES))
    for check in checks:
        check.setdefault("phases", list(phases))
        if later and check.get("column") in later:
            check["phases"] = list(LATER_PHASES)
    required = [c["id"] for c in checks if c["id"] != "expected_schema"]
    return {"table": table, "version": 1, "checks": checks, "required": required}


def _schema(
    check_id: str, columns: Mapping[str, str], extra: bool, phases: Sequence[str]
) -> dict[str, Any]:
    declared = [{"name": n, "type": t} for n, t in columns.items()]
    return {
        "id": check_id,
        "type": "schema",
        "columns": declared,
        "allow_extra_columns": extra,
        "phases": list(phases),
    }


def _texts(*names: str) -> dict[str, str]:
    return dict.fromkeys(names, "string")


_MONEY_14, _MONEY_12, _MONEY_16 = "decimal(14,2)", "decimal(12,2)", "decimal(16,2)"
_TIERS = ("Gold", "Silver", "Bronze", "Unassigned")
_COUNTRIES = {"country": CODES}
_CARRIERS = {"carrier": tuple(PROMISED_DAYS)}
_PERSON = {
    "customer_id": "string",
    "customer_name": "string",
    "age": "int",
    "income": "int",
    "distance_to_store": "double",
    "urbanicity": "string",
    "climate_zone": "string",
    "search_specificity": "int",
    "spec_expansion_rate": "double",
    "bundle_affinity": "double",
    "price_sort_frequency": "double",
    "total_spend_12mo": "double",
    "purchase_frequency": "int",
    "recency_days": "int",
    "avg_order_value": "double",
    "dominant_category": "string",
    "brand_loyalty": "string",
    "return_rate": "double",
    "channel_preference": "string",
    "join_date": "date",
    "true_persona": "string",
    "email": "string",
    "churn_risk_score": "double",
    "churn_risk_tier": "string",
    "churn_reasons": "string",
}

# Columns, types, keys, accepted values and limits of the published tables.
_ALL = [
    contract("customers", _PERSON, key=["customer_id"], rows=(1, None), phases=("postprod",)),
    contract(
        "customers_30_45",
        _PERSON,
        key=["customer_id"],
        rows=(1, None),
        never_null=["age"],
        known={"age": [str(age) for age in range(30, 46)]},
        extra_columns=False,
    ),
    contract(
        "accounts_bronze",
        _texts(
            "account_id", "account_name", "industry", "billing_country", "annual_revenue",
            "employee_count", "created_date", "owner_team", "source_object",
        ),
        rows=(1, None),
    ),
    contract(
        "accounts_silver",
        {
            **_texts("account_id", "account_name", "industry", "billing_country"),
            "annual_revenue": _MONEY_14,
            "employee_count": "int",
            "created_date": "date",
            "owner_team": "string",
        },
        key=["account_id"],
        never_null=["annual_revenue", "tier"],
        known={
            "industry": ("Software", "Retail", "Healthcare", "Finance", "Manufacturing"),
            "tier": _TIERS,
        },
        within={"employee_count": (1, 100_000)},
        later={
            "tier": "string", "tier_since": "date", "renewal_date": "date", "is_strategic": "boolean",
        },
    ),
    contract(
        "account_summary",
        {
            **_texts("industry", "billing_country"),
            "accounts_count": "bigint",
            "total_revenue": _MONEY_16,
            "avg_revenue": _MONEY_14,
            "total_employees": "bigint",
            "first_created": "date",
            "last_created": "date",
        },
        key=["industry", "billing_country"],
        rows=(1, None),
        later={"strategic_accounts": "bigint"},
    ),
    contract("bl_accounts_bronze", rows=(4000, None)),
    contract("bl_plans_bronze", rows=(20, None)),
    contract("bl_subscriptions_bronze", rows=(6000, None)),
    contract("bl_invoices_bronze", rows=(40_000, None)),
    contract("bl_payments_bronze", rows=(30_000, None)),
    contract(
        "bl_subscriptions_silver",
        {
            **_texts("subscription_id", "account_id", "plan_id", "plan_tier", "billing_period"),
            "start_date": "date",
            "end_date": "date",
            "seats": "int",
            "discount_pct": "int",
            **_texts("status", "account_country", "account_industry"),
            "mrr_usd": "double",
        },
        key=["subscription_id"],
        known={
            "status": ("active", "cancelled"),
            "plan_tier": ("starter", "growth", "business", "enterprise"),
        },
        within={"mrr_usd": (0, None)},
    ),
    contract(
        "bl_invoices_silver",
        {
            **_texts("invoice_id", "account_id", "subscription_id", "invoice_type", "credit_for"),
            "issue_date": "date",
            "currency": "string",
            "amount_usd": _MONEY_12,
            "paid_usd": _MONEY_12,
            "last_paid_date": "date",
            **_texts("status", "account_country"),
        },
        key=["invoice_id"],
        known={
            "invoice_type": ("invoice", "credit_note"),
            "status": ("paid", "partial", "open", "credit"),
        },
        within={"amount_usd": (0, None)},
    ),
    contract(
        "bl_mrr_monthly",
        {
            "month": "date",
            **_texts("account_country", "plan_tier"),
            "active_subscriptions": "bigint",
            "mrr_usd": _MONEY_14,
        },
        key=["month", "account_country", "plan_tier"],
        within={"mrr_usd": (0, None)},
    ),
    contract(
        "bl_churn_cohorts",
        {
            "cohort_month": "date",
            "subscriptions_started": "bigint",
            "churned_within_3m": "bigint",
            "churn_rate_3m_pct": "decimal(5,2)",
        },
        key=["cohort_month"],
        within={"churn_rate_3m_pct": (0, 100)},
    ),
    contract(
        "bl_ar_aging",
        {
            **_texts("account_id", "account_country"),
            "open_invoices": "bigint",
            "open_usd": _MONEY_14,
            "bucket_0_30_usd": _MONEY_14,
            "bucket_31_60_usd": _MONEY_14,
            "bucket_61_90_usd": _MONEY_14,
            "bucket_90_plus_usd": _MONEY_14,
        },
        key=["account_id"],
        within={"open_usd": (0, None)},
    ),
    contract(
        "bl_finance_kpis",
        {
            "account_country": "string",
            "mrr_usd": _MONEY_14,
            "arr_usd": _MONEY_16,
            "open_ar_usd": _MONEY_14,
            "overdue_90_pct": "decimal(5,1)",
            "dso_days": "decimal(8,1)",
        },
        key=["account_country"],
        rows=(5, 5),
        known={"account_country": ("AU", "DE", "GB", "IN", "US")},
        within={"overdue_90_pct": (0, 100)},
    ),
    contract(
        "sp_suppliers",
        {
            **_texts("supplier_id", "supplier_name", "country", "city", "category"),
            "payment_terms_days": "int",
            "onboarded_date": "date",
            "is_preferred": "boolean",
            "annual_contract_usd": _MONEY_14,
            "currency": "string",
        },
        key=["supplier_id"],
        rows=(1, None),
        never_null=["country"],
    ),
    contract(
        "sp_purchase_orders",
        {
            **_texts("po_id", "supplier_id", "supplier_name", "supplier_country"),
            "po_date": "date",
            **_texts("status", "buyer_team"),
            "line_items": "int",
            "amount": _MONEY_14,
            "amount_usd": _MONEY_14,
        },
        key=["po_id"],
        rows=(1, None),
        never_null=["amount_usd"],
        known={"status": ("received", "open", "cancelled")},
    ),
    contract(
        "sp_spend_by_country",
        {
            "supplier_country": "string",
            "suppliers_count": "bigint",
            "preferred_suppliers": "bigint",
            "po_count": "bigint",
            "total_spend_usd": _MONEY_16,
            "avg_po_usd": _MONEY_14,
            "open_po_usd": _MONEY_16,
            "first_po_date": "date",
            "last_po_date": "date",
        },
        rows=(1, None),
        never_null=["total_spend_usd"],
    ),
    contract(
        "sd_warehouses",
        {
            **_texts("warehouse_id", "warehouse_name", "region", "city"),
            "capacity_pallets": "bigint",
            "opened_on": "date",
            "ops_team": "string",
            "is_active": "boolean",
        },
        key=["warehouse_id"],
        rows=(12, 12),
        known={"region": ("North", "South", "East", "West", "Central")},
    ),
    contract(
        "sd_shipments",
        {
            **_texts("shipment_id", "warehouse_id", "carrier"),
            "shipped_on": "date",
            "delivered_on": "date",
            "weight_kg": "double",
            "freight_usd": _MONEY_12,
            "transit_days": "int",
        },
        key=["shipment_id"],
        rows=(120, None),
        never_null=["weight_kg", "freight_usd"],
        known=_CARRIERS,
    ),
    contract(
        "sd_carrier_sla",
        {
            "carrier": "string",
            "shipments_count": "bigint",
            "delivered_count": "bigint",
            "on_time_count": "bigint",
            "on_time_pct": "decimal(5,1)",
            "avg_transit_days": "decimal(6,2)",
            "total_freight_usd": _MONEY_14,
            "freight_per_kg": "decimal(10,2)",
        },
        key=["carrier"],
        rows=(4, 4),
        never_null=["freight_per_kg"],
        known=_CARRIERS,
    ),
    contract(
        "cc_customers",
        _texts("customer_id", "customer_name", "country"),
        key=["customer_id"],
        rows=(1, None),
        never_null=["country"],
        known=_COUNTRIES,
    ),
    contract(
        "cc_orders",
        {**_texts("order_id", "customer_id"), "amount": _MONEY_12, "country": "string"},
        key=["order_id"],
        rows=(1, None),
        never_null=["customer_id"],
        known=_COUNTRIES,
    ),
    contract(
        "cc_revenue_by_country",
        {"country": "string", "orders_count": "bigint", "revenue": _MONEY_14},
        key=["country"],
        rows=(1, None),
        never_null=["revenue"],
        known=_COUNTRIES,
    ),
    contract(
        "cc2_customers",
        {
            **_texts("customer_id", "customer_name", "segment", "country", "city"),
            "signed_up_on": "date",
            "credit_limit": _MONEY_12,
            "is_active": "boolean",
        },
        key=["customer_id"],
        rows=(1, None),
        never_null=["country"],
        known={**_COUNTRIES, "segment": ("Retail", "SMB", "Enterprise")},
    ),
    contract(
        "cc2_orders",
        {
            **_texts("order_id", "customer_id"),
            "ordered_on": "date",
            "product_category": "string",
            "quantity": "int",
            "amount": _MONEY_12,
            **_texts("channel", "country"),
        },
        key=["order_id"],
        rows=(1, None),
        never_null=["customer_id"],
        known={
            **_COUNTRIES,
            "channel": ("Web", "Store", "Partner"),
            "product_category": ("Electronics", "Home", "Fashion", "Grocery", "Sports"),
        },
    ),
    contract(
        "cc2_revenue_by_country",
        {
            "country": "string",
            "orders_count": "bigint",
            "customers_count": "bigint",
            "total_quantity": "bigint",
            "revenue": _MONEY_14,
            "avg_order_value": _MONEY_12,
            "first_order_on": "date",
            "last_order_on": "date",
        },
        key=["country"],
        rows=(1, None),
        never_null=["revenue"],
        known=_COUNTRIES,
    ),
    contract(
        "late_fee_assessments_demo",
        {"account_id": "string", "region": "string", "late_fee": "double"},
        key=["account_id"],
        rows=(1, None),
        never_null=["account_id", "late_fee"],
    ),
    contract(
        "customer_balances",
        {"customer_id": "string", "balance": "double"},
        key=["customer_id"],
        rows=(1, None),
        never_null=["customer_id"],
    ),
]

CONTRACTS = {spec["table"]: spec for spec in _ALL}
