"""Reports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import distincts
from millrace.operators.keyed import net_changes
from millrace.plans import accounts, billing, country, orders, procurement, reconcile, sales, shipping
from millrace.registry import cleaning
from millrace.registry.base import Inputs, half_up, query, typed
from millrace.registry.io import _DAILY, _RECONCILE, daily, reconciled
from millrace.registry.joins import SILVER_CTE, accounts_silver
from millrace.sinks import merge, scratch

# The last day the derived billing tables are reported for.
AS_OF = date(2001, 9, 30)


@query("daily_sales", views=["sales_transactions"], oracle=_DAILY)
def _(v: Inputs) -> DataFrame:
    return daily(v.sales_transactions)


@query("daily_sales_maintained", views=["sales_transactions"], oracle=_DAILY)
def _(v: Inputs) -> DataFrame:
    """Two deliveries, the first with rows at a wrong price that the second takes back and restates."""
    table = f"{scratch.scratch_database(v.spark)}.daily_sales_states"
    rows = v.sales_transactions.withColumn("sign", F.lit(1))
    early, wrong = F.col("sale_date") < "1996-01-01", F.pmod(F.hash("transaction_id"), F.lit(10)) == 0
    mispriced = typed(rows.where(early & wrong).withColumn("revenue", F.col("revenue") + 1), revenue=dict(rows.dtypes)["revenue"])
    merge.merge_states(v.spark, table, sales.DAILY_STATES, rows.where(early & ~wrong).unionByName(mispriced), "sign")
    taken_back = mispriced.withColumn("sign", F.lit(-1))
    later = rows.where(~early).unionByName(rows.where(early & wrong)).unionByName(taken_back)
    merge.merge_states(v.spark, table, sales.DAILY_STATES, later, "sign")
    return typed(
        sales.daily_sales_of(v.spark.table(table)), total_revenue="decimal(22,2)", avg_order_value="decimal(18,6)", total_units="bigint"
    )


@query(
    "customer_summary",
    views=["discount_amount_orders"],
    oracle=f"""SELECT customer_id, CAST(sum(order_amount) AS DECIMAL(22,2)) AS total_order_amount,
      {half_up("sum(discount_pct) * 100", "count(*) * 100", 6)} AS avg_discount_pct,
      count(order_id) AS order_count FROM discount_amount_orders GROUP BY customer_id""",
)
def _(v: Inputs) -> DataFrame:
    return typed(
        orders.customer_summary(v.discount_amount_orders),
        total_order_amount="decimal(22,2)",
        avg_discount_pct="decimal(18,6)",
    )


@query(
    "regional_revenue",
    views=["regional_orders"],
    oracle="""SELECT region_code, CAST(sum(order_amount) AS DECIMAL(22,2)) AS total_revenue
    FROM regional_orders GROUP BY region_code""",
)
def _(v: Inputs) -> DataFrame:
    clean = v.regional_orders.drop("region_code_legacy")
    return typed(sales.regional_revenue(clean), total_revenue="decimal(22,2)")


@query(
    "recon_summary",
    views=["transactions", "ledger"],
    oracle=f""", report AS ({_RECONCILE})
    SELECT count(*) AS accounts_checked,
      count(*) FILTER (WHERE discrepancy <> 0) AS accounts_with_discrepancy,
      CAST(sum(discrepancy) AS DECIMAL(33,2)) AS net_discrepancy,
      {half_up("sum(abs(discrepancy)) * 100", "count(*) * 100", 6, 27)} AS avg_abs_discrepancy
    FROM report""",
)
def _(v: Inputs) -> DataFrame:
    return typed(
        reconcile.recon_summary(reconciled(v)),
        net_discrepancy="decimal(33,2)",
        avg_abs_discrepancy="decimal(27,6)",
    )


@query(
    "net_changes",
    views=["balance_changes"],
    oracle="""SELECT customer_id, CAST(sum(change_amount) AS DECIMAL(22,2)) AS change_amount
    FROM balance_changes GROUP BY customer_id""",
)
def _(v: Inputs) -> DataFrame:
    return typed(
        net_changes(v.balance_changes, ["customer_id"], "change_amount"),
        change_amount="decimal(22,2)",
    )


_COUNTRY_REVENUE = f""", {cleaning.ORDERS_CTE} SELECT country, count(*) AS orders_count,
      CAST(sum(amount) AS DECIMAL(14,2)) AS revenue FROM coded_orders GROUP BY country"""


@query("country_revenue", views=["country_orders_raw"], oracle=_COUNTRY_REVENUE)
def _(v: Inputs) -> DataFrame:
    return country.country_revenue(country.country_orders(v.country_orders_raw))


@query("country_revenue_maintained", views=["country_orders_raw"], oracle=_COUNTRY_REVENUE)
def _(v: Inputs) -> DataFrame:
    """Two deliveries; the first holds some orders twice, which the second takes back."""
    table = f"{scratch.scratch_database(v.spark)}.country_revenue_states"
    rows = country.country_orders(v.country_orders_raw).withColumn("sign", F.lit(1))
    early = F.col("ordered_on") < "1995-01-01"
    first = rows.where(early)
    twice = first.where(F.pmod(F.hash("order_id"), F.lit(10)) == 0)
    merge.merge_states(v.spark, table, country.REVENUE_STATES, first.unionByName(twice), "sign")
    later = rows.where(~early).unionByName(twice.withColumn("sign", F.lit(-1)))
    merge.merge_states(v.spark, table, country.REVENUE_STATES, later, "sign")
    return country.country_revenue_of(v.spark.table(table))


@query(
    "country_revenue_v2",
    views=["country_orders_raw"],
    oracle=f""", {cleaning.ORDERS_CTE} SELECT country, count(*) AS orders_count,
      count(DISTINCT customer_id) AS customers_count, CAST(sum(quantity) AS BIGINT) AS total_quantity,
      CAST(sum(amount) AS DECIMAL(14,2)) AS revenue,
      {half_up("sum(amount) * 100", "count(*) * 100", 2, 12)} AS avg_order_value,
      min(ordered_on) AS first_order_on, max(ordered_on) AS last_order_on
    FROM coded_orders GROUP BY country""",
)
def _(v: Inputs) -> DataFrame:
    return country.country_revenue_v2(country.country_orders_v2(v.country_orders_raw))


@query(
    "customers_rolled_up",
    views=["country_orders_raw"],
    oracle=f""", {cleaning.ORDERS_CTE} SELECT CAST(2 - grouping(country) - grouping(channel) AS INTEGER) AS level,
      country, channel, count(DISTINCT customer_id) AS customers_count
    FROM coded_orders GROUP BY ROLLUP (country, channel)""",
)
def _(v: Inputs) -> DataFrame:
    """Kept sets of customers, to which two deliveries were added, the first of them twice."""
    place = scratch.scratch_database(v.spark)
    states, numbers, keys = f"{place}.customer_sets", f"{place}.customer_numbers", ["country", "channel"]
    rows = country.country_orders_v2(v.country_orders_raw)
    early = F.col("ordered_on") < "1995-01-01"
    for delivery in (rows.where(early), rows.where(~early), rows.where(early)):
        distincts.add_distincts(v.spark, states, numbers, delivery, keys, "customer_id")
    distincts.compact_distincts(v.spark, states, keys)
    return distincts.distinct_levels(v.spark.table(states), keys, "customers_count")


@query(
    "owner_teams_rolled_up",
    views=["crm_accounts_raw", "crm_tiers_raw"],
    oracle=f""", {SILVER_CTE} SELECT CAST(2 - grouping(industry) - grouping(billing_country) AS INTEGER) AS level,
      industry, billing_country, count(DISTINCT region_owner_team) AS region_owner_teams
    FROM accounts_silver WHERE region_owner_team IS NOT NULL GROUP BY ROLLUP (industry, billing_country)""",
)
def _(v: Inputs) -> DataFrame:
    place = scratch.scratch_database(v.spark)
    states, numbers, keys = f"{place}.team_sets", f"{place}.team_numbers", ["industry", "billing_country"]
    distincts.add_distincts(v.spark, states, numbers, accounts_silver(v), keys, "region_owner_team")
    return distincts.distinct_levels(v.spark.table(states), keys, "region_owner_teams")


@query(
    "carrier_sla",
    views=["carrier_feed"],
    oracle=f""", {cleaning.SHIPMENTS_CTE}, judged AS (
      SELECT *, transit_days <= CASE carrier WHEN 'Northwind Freight' THEN 3 WHEN 'Kestrel Express' THEN 2
        WHEN 'Harbor Line' THEN 5 WHEN 'Atlas Parcel' THEN 4 END AS punctual FROM shipments)
    SELECT carrier, count(*) AS shipments_count, count(delivered_on) AS delivered_count,
      count(*) FILTER (WHERE punctual) AS on_time_count,
      {half_up("count(*) FILTER (WHERE punctual) * 100", "count(delivered_on)", 1, 5)} AS on_time_pct,
      {half_up("sum(transit_days)", "count(transit_days)", 2, 6)} AS avg_transit_days,
      CAST(sum(freight_usd) AS DECIMAL(14,2)) AS total_freight_usd,
      {half_up("sum(freight_usd) * 1000000", "sum(CAST(weight_kg AS DECIMAL(18,6))) * 1000000", 2, 10)}
        AS freight_per_kg
    FROM judged GROUP BY carrier""",
)
def _(v: Inputs) -> DataFrame:
    return shipping.carrier_sla(cleaning.shipments(v))


def _tier_revenue(tier: str) -> str:
    return (
        f"CAST(sum(annual_revenue) FILTER (WHERE tier = '{tier}') AS DECIMAL(16,2)) "
        f"AS revenue_{tier.lower()}"
    )


@query(
    "account_summary",
    views=["crm_accounts_raw", "crm_tiers_raw"],
    oracle=f""", {SILVER_CTE}, q AS (SELECT *, renewal_date >= DATE '2026-10-01'
        AND renewal_date < DATE '2027-01-01' AS in_q4 FROM accounts_silver)
    SELECT industry, billing_country, count(*) AS accounts_count,
      CAST(sum(annual_revenue) AS DECIMAL(16,2)) AS total_revenue,
      {half_up("sum(annual_revenue) * 100", "count(annual_revenue) * 100", 2, 14)} AS avg_revenue,
      CAST(sum(employee_count) AS BIGINT) AS total_employees, min(created_date) AS first_created,
      max(created_date) AS last_created, count(*) FILTER (WHERE is_strategic) AS strategic_accounts,
      {", ".join(_tier_revenue(t) for t in ("Gold", "Silver", "Bronze", "Unassigned"))},
      count(*) FILTER (WHERE in_q4) AS renewals_q4,
      CAST(coalesce(sum(annual_revenue) FILTER (WHERE in_q4), 0) AS DECIMAL(16,2)) AS renewal_revenue_q4,
      count(DISTINCT region_owner_team) AS region_owner_teams
    FROM q GROUP BY industry, billing_country""",
)
def _(v: Inputs) -> DataFrame:
    return accounts.account_summary(accounts_silver(v))


@query(
    "spend_by_country",
    views=["suppliers_raw", "purchase_orders_raw"],
    oracle=f""", {cleaning.PURCHASES_CTE}, live AS (
      SELECT supplier_country, count(*) AS n, sum(amount_usd) AS spend, count(amount_usd) AS priced,
        sum(amount_usd) FILTER (WHERE status = 'open') AS open_spend, min(po_date) AS first_day,
        max(po_date) AS last_day
      FROM purchases WHERE status IN ('open', 'received') GROUP BY supplier_country)
    SELECT c.country AS supplier_country, c.suppliers_count, c.preferred_suppliers,
      coalesce(l.n, 0) AS po_count, CAST(coalesce(l.spend, 0) AS DECIMAL(16,2)) AS total_spend_usd,
      {half_up("l.spend * 100", "l.priced * 100", 2, 14)} AS avg_po_usd,
      CAST(coalesce(l.open_spend, 0) AS DECIMAL(16,2)) AS open_po_usd, l.first_day AS first_po_date,
      l.last_day AS last_po_date
    FROM (SELECT country, count(*) AS suppliers_count,
            count(*) FILTER (WHERE is_preferred) AS preferred_suppliers
          FROM clean_suppliers GROUP BY country) c
      LEFT JOIN live l ON c.country = l.supplier_country""",
)
def _(v: Inputs) -> DataFrame:
    return procurement.spend_by_country(cleaning.purchases(v), cleaning.suppliers(v))


_MRR_CTE = f"""{cleaning.SUBSCRIPTIONS_CTE}, spans AS (
    SELECT account_country, plan_tier, CAST(mrr_usd AS DECIMAL(14,2)) AS mrr,
      date_trunc('month', start_date) AS first_month,
      CASE WHEN end_date IS NULL THEN DATE '2001-09-01'
           ELSE date_trunc('month', end_date) - INTERVAL 1 MONTH END AS last_month
    FROM subscriptions),
  mrr AS (
    SELECT CAST(month AS DATE) AS month, account_country, plan_tier, count(*) AS active_subscriptions,
      CAST(sum(mrr) AS DECIMAL(14,2)) AS mrr_usd
    FROM (SELECT *, unnest(generate_series(CAST(first_month AS TIMESTAMP), CAST(last_month AS TIMESTAMP),
            INTERVAL 1 MONTH)) AS month FROM spans)
    GROUP BY ALL)"""


@query("mrr_monthly", views=cleaning.BILLING_VIEWS, oracle=f", {_MRR_CTE} SELECT * FROM mrr")
def _(v: Inputs) -> DataFrame:
    return billing.mrr_monthly(cleaning.subscriptions(v), AS_OF)


@query(
    "churn_cohorts",
    views=cleaning.BILLING_VIEWS,
    oracle=f""", {cleaning.SUBSCRIPTIONS_CTE}, early AS (
      SELECT CAST(date_trunc('month', start_date) AS DATE) AS cohort_month,
        CASE WHEN end_date < start_date + INTERVAL 3 MONTHS THEN 1 END AS churned FROM subscriptions)
    SELECT cohort_month, count(*) AS subscriptions_started, count(churned) AS churned_within_3m,
      {half_up("count(churned) * 100", "count(*)", 2, 5)} AS churn_rate_3m_pct
    FROM early GROUP BY cohort_month""",
)
def _(v: Inputs) -> DataFrame:
    return billing.churn_cohorts(cleaning.subscriptions(v))


def _aged(name: str, condition: str) -> str:
    return f"CAST(coalesce(sum(owed) FILTER (WHERE {condition}), 0) AS DECIMAL(14,2)) AS {name}"


_AGING_CTE = f"""{cleaning.INVOICES_CTE}, unpaid AS (
    SELECT account_id, account_country, amount_usd - paid_usd AS owed,
      date_diff('day', issue_date, DATE '2001-09-30') AS age
    FROM invoices WHERE invoice_type = 'invoice' AND status IN ('open', 'partial')),
  aging AS (
    SELECT account_id, account_country, count(*) AS open_invoices,
      CAST(sum(owed) AS DECIMAL(14,2)) AS open_usd, {_aged("bucket_0_30_usd", "age <= 30")},
      {_aged("bucket_31_60_usd", "age BETWEEN 31 AND 60")},
      {_aged("bucket_61_90_usd", "age BETWEEN 61 AND 90")}, {_aged("bucket_90_plus_usd", "age >= 91")}
    FROM unpaid GROUP BY account_id, account_country)"""


@query("ar_aging", views=cleaning.INVOICE_VIEWS, oracle=f", {_AGING_CTE} SELECT * FROM aging")
def _(v: Inputs) -> DataFrame:
    return billing.ar_aging(cleaning.invoices(v), AS_OF)


_ALL_BILLING = [*cleaning.BILLING_VIEWS, "invoices_raw", "payments_raw"]
_INVOICES_ONLY = _AGING_CTE.removeprefix(cleaning.HOLDERS_CTE)
_SIDES_CTE = f"""{_MRR_CTE}{_INVOICES_ONLY}, sides AS (
    SELECT coalesce(m.account_country, a.account_country) AS account_country,
      coalesce(m.mrr, 0) AS mrr, coalesce(a.open_ar, 0) AS open_ar, coalesce(a.overdue, 0) AS overdue
    FROM (SELECT account_country, sum(mrr_usd) AS mrr FROM mrr WHERE month = DATE '2001-09-01'
          GROUP BY account_country) m
      FULL JOIN (SELECT account_country, sum(open_usd) AS open_ar, sum(bucket_90_plus_usd) AS overdue
                 FROM aging GROUP BY account_country) a ON m.account_country = a.account_country)"""


@query(
    "kpi_full_outer",
    views=_ALL_BILLING,
    oracle=f""", {_SIDES_CTE} SELECT account_country, CAST(mrr AS DECIMAL(24,2)) AS mrr,
      CAST(open_ar AS DECIMAL(24,2)) AS open_ar, CAST(overdue AS DECIMAL(24,2)) AS overdue FROM sides""",
)
def _(v: Inputs) -> DataFrame:
    mrr = billing.mrr_monthly(cleaning.subscriptions(v), AS_OF)
    sides = billing.kpi_sides(mrr, billing.ar_aging(cleaning.invoices(v), AS_OF), AS_OF)
    return typed(sides, mrr="decimal(24,2)", open_ar="decimal(24,2)", overdue="decimal(24,2)")


@query(
    "finance_kpis",
    views=_ALL_BILLING,
    oracle=f""", {_SIDES_CTE} SELECT account_country, CAST(mrr AS DECIMAL(14,2)) AS mrr_usd,
      CAST(mrr * 12 AS DECIMAL(16,2)) AS arr_usd, CAST(open_ar AS DECIMAL(14,2)) AS open_ar_usd,
      CAST(CASE WHEN open_ar > 0 THEN {half_up("overdue * 10000", "nullif(open_ar * 100, 0)", 1, 5)}
           ELSE 0 END AS DECIMAL(5,1)) AS overdue_90_pct,
      CASE WHEN mrr > 0 THEN {half_up("open_ar * 3000", "nullif(mrr * 100, 0)", 1, 8)} END AS dso_days
    FROM sides""",
)
def _(v: Inputs) -> DataFrame:
    mrr = billing.mrr_monthly(cleaning.subscriptions(v), AS_OF)
    return billing.finance_kpis(mrr, billing.ar_aging(cleaning.invoices(v), AS_OF), AS_OF)
