"""Checks, one result row each."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.checks import reports
from millrace.checks.contracts import CONTRACTS
from millrace.checks.suite import check_states, report_of_states, run_check_suite
from millrace.functions.dates import month_start
from millrace.functions.money import PROCUREMENT_RATES
from millrace.functions.text import lookup, upper_code
from millrace.plans import accounts, billing, country, customers, procurement, reconcile, sales
from millrace.registry import cleaning
from millrace.registry.aggregates import _AGING_CTE, _ALL_BILLING, _MRR_CTE, AS_OF
from millrace.registry.base import Inputs, query
from millrace.registry.joins import SILVER_CTE, accounts_silver
from millrace.sinks import scratch, tables


def _suite(df: DataFrame, *checks: dict[str, Any]) -> DataFrame:
    return run_check_suite(df, {"checks": checks, "required": [c["id"] for c in checks]})


def _row(check_id: str, kind: str, violations: str, rows: str = "count(*)") -> str:
    """A suite result in SQL; `violations` and `rows` are aggregates."""
    return (
        f"SELECT '{check_id}' AS check_id, '{kind}' AS check_type, TRUE AS required, "
        f"CAST({rows} AS BIGINT) AS rows_checked, CAST({violations} AS BIGINT) AS violations, "
        f"({violations}) = 0 AS passed"
    )


@query(
    "check_schema",
    views=["crm_accounts_raw"],
    oracle=f""", typed AS (SELECT typeof(annual_revenue) <> 'DECIMAL(14,2)' AS revenue,
        typeof(employee_count) <> 'INTEGER' AS employees, typeof(account_id) <> 'VARCHAR' AS id FROM crm_accounts_raw)
    {_row("expected", "schema", "CAST(any_value(id) AS INT)")} FROM typed UNION ALL
    {_row("mistyped", "schema", "CAST(any_value(revenue) AS INT) + CAST(any_value(employees) AS INT)")} FROM typed""",
)
def _(v: Inputs) -> DataFrame:
    """The raw table has none of the cleaned numeric types: two declared columns differ."""
    declared = {"account_id": "string", "annual_revenue": "decimal(14,2)", "employee_count": "int"}
    raw = [{"name": n, "type": "string"} for n in v.crm_accounts_raw.columns]
    clean = [{"name": n, "type": t} for n, t in declared.items()]
    return _suite(
        v.crm_accounts_raw,
        {"id": "expected", "type": "schema", "columns": raw, "allow_extra_columns": False},
        {"id": "mistyped", "type": "schema", "columns": clean},
    )


@query(
    "check_columns",
    views=["suppliers_raw"],
    oracle=f""", {cleaning.SUPPLIERS_CTE}, named AS (SELECT
      string_agg(name, ',') AS names FROM (SELECT unnest(json_keys(to_json(t))) AS name
        FROM (SELECT * FROM clean_suppliers LIMIT 1) AS t))
    {_row('column_order', 'columns', f"CAST(any_value(names) <> '{','.join(procurement.SUPPLIER_COLUMNS)}' AS INT)")}
      FROM clean_suppliers, named UNION ALL
    {_row('one_lost', 'columns', f"CAST(any_value(names) <> '{','.join(procurement.SUPPLIER_COLUMNS[:-1])}' AS INT)")}
      FROM clean_suppliers, named""",
)
def _(v: Inputs) -> DataFrame:
    return _suite(
        cleaning.suppliers(v),
        {"id": "column_order", "type": "columns", "columns": procurement.SUPPLIER_COLUMNS},
        {"id": "one_lost", "type": "columns", "columns": procurement.SUPPLIER_COLUMNS[:-1]},
    )


@query(
    "check_row_count",
    oracle=f"""{_row("enough", "row_count", "greatest(5000 - count(*), 0)")} FROM lineitem UNION ALL
    {_row("at_most", "row_count", "greatest(count(*) - 5000, 0)")} FROM lineitem""",
)
def _(v: Inputs) -> DataFrame:
    return _suite(
        v.table("lineitem"),
        {"id": "enough", "type": "row_count", "min": 5000},
        {"id": "at_most", "type": "row_count", "max": 5000},
    )


@query(
    "check_not_empty",
    oracle=_row("has_rows", "row_count", "CASE WHEN count(*) = 0 THEN 1 ELSE 0 END") + " FROM orders",
)
def _(v: Inputs) -> DataFrame:
    return _suite(v.table("orders"), {"id": "has_rows", "type": "row_count", "min": 1})


@query(
    "check_uniqueness",
    oracle=f"""{_row("order_key", "uniqueness", "count(*) - count(DISTINCT o_orderkey)")} FROM orders
    UNION ALL {_row("line_key", "uniqueness", "count(*) FILTER (WHERE n > 1)", "sum(n)")}
    FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
)
def _(v: Inputs) -> DataFrame:
    """Line keys do repeat."""
    unique = _suite(
        v.table("orders"), {"id": "order_key", "type": "uniqueness", "columns": ["o_orderkey"]}
    )
    repeated = _suite(
        v.table("lineitem"),
        {"id": "line_key", "type": "uniqueness", "columns": ["l_orderkey", "l_linenumber"]},
    )
    return unique.unionByName(repeated)


_NULL_AMOUNTS = "count(*) FILTER (WHERE amount IS NULL)"


@query(
    "check_null_rate",
    views=["transactions"],
    oracle=f"""{_row("none", "null_rate", _NULL_AMOUNTS)} FROM transactions UNION ALL
    {_row("half", "null_rate", f"CASE WHEN {_NULL_AMOUNTS} > count(*) * 0.5 THEN {_NULL_AMOUNTS} ELSE 0 END")}
    FROM transactions""",
)
def _(v: Inputs) -> DataFrame:
    return _suite(
        v.transactions,
        {"id": "none", "type": "null_rate", "column": "amount", "max_pct": 0},
        {"id": "half", "type": "null_rate", "column": "amount", "max_pct": 50},
    )


@query(
    "check_no_nulls",
    views=["sales_transactions"],
    oracle=" UNION ALL ".join(
        f"{_row(c, 'null_rate', f'count(*) - count({c})')} FROM sales_transactions"
        for c in ("transaction_id", "store_id", "revenue")
    ),
)
def _(v: Inputs) -> DataFrame:
    required = ("transaction_id", "store_id", "revenue")
    return _suite(
        v.sales_transactions,
        *[{"id": c, "type": "null_rate", "column": c, "max_pct": 0} for c in required],
    )


@query(
    "check_by_day",
    views=["transactions"],
    oracle=f"""{_row("none", "null_rate", _NULL_AMOUNTS)} FROM transactions UNION ALL
    {_row("positive", "range", "count(*) FILTER (WHERE amount < 0)")} FROM transactions UNION ALL
    {_row("many", "row_count", "greatest(100 - count(*), 0)")} FROM transactions""",
)
def _(v: Inputs) -> DataFrame:
    """Counts are saved per day; a day that is delivered again replaces its own, and no other day is read."""
    checks = [
        {"id": "none", "type": "null_rate", "column": "amount", "max_pct": 0},
        {"id": "positive", "type": "range", "column": "amount", "min": 0},
        {"id": "many", "type": "row_count", "min": 100},
    ]
    spec = {"checks": checks, "required": [c["id"] for c in checks]}
    table = f"{scratch.scratch_database(v.spark)}.transactions_checked"
    late = F.col("txn_date") > "2024-01-15"
    parts = {"until 15": ~late | F.col("txn_date").isNull(), "after 15": late}
    for part in ("until 15", "after 15", "until 15"):
        tables.replace_slice(check_states(v.transactions.where(parts[part]), spec), table, "part", part)
    return report_of_states(v.spark.table(table), v.transactions, spec)


@query(
    "check_accepted_values",
    oracle=f"""{_row("status", "accepted_values",
        "count(*) FILTER (WHERE o_orderstatus <> 'F' AND o_orderstatus <> 'O')")} FROM orders UNION ALL
    {_row("linenumber", "accepted_values", "count(*) FILTER (WHERE l_linenumber > 5)")} FROM lineitem""",
)
def _(v: Inputs) -> DataFrame:
    """Numbers are compared as text."""
    status = {"id": "status", "type": "accepted_values", "column": "o_orderstatus", "values": ["F", "O"]}
    number = {
        "id": "linenumber",
        "type": "accepted_values",
        "column": "l_linenumber",
        "values": ["1", "2", "3", "4", "5"],
    }
    return _suite(v.table("orders"), status).unionByName(_suite(v.table("lineitem"), number))


@query(
    "check_range",
    oracle=f"""{_row("both", "range", "count(*) FILTER (WHERE l_quantity < 5 OR l_quantity > 45)")}
    FROM lineitem UNION ALL
    {_row("low", "range", "count(*) FILTER (WHERE l_discount < 0)")} FROM lineitem UNION ALL
    {_row("high", "range", "count(*) FILTER (WHERE l_tax > 0.07)")} FROM lineitem""",
)
def _(v: Inputs) -> DataFrame:
    return _suite(
        v.table("lineitem"),
        {"id": "both", "type": "range", "column": "l_quantity", "min": 5, "max": 45},
        {"id": "low", "type": "range", "column": "l_discount", "min": 0},
        {"id": "high", "type": "range", "column": "l_tax", "max": 0.07},
    )


@query(
    "check_pattern",
    views=["country_orders_raw"],
    oracle=f""", {cleaning.ORDERS_CTE}
    {_row("code", "pattern", "count(*) FILTER (WHERE NOT regexp_full_match(country, '[A-Z]{3}'))")}
    FROM (SELECT DISTINCT country FROM coded_orders)""",
)
def _(v: Inputs) -> DataFrame:
    report = country.country_revenue(country.country_orders(v.country_orders_raw))
    return _suite(
        report, {"id": "code", "type": "pattern", "column": "country", "pattern": "^[A-Z]{3}$"}
    )


@query(
    "check_row_rule",
    views=["overdue_accounts", "risk_snapshot"],
    oracle=f""", fees AS (SELECT region, CASE WHEN region = 'international' THEN 50 ELSE 100 END AS cap,
        least(days_overdue * 5.0, CASE WHEN region = 'international' THEN 50 ELSE 100 END) AS late_fee
      FROM overdue_accounts), high AS (SELECT * FROM risk_snapshot
        WHERE abs(discrepancy) > CASE tier WHEN 'vip' THEN 300 ELSE 100 END)
    {_row("capped_iff_at_cap", "row_rule", "count(*) FILTER (WHERE late_fee IS NULL OR late_fee > cap)")} FROM fees
    UNION ALL {_row("international_cap", "row_rule",
      "count(*) FILTER (WHERE region IS NULL OR (region = 'international' AND coalesce(late_fee > 50, TRUE)))")} FROM fees
    UNION ALL {_row("under_cap", "row_rule", "count(*) FILTER (WHERE coalesce(late_fee >= cap, TRUE))")} FROM fees
    UNION ALL {_row("vip_limit", "row_rule",
      "count(*) FILTER (WHERE tier = 'vip' AND abs(discrepancy) <= 300)")} FROM high""",
)
def _(v: Inputs) -> DataFrame:
    fees = _suite(
        customers.late_fees(v.overdue_accounts),
        {
            "id": "capped_iff_at_cap",
            "type": "row_rule",
            "rule": "fee_capped = (late_fee = if(region = 'international', 50, 100))",
        },
        {
            "id": "international_cap",
            "type": "row_rule",
            "rule": "region <> 'international' OR late_fee <= 50",
        },
        {"id": "under_cap", "type": "row_rule", "rule": "NOT fee_capped"},
    )
    flagged = _suite(
        customers.high_risk_accounts(v.risk_snapshot),
        {
            "id": "vip_limit",
            "type": "row_rule",
            "rule": "NOT (tier <=> 'vip') OR abs(discrepancy) > 300",
        },
    )
    return fees.unionByName(flagged)


@query(
    "check_parts_add_up",
    views=cleaning.INVOICE_VIEWS,
    oracle=f""", {_AGING_CTE} {_row("buckets", "row_rule", '''count(*) FILTER (WHERE open_usd <>
      bucket_0_30_usd + bucket_31_60_usd + bucket_61_90_usd + bucket_90_plus_usd)''')} FROM aging""",
)
def _(v: Inputs) -> DataFrame:
    parts = " + ".join(name for name, _, _ in billing.AGE_BUCKETS)
    aging = billing.ar_aging(cleaning.invoices(v), AS_OF)
    return _suite(aging, {"id": "buckets", "type": "row_rule", "rule": f"open_usd = {parts}"})


@query(
    "check_single_current",
    views=["region_history"],
    oracle=_row("one_current", "uniqueness", "count(*) - count(DISTINCT customer_id)")
    + " FROM region_history WHERE is_current",
)
def _(v: Inputs) -> DataFrame:
    return _suite(
        v.region_history.where("is_current"),
        {"id": "one_current", "type": "uniqueness", "columns": ["customer_id"]},
    )


def _accounts_spec_row(check: dict[str, Any], violations: str) -> str:
    required = "FALSE" if check["id"] == "expected_schema" else "TRUE"
    return _row(check["id"], check["type"], violations).replace("TRUE AS required", f"{required} AS required")


_OUT_OF_RANGE = "count(*) FILTER (WHERE employee_count NOT BETWEEN 1 AND 100000)"
_SPEC_VIOLATIONS = {
    "one_row_per_key": "count(*) - count(DISTINCT account_id)",
    "employee_count_in_range": _OUT_OF_RANGE,
    "annual_revenue_not_null": "count(*) - count(annual_revenue)",
    "tier_not_null": "count(*) - count(tier)",
}


@query(
    "run_check_suite",
    views=["crm_accounts_raw", "crm_tiers_raw"],
    oracle=f", {SILVER_CTE} "
    + " UNION ALL ".join(
        f"{_accounts_spec_row(c, _SPEC_VIOLATIONS.get(c['id'], '0'))} FROM accounts_silver"
        for c in CONTRACTS["accounts_silver"]["checks"]
    ),
)
def _(v: Inputs) -> DataFrame:
    return run_check_suite(accounts_silver(v), CONTRACTS["accounts_silver"], "postprod")


@query(
    "check_same_count",
    views=["crm_accounts_raw"],
    oracle=", n AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT trim(account_id) FROM crm_accounts_raw)) AS kept, "
    "(SELECT count(DISTINCT trim(account_id)) FROM crm_accounts_raw) AS keys, "
    "(SELECT count(*) FROM crm_accounts_raw) AS rows) "
    + " UNION ALL ".join(
        f"SELECT '{name}' AS check_id, kept AS actual_rows, {expected} AS expected_rows, "
        f"abs(kept - {expected}) AS violations, kept = {expected} AS passed FROM n"
        for name, expected in (("accounts_kept", "keys"), ("versions_kept", "rows"))
    ),
)
def _(v: Inputs) -> DataFrame:
    clean = accounts.clean_crm_accounts(v.crm_accounts_raw)
    keys = F.count_distinct(F.trim("account_id"))
    kept = reports.count_report("accounts_kept", clean, v.crm_accounts_raw, keys)
    every = reports.count_report("versions_kept", clean, v.crm_accounts_raw, F.count(F.lit(1)))
    return kept.unionByName(every)


@query(
    "check_exact_count",
    views=["regional_orders"],
    oracle=" UNION ALL ".join(
        f"SELECT '{name}' AS check_id, count(DISTINCT region_code) AS actual_rows, "
        f"abs(count(DISTINCT region_code) - {n}) AS violations, count(DISTINCT region_code) = {n} AS passed "
        "FROM regional_orders"
        for name, n in (("five_regions", 5), ("seven_regions", 7))
    ),
)
def _(v: Inputs) -> DataFrame:
    regions = sales.regional_revenue(v.regional_orders)
    five = reports.exact_count_report("five_regions", regions, 5)
    return five.unionByName(reports.exact_count_report("seven_regions", regions, 7))


@query(
    "check_orphans",
    oracle="""SELECT 'order_without_customer' AS check_id, count(*) AS violations, count(*) = 0 AS passed
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal >= 0 WHERE c_custkey IS NULL
    UNION ALL SELECT 'line_without_order', count(*), count(*) = 0
    FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)""",
)
def _(v: Inputs) -> DataFrame:
    placed = v.table("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    sound = v.table("customer").where("c_acctbal >= 0")
    lines = v.table("lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    first = reports.orphan_report("order_without_customer", placed, sound, ["c_custkey"])
    second = reports.orphan_report("line_without_order", lines, placed, ["o_orderkey"])
    return first.unionByName(second)


def _total(name: str, report: str, source: str) -> str:
    r, s = (f"CAST((SELECT {value} FROM {table}) AS DECIMAL(38,2))" for value, table in ((report, "by_country"), (source, "coded_orders")))
    return (
        f"SELECT 'spend_report' AS check_id, '{name}' AS total, {r} AS report_total, {s} AS source_total, "
        f"CAST({r} IS DISTINCT FROM {s} AS BIGINT) AS violations, {r} IS NOT DISTINCT FROM {s} AS passed"
    )


@query(
    "check_totals",
    views=["country_orders_raw"],
    oracle=f""", {cleaning.ORDERS_CTE}, by_country AS (SELECT country, count(*) AS n, sum(amount) AS revenue,
        sum(quantity) AS units FROM coded_orders GROUP BY country)
    {_total("orders", "sum(n)", "count(*)")} UNION ALL {_total("revenue", "sum(revenue)", "sum(amount)")}
    UNION ALL {_total("quantity", "sum(units)", "sum(quantity)")}
    UNION ALL {_total("orders_for_units", "sum(n)", "sum(quantity)")}""",
)
def _(v: Inputs) -> DataFrame:
    placed = country.country_orders_v2(v.country_orders_raw)
    pairs: dict[str, tuple[Column, Column]] = {
        "orders": (F.sum("orders_count"), F.count(F.lit(1))),
        "revenue": (F.sum("revenue"), F.sum("amount")),
        "quantity": (F.sum("total_quantity"), F.sum("quantity")),
        "orders_for_units": (F.sum("orders_count"), F.sum("quantity")),
    }
    return reports.totals_report("spend_report", country.country_revenue_v2(placed), placed, pairs)


@query(
    "check_active_reconcile",
    views=cleaning.BILLING_VIEWS,
    oracle=f""", {_MRR_CTE}, t AS (SELECT
        (SELECT sum(active_subscriptions) FROM mrr WHERE month = DATE '2001-09-01') AS r,
        (SELECT count(*) FROM subscriptions WHERE end_date IS NULL) AS s)
    SELECT 'active_now' AS check_id, 'active_subscriptions' AS total, CAST(r AS DECIMAL(38,2)) AS report_total,
      CAST(s AS DECIMAL(38,2)) AS source_total, CAST(r IS DISTINCT FROM s AS BIGINT) AS violations,
      r IS NOT DISTINCT FROM s AS passed FROM t""",
)
def _(v: Inputs) -> DataFrame:
    """Open subscriptions of the last month against those without an end; later starts would differ."""
    subscriptions = cleaning.subscriptions(v)
    now = billing.mrr_monthly(subscriptions, AS_OF).where(F.col("month") == F.lit(month_start(AS_OF)))
    running = subscriptions.where(F.col("end_date").isNull())
    return reports.totals_report(
        "active_now",
        now,
        running,
        {"active_subscriptions": (F.sum("active_subscriptions"), F.count(F.lit(1)))},
    )


@query(
    "check_lookup_covered",
    views=["purchase_orders_raw"],
    oracle="""SELECT upper(trim(currency)) AS currency, count(*) AS rows FROM purchase_orders_raw
    WHERE upper(trim(currency)) NOT IN ('USD', 'GBP', 'EUR', 'INR', 'JPY', 'AED', 'CAD', 'AUD')
    GROUP BY 1""",
)
def _(v: Inputs) -> DataFrame:
    codes = v.purchase_orders_raw.select(upper_code("currency").alias("currency"))
    rate = lookup("currency", PROCUREMENT_RATES, "decimal(8,4)")
    return reports.unresolved_report(codes, "currency", rate)


@query(
    "raw_vs_clean_counts",
    views=["transactions"],
    oracle="""SELECT count(*) AS raw_rows, count(amount) AS clean_rows,
      count(*) - count(amount) AS dropped_rows FROM transactions""",
)
def _(v: Inputs) -> DataFrame:
    return reports.raw_vs_clean_counts(v.transactions, reconcile.drop_null_amounts(v.transactions))


@query(
    "distinct_keys",
    views=["dim_customer"],
    oracle="SELECT count(DISTINCT customer_id) AS keys FROM dim_customer",
)
def _(v: Inputs) -> DataFrame:
    return v.dim_customer.agg(F.count_distinct("customer_id").alias("keys"))


@query(
    "max_gate",
    views=["overdue_accounts"],
    oracle="""SELECT region, max(least(days_overdue * 5, CASE region WHEN 'international' THEN 50
      ELSE 100 END))::DOUBLE AS max_fee FROM overdue_accounts GROUP BY region""",
)
def _(v: Inputs) -> DataFrame:
    return customers.late_fees(v.overdue_accounts).groupBy("region").agg(F.max("late_fee").alias("max_fee"))
