"""Sources and sinks: each sink writes real tables in the shared folder and reads them back."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.rules import PROMISED_DAYS
from millrace.operators.joins import enrich, enrich_small
from millrace.operators.keyed import net_changes
from millrace.plans import reconcile, sales
from millrace.plans.shipping import FEED_COLUMNS
from millrace.registry.base import Inputs, half_up, query, typed
from millrace.sinks import merge, scratch, tables
from millrace.sources import readers

_DAILY = f"""
SELECT store_id, product_category, sale_date,
  CAST(sum(revenue) AS DECIMAL(22,2)) AS total_revenue, CAST(sum(quantity) AS BIGINT) AS total_units,
  {half_up("sum(revenue) * 100", "count(*) * 100", 6)} AS avg_order_value,
  count(transaction_id) AS transaction_count
FROM sales_transactions GROUP BY ALL
"""


def daily(transactions: DataFrame) -> DataFrame:
    return typed(
        sales.daily_sales(transactions),
        total_revenue="decimal(22,2)",
        avg_order_value="decimal(18,6)",
    )


@query("scan_table", oracle="SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(v: Inputs) -> DataFrame:
    table = f"{scratch.scratch_database(v.spark)}.orders"
    v.spark.sql(f"CREATE TABLE {table} USING parquet LOCATION '{v.path('orders')}'")
    return readers.scan_table(v.spark, table).select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "scan_parquet_enrich",
    oracle="""SELECT c_custkey AS customer_id, c_mktsegment AS segment, n AS orders, total AS total_price
    FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n,
      CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DECIMAL(22,2)) AS total
      FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey""",
)
def _(v: Inputs) -> DataFrame:
    """The feed is brought to one row per customer before the join."""
    feed = readers.scan_parquet(v.spark, v.path("orders"))
    customers = v.table("customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment")
    )
    attributes = feed.groupBy(F.col("o_custkey").alias("customer_id")).agg(
        F.count("*").alias("orders"),
        F.sum(F.col("o_totalprice").cast("decimal(12,2)")).alias("total_price"),
    )
    return enrich(customers, attributes, ["customer_id"])


@query(
    "typed_rows",
    views=["carrier_feed"],
    oracle="""SELECT carrier, CAST(promised AS INTEGER) AS promised_days, count(*) AS shipments
    FROM carrier_feed JOIN (VALUES ('Northwind Freight', 3), ('Kestrel Express', 2),
      ('Harbor Line', 5), ('Atlas Parcel', 4)) AS p(carrier, promised) ON carrier_name = carrier
    GROUP BY ALL""",
)
def _(v: Inputs) -> DataFrame:
    promises = readers.typed_rows(
        v.spark, PROMISED_DAYS.items(), "carrier string NOT NULL, promised_days int NOT NULL"
    )
    feed = v.carrier_feed.select(F.col("carrier_name").alias("carrier"))
    joined = enrich_small(feed, promises, ["carrier"], "inner")
    return joined.groupBy("carrier", "promised_days").agg(F.count("*").alias("shipments"))


@query(
    "date_slice",
    views=["transactions"],
    oracle="SELECT * FROM transactions WHERE txn_date = '2024-01-15'",
)
def _(v: Inputs) -> DataFrame:
    return readers.day_slice(v.transactions, "txn_date", "2024-01-15")


@query(
    "land_bronze",
    views=["crm_accounts_raw"],
    oracle="SELECT *, 'crm.Account' AS source_object FROM crm_accounts_raw",
)
def _(v: Inputs) -> DataFrame:
    table = f"{scratch.scratch_database(v.spark)}.accounts_bronze"
    tables.land(v.crm_accounts_raw, table, "crm.Account")
    return v.spark.table(table)


@query(
    "land_slice",
    views=["transactions"],
    oracle="""SELECT * EXCLUDE (txn_date), 'payments' AS source_object, txn_date FROM transactions
    WHERE txn_date BETWEEN '2024-01-15' AND '2024-01-16'""",
)
def _(v: Inputs) -> DataFrame:
    """Two days, the first of them delivered twice, read back by a filter on the partition."""
    table = f"{scratch.scratch_database(v.spark)}.transactions_bronze"
    for day in ("2024-01-15", "2024-01-16", "2024-01-17", "2024-01-15"):
        delivered = readers.day_slice(v.transactions, "txn_date", day)
        tables.land_slice(delivered, table, "payments", "txn_date", day)
    return v.spark.table(table).where("txn_date <= '2024-01-16'")


@query(
    "land_text_feed",
    views=["carrier_feed"],
    oracle="SELECT *, 'carrier.Export v2' AS source_object FROM carrier_feed",
)
def _(v: Inputs) -> DataFrame:
    delivered = scratch.scratch_path(v.spark, "carrier_export")
    v.carrier_feed.write.option("header", True).csv(delivered)
    table = f"{scratch.scratch_database(v.spark)}.carrier_feed"
    tables.land(
        readers.scan_text_feed(v.spark, delivered, FEED_COLUMNS), table, "carrier.Export v2"
    )
    return v.spark.table(table)


@query("sink_overwrite", views=["sales_transactions"], oracle=_DAILY)
def _(v: Inputs) -> DataFrame:
    table = f"{scratch.scratch_database(v.spark)}.daily_sales"
    for _attempt in range(2):
        tables.overwrite(daily(v.sales_transactions), table)
    return v.spark.table(table)


@query(
    "sink_overwrite_schema",
    views=["dim_customer"],
    oracle="SELECT customer_id, customer_tier, signup_region, _ingest_seq FROM dim_customer",
)
def _(v: Inputs) -> DataFrame:
    table = f"{scratch.scratch_database(v.spark)}.dim_customer"
    tables.overwrite(v.dim_customer.drop("_ingest_seq"), table)
    tables.overwrite(v.dim_customer, table)
    return v.spark.table(table)


_RECONCILE = """
SELECT t.account_id, CAST(t.total AS DECIMAL(22,2)) AS txn_total, l.ledger_balance,
  CAST(t.total - l.ledger_balance AS DECIMAL(23,2)) AS discrepancy
FROM (SELECT account_id, sum(amount) AS total FROM transactions WHERE amount IS NOT NULL
      GROUP BY account_id) t LEFT JOIN ledger l ON t.account_id = l.account_id
WHERE l.is_active
"""


def reconciled(v: Inputs) -> DataFrame:
    clean = reconcile.drop_null_amounts(v.transactions)
    return typed(
        reconcile.reconcile_ledger(clean, v.ledger),
        txn_total="decimal(22,2)",
        discrepancy="decimal(23,2)",
    )


@query("reconcile_ledger", views=["transactions", "ledger"], oracle=_RECONCILE)
def _(v: Inputs) -> DataFrame:
    return reconciled(v)


@query("sink_schema_guard", views=["transactions", "ledger"], oracle=_RECONCILE)
def _(v: Inputs) -> DataFrame:
    table = f"{scratch.scratch_database(v.spark)}.reconciliation_report"
    tables.overwrite_same_schema(reconciled(v), table)
    try:
        tables.overwrite_same_schema(reconciled(v).withColumn("is_active", F.lit(True)), table)
    except tables.SchemaChanged:
        tables.overwrite_same_schema(reconciled(v), table)
        return v.spark.table(table)
    raise AssertionError("a changed schema was accepted")


@query(
    "sink_append",
    views=["plain_orders"],
    oracle="""SELECT *, 'first' AS snapshot FROM plain_orders UNION ALL
    SELECT *, 'second' AS snapshot FROM plain_orders WHERE order_total > 100000""",
)
def _(v: Inputs) -> DataFrame:
    table = f"{scratch.scratch_database(v.spark)}.order_audit"
    orders = v.plain_orders
    tables.append(orders.withColumn("snapshot", F.lit("first")), table)
    later = orders.where("order_total > 100000")
    tables.append(later.select(F.lit("second").alias("snapshot"), *orders.columns), table)
    return v.spark.table(table)


_RESTATED = date(1998, 7, 1)


@query(
    "create_or_merge",
    views=["sales_transactions"],
    oracle=f"""
    , daily AS ({_DAILY})
    SELECT store_id, product_category, sale_date, CAST(year(sale_date) AS INTEGER) AS sale_year,
      CASE WHEN sale_date < DATE '1998-07-01' THEN CAST(total_revenue + 1 AS DECIMAL(22,2))
           ELSE total_revenue END AS total_revenue,
      total_units, avg_order_value, transaction_count FROM daily""",
)
def _(v: Inputs) -> DataFrame:
    """A first load of everything, then a restatement of the later days."""
    table = f"{scratch.scratch_database(v.spark)}.daily_sales_summary"
    summary = daily(v.sales_transactions).withColumn("sale_year", F.year("sale_date"))
    keys = [*sales.DAILY_KEYS, "sale_year"]
    first = typed(
        summary.withColumn("total_revenue", F.col("total_revenue") + 1),
        total_revenue="decimal(22,2)",
    )
    merge.create_or_merge(v.spark, table, first, keys, ["sale_year"])
    restated = summary.where(F.col("sale_date") >= F.lit(_RESTATED))
    merge.create_or_merge(v.spark, table, restated, keys, ["sale_year"])
    return v.spark.table(table)


@query(
    "merge_upsert",
    views=["dim_customer"],
    oracle="""SELECT customer_id, customer_tier, signup_region, _ingest_seq FROM (
      SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY _ingest_seq DESC) AS n
      FROM dim_customer) WHERE n = 1
    UNION ALL SELECT -1 - s_suppkey, 'supplier', s_name, 0 FROM supplier""",
)
def _(v: Inputs) -> DataFrame:
    """Late records update their customer; records of new keys are inserted."""
    table = f"{scratch.scratch_database(v.spark)}.dim_customer"
    records = v.dim_customer
    is_late = F.col("_ingest_seq") != F.col("customer_id")
    tables.overwrite(records.where(~is_late), table)
    new = v.table("supplier").select(
        (-1 - F.col("s_suppkey")).alias("customer_id"),
        F.lit("supplier").alias("customer_tier"),
        F.col("s_name").alias("signup_region"),
        F.lit(0).cast("bigint").alias("_ingest_seq"),
    )
    batch = records.where(is_late).unionByName(new)
    merge.merge_upsert(v.spark, table, batch, ["customer_id"])
    return v.spark.table(table)


@query(
    "merge_increment",
    views=["balances", "balance_changes"],
    oracle="""SELECT coalesce(b.customer_id, c.customer_id) AS customer_id,
      CAST(CASE WHEN b.customer_id IS NULL THEN c.change_amount
                WHEN c.customer_id IS NULL THEN b.balance
                ELSE b.balance + c.change_amount END AS DECIMAL(22,2)) AS balance,
      CASE WHEN b.customer_id IS NOT NULL THEN 'known' END AS origin
    FROM balances b FULL JOIN (SELECT customer_id, sum(change_amount) AS change_amount
      FROM balance_changes GROUP BY customer_id) c ON b.customer_id = c.customer_id""",
)
def _(v: Inputs) -> DataFrame:
    table = f"{scratch.scratch_database(v.spark)}.customer_balances"
    start = typed(v.balances, balance="decimal(22,2)").withColumn("origin", F.lit("known"))
    tables.overwrite(start, table)
    changes = net_changes(v.balance_changes, ["customer_id"], "change_amount")
    merge.merge_increment(v.spark, table, changes, "customer_id", "balance", "change_amount")
    return v.spark.table(table)


@query(
    "check_constraint",
    views=["transactions"],
    oracle="SELECT * FROM transactions WHERE amount IS NOT NULL",
)
def _(v: Inputs) -> DataFrame:
    table = f"{scratch.scratch_database(v.spark)}.daily_txn_clean"
    tables.write_checked(
        reconcile.drop_null_amounts(v.transactions), table, reconcile.AMOUNT_RULE
    )
    return v.spark.table(table)


@query("recreate_table", views=["transactions", "ledger"], oracle=_RECONCILE)
def _(v: Inputs) -> DataFrame:
    """The second write has other columns than the first, which the drop allows."""
    table = f"{scratch.scratch_database(v.spark)}.reconciliation"
    tables.recreate(reconciled(v).select("discrepancy", "account_id"), table)
    tables.recreate(reconciled(v), table)
    return v.spark.table(table)


@query(
    "temp_view",
    views=["balance_changes"],
    oracle="""SELECT customer_id, CAST(sum(change_amount) AS DECIMAL(22,2)) AS change_amount
    FROM balance_changes GROUP BY customer_id HAVING sum(change_amount) > 1000""",
)
def _(v: Inputs) -> DataFrame:
    net = net_changes(v.balance_changes, ["customer_id"], "change_amount")
    view = f"net_balance_changes_{uuid.uuid4().hex[:12]}"
    typed(net, change_amount="decimal(22,2)").createTempView(view)
    try:
        return v.spark.sql(f"SELECT * FROM {view} WHERE change_amount > 1000")  # resolved now, so the view may go
    finally:
        v.spark.catalog.dropTempView(view)
