"""Jobs end to end: raw tables of one schema in, checked tables out."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from millrace.__main__ import main
from millrace.checks.gates import GateFailed
from millrace.jobs import JOBS
from millrace.jobs.base import Store, unique
from millrace.registry.base import Inputs
from millrace.sources.readers import typed_rows

FOLDER = "/root/testdata/sf0.001"
RUN_DATE = date(2024, 1, 15)


@pytest.fixture
def store(spark, schema):
    return Store(spark, schema)


@pytest.fixture(scope="module")
def inputs(spark):
    return Inputs(spark, FOLDER)


def save(store, **frames):
    for name, df in frames.items():
        df.write.mode("overwrite").saveAsTable(store.name(name))


def test_price_alerts(store, inputs, rows_of):
    save(store, raw_product_feed=inputs.product_feed, active_promotions=inputs.promotions)
    JOBS["price_alerts"](store)
    assert store.read("gold_price_alerts").where("discounted_price >= base_price * 0.9").count() == 0
    with pytest.raises(GateFailed):
        JOBS["price_alerts"](store, expected_active=1)
    save(store, active_promotions=inputs.promotions.where("discount_pct <= 0.1"))
    with pytest.raises(GateFailed, match="has rows"):
        JOBS["price_alerts"](store)


def test_inventory_alerts(store, inputs):
    products = typed_rows(
        store.spark,
        [(1, "Mouse", "ACTIVE", 24.99), (2, "Webcam", "DISCONTINUED", 49.99)],
        "product_id int, product_name string, status string, unit_price double",
    )
    lines = typed_rows(store.spark, [(9, 1, 3), (10, 2, 1)], "order_line_id int, product_id int, quantity int")
    save(store, bronze_products=products, bronze_order_lines=lines)
    JOBS["inventory_alerts"](store)
    assert [r["order_line_id"] for r in store.read("gold_inventory_alerts").collect()] == [9]


def test_global_reporting_and_enriched_orders(store, inputs):
    save(
        store,
        bronze_customers=inputs.customers_global,
        bronze_orders_global=inputs.plain_orders,
        raw_orders=inputs.plain_orders,
        dim_customer=inputs.dim_customer,
    )
    JOBS["global_reporting"](store)
    JOBS["enriched_orders"](store)
    orders = inputs.plain_orders.count()
    assert store.read("gold_global_reporting").count() == orders
    assert store.read("gold_enriched_orders").count() == orders
    save(store, dim_customer=inputs.dim_customer.where("customer_id > 3"))
    with pytest.raises(GateFailed, match="rows where"):
        JOBS["enriched_orders"](store)


def test_daily_sales_is_idempotent_per_day(store, inputs, rows_of):
    sales = inputs.sales_transactions
    days = [r[0] for r in sales.groupBy("sale_date").count().orderBy("sale_date").limit(3).collect()]
    save(store, bronze_sales_transactions=sales)
    for day in [*days, days[1]]:
        main(["daily_sales", "--schema", store.schema, "--run-date", day.isoformat()])
    summary = store.read("gold_daily_sales_summary")
    total = sales.where(F.col("sale_date").isin(days)).agg(F.sum("revenue")).first()[0]
    assert summary.agg(F.sum("total_revenue")).first()[0] == total
    assert {r[0] for r in summary.select("sale_date").collect()} == set(days)
    with pytest.raises(SystemExit):
        main(["daily_sales", "--schema", store.schema])


def test_order_and_customer_jobs(store, inputs):
    save(
        store,
        bronze_orders=inputs.discount_amount_orders,
        text_discount_orders=inputs.text_discount_orders,
        bronze_customer_summaries=inputs.customer_summaries,
        regional_orders=inputs.regional_orders,
        daily_store_sales=inputs.store_sales.withColumnRenamed("sale_date", "txn_date"),
        customer_activity=inputs.customer_activity,
        customers=inputs.customer_ages.withColumn("email", F.lit("a@b.c")),
    )
    for job in (
        "customer_orders", "order_discounts", "customer_ltv", "regional_revenue", "rolling_metrics",
        "churn_scores", "age_band", "email_domains",
    ):
        JOBS[job](store)
    assert store.read("gold_customer_summary").columns[0] == "cust_id"
    assert store.read("rolling_store_metrics").count() == inputs.store_sales.count()
    assert store.read("regional_summary").count() == 5
    assert store.read("customers_30_45").schema.names == store.read("customers").schema.names


def test_reconciliation(store, inputs):
    save(store, daily_txn_raw=inputs.transactions, ledger=inputs.ledger)
    counts = JOBS["reconciliation"](store, RUN_DATE)
    day = inputs.transactions.where(F.col("txn_date") == RUN_DATE.isoformat())
    assert counts["clean_rows"] == day.where("amount is not null").count()
    assert store.read("daily_reconciliation_report").columns == [
        "account_id", "txn_total", "ledger_balance", "discrepancy",
    ]
    assert store.read("daily_reconciliation_summary").count() == 1
    bad = inputs.transactions.withColumn("txn_type", F.lit("charge"))
    save(store, daily_txn_raw=bad)
    with pytest.raises(GateFailed, match="break the rule"):
        JOBS["reconciliation"](store, RUN_DATE)
    assert store.read("daily_txn_clean").where("txn_type = 'refund'").count() > 0


def test_balances(store, rows_of):
    spark = store.spark
    save(
        store,
        opening_balances=typed_rows(
            spark, [("C1", 250.0), ("C2", 1200.5)], "customer_id string, balance double"
        ),
        customer_regions=typed_rows(
            spark,
            [("C1", "North", True), ("C2", "North", False), ("C2", "South", True)],
            "customer_id string, region string, is_current boolean",
        ),
        balance_changes=typed_rows(
            spark,
            [("C1", 50.0), ("C2", -100.0), ("C2", -100.0), ("C9", 1.0)],
            "customer_id string, change_amount double",
        ),
    )
    JOBS["balances"](store)
    assert rows_of(store.read("customer_balances")) == [
        ("C1", 300.0, "North"), ("C2", 1000.5, "South"), ("C9", 1.0, None),
    ]
    store.check_contract("customer_balances", "branch")
    both = typed_rows(spark, [("C1", "N", True), ("C1", "S", True)], "customer_id string, region string, is_current boolean")
    save(store, customer_regions=both)
    with pytest.raises(GateFailed, match="C1"):
        JOBS["balances"](store)


def test_fees_risk_and_contacts(store, inputs):
    save(
        store,
        overdue_accounts=inputs.overdue_accounts,
        risk_snapshot=inputs.risk_snapshot,
        bronze_customer_contacts=inputs.customer_contacts,
    )
    JOBS["late_fees"](store)
    JOBS["high_risk"](store)
    store.check_contract("late_fee_assessments_demo", "postprod")
    with pytest.raises(GateFailed, match="formatted_phone"):
        JOBS["contacts"](store)
    known = inputs.customer_contacts.where("country_code <> 'FR'")
    save(store, bronze_customer_contacts=known)
    JOBS["contacts"](store)


def test_billing(store, inputs):
    save(
        store,
        bl_accounts_raw=inputs.billing_accounts_raw,
        bl_plans_raw=inputs.plans_raw,
        bl_subscriptions_raw=inputs.subscriptions_raw.where("trim(plan_id) not in ('P51', 'P52')"),
        bl_invoices_raw=inputs.invoices_raw,
        bl_payments_raw=inputs.payments_raw,
    )
    JOBS["billing_bronze"](store)
    assert store.read("bl_plans_bronze").select("source_object").distinct().first()[0] == "billing.Plan"
    JOBS["billing_silver"](store)
    JOBS["billing_gold"](store, date(2001, 9, 30))
    for table in (
        "bl_subscriptions_silver", "bl_invoices_silver", "bl_mrr_monthly", "bl_churn_cohorts", "bl_ar_aging",
        "bl_finance_kpis",
    ):
        store.check_contract(table, "postprod")


def test_subscriptions_without_a_plan_stop_billing(store, inputs):
    for table in ("accounts", "subscriptions", "invoices", "payments"):
        view = "billing_accounts_raw" if table == "accounts" else f"{table}_raw"
        save(store, **{f"bl_{table}_raw": getattr(inputs, view)})
    save(store, bl_plans_raw=inputs.plans_raw.where("plan_id <> 'P7'"))
    JOBS["billing_bronze"](store)
    with pytest.raises(GateFailed, match="mrr_usd"):
        JOBS["billing_silver"](store)


def test_accounts(store, inputs):
    save(store, sf_accounts_raw=inputs.crm_accounts_raw, sf_account_tier_raw=inputs.crm_tiers_raw)
    customers = inputs.table("customer").count()
    JOBS["accounts"](store, expected_accounts=customers)
    for table in ("accounts_bronze", "accounts_silver", "account_summary"):
        store.check_contract(table, "postprod")
    with pytest.raises(GateFailed, match="40 rows"):
        JOBS["accounts"](store, expected_accounts=40)


def test_supplier_spend(store, inputs):
    save(
        store,
        sp_suppliers_raw=inputs.suppliers_raw.where("currency <> 'XXX'"),
        sp_purchase_orders_raw=inputs.purchase_orders_raw,
    )
    with pytest.raises(GateFailed, match="supplier_name not null"):
        JOBS["supplier_spend"](store)
    known = inputs.suppliers_raw.where("currency <> 'XXX'").selectExpr("trim(supplier_id) as k").distinct()
    orders = inputs.purchase_orders_raw.withColumn("k", F.trim("supplier_id")).join(known, "k", "left_semi")
    save(store, sp_purchase_orders_raw=orders.where("currency <> 'XXX'").drop("k"))
    JOBS["supplier_spend"](store)
    for table in ("sp_suppliers", "sp_purchase_orders", "sp_spend_by_country"):
        store.check_contract(table, "postprod")


WAREHOUSE = (
    "warehouse_id string, warehouse_name string, region string, city string, capacity_pallets bigint, "
    "opened_on date, ops_team string, is_active boolean"
)


def test_carrier_sla(store, inputs):
    houses = [
        (f"WH{n:02d}", f"House {n}", "North", "Leeds", 100 * n, date(2019, 3, n), "Ops", True)
        for n in range(1, 13)
    ]
    save(
        store,
        sd_carrier_feed=inputs.carrier_feed.dropDuplicates(["shipment_ref"]),
        sd_warehouses=typed_rows(store.spark, houses, WAREHOUSE),
    )
    JOBS["carrier_sla"](store)
    for table in ("sd_warehouses", "sd_shipments", "sd_carrier_sla"):
        store.check_contract(table, "postprod")
    save(store, sd_warehouses=typed_rows(store.spark, houses[1:], WAREHOUSE))
    with pytest.raises(GateFailed, match="without a parent"):
        JOBS["carrier_sla"](store)


@pytest.mark.parametrize("version", ["cc", "cc2"])
def test_country_revenue(store, inputs, version):
    segment = F.when(F.col("segment") == "BUILDING", "SMB").otherwise("Retail")
    save(
        store,
        **{
            f"{version}_customers_raw": inputs.country_customers_raw.withColumn("segment", segment),
            f"{version}_orders_raw": inputs.country_orders_raw,
        },
    )
    JOBS["country_revenue" if version == "cc" else "country_revenue_v2"](store)
    for table in ("customers", "orders", "revenue_by_country"):
        store.check_contract(f"{version}_{table}", "postprod")


def test_shipping_runs_from_delivered_files(store, inputs, tmp_path):
    delivered = str(tmp_path / "feed")
    inputs.carrier_feed.dropDuplicates(["shipment_ref"]).write.option("header", True).csv(delivered)
    assert JOBS["carrier_feed"](store, feed=delivered) > 0
    JOBS["warehouses"](store)
    JOBS["carrier_sla"](Store(store.spark, store.schema, "uat"))
    for table in ("sd_warehouses", "sd_shipments", "sd_carrier_sla"):
        store.check_contract(table, "postprod")


def test_a_delivery_before_its_shipping_stops_the_report(store, inputs):
    feed = inputs.carrier_feed.dropDuplicates(["shipment_ref"])
    JOBS["warehouses"](store)
    late = F.when(F.col("shipment_ref") == feed.agg(F.min("shipment_ref")).first()[0], "1990-01-01")
    save(store, sd_carrier_feed=feed.withColumn("delivered_at", F.coalesce(late, "delivered_at")))
    with pytest.raises(GateFailed, match="transit_days >= 0.*1990"):
        JOBS["carrier_sla"](store)
    assert not store.spark.catalog.tableExists(store.name("sd_carrier_sla"))


def test_a_phase_runs_the_contract_of_what_is_published(store, inputs, monkeypatch):
    save(store, sf_accounts_raw=inputs.crm_accounts_raw, sf_account_tier_raw=inputs.crm_tiers_raw)
    main(["accounts", "--schema", store.schema, "--phase", "uat"])
    kept = store.read("account_summary").drop("strategic_accounts")
    summary = store.spark.createDataFrame(kept.collect(), kept.schema)
    with pytest.raises(GateFailed, match="later_schema"):
        Store(store.spark, store.schema, "uat").publish("account_summary", summary)
    Store(store.spark, store.schema, "branch").publish("account_summary", summary)


def test_every_check_of_the_contracts_exists():
    from millrace.checks.contracts import CONTRACTS

    assert sum(len(c["checks"]) for c in CONTRACTS.values()) == 120
    assert {p for c in CONTRACTS["customers"]["checks"] for p in c["phases"]} == {"postprod"}
    assert "later_schema" in CONTRACTS["account_summary"]["required"]


def test_items_catalogue_loyalty_journeys_and_audit(store, tmp_path):
    spark = store.spark
    headers = spark.range(50).withColumnRenamed("id", "order_id").withColumn("status", F.lit("open"))
    items = spark.range(200).select(F.col("id").alias("line_item_id"), (F.col("id") % 50).alias("order_id"), (F.col("id") % 7).alias("product_id"))
    catalogue = spark.range(5).select(F.col("id").alias("product_id"), F.lit("x" * 100).alias("description"))
    events = items.select(F.lit("UNKNOWN").alias("customer_id"), F.col("line_item_id").alias("event_seq"), F.lit("p").alias("payload"))
    people = typed_rows(spark, [("C1", "gold"), ("C2", "silver")], "customer_id string, loyalty_tier string")
    feed = str(tmp_path / "loyalty")
    typed_rows(spark, [("C1", 5)], "customer_id string, points int").write.parquet(feed)
    grants = typed_rows(spark, [("t", "SELECT", "svc")], "table_name string, access_type string, principal string")
    save(store, order_headers=headers, order_line_items=items, order_items=items, product_catalog=catalogue,
         order_events=events, loyalty_customers=people, audit_grants=grants)
    JOBS["order_items"](store)
    assert store.read("enriched_order_items").where("status = 'open'").count() == 200
    JOBS["catalog_enrichment"](store)
    assert store.read("catalog_order_items").where("description IS NULL").count() == items.where("product_id > 4").count()
    JOBS["journeys"](store, max_events=60)
    assert [r["event_count"] for r in store.read("customer_journeys").orderBy("part_no").collect()] == [60, 60, 60, 20]
    JOBS["loyalty"](store, feed=feed)
    assert {r["customer_id"]: r["points"] for r in store.read("loyalty_enriched").collect()} == {"C1": 5, "C2": None}
    for _ in range(2):
        JOBS["audit_snapshot"](store)
    assert store.read("audit_trail_snapshot").count() == 2
    save(store, order_headers=headers.where("order_id > 0"))
    with pytest.raises(GateFailed, match="expected"):
        JOBS["order_items"](store)


def test_rows_that_fail_a_gate_are_never_published(spark, schema):
    store = Store(spark, schema)
    good = spark.createDataFrame([(1, "a")], "id int, v string")
    store.publish("t", good, unique("id"))

    def refuse(rows):
        raise GateFailed("no")

    for bad, checks, audit in ((good.union(good), [unique("id")], None), (good.limit(0), [], refuse)):
        with pytest.raises(GateFailed):
            store.publish("t", bad, *checks, audit=audit)
        assert store.read("t").collect() == good.collect()
    assert [t.name for t in spark.catalog.listTables(schema)] == ["t"]


def test_a_snapshot_of_a_run_is_kept_once(spark, schema):
    from millrace.jobs import feeds

    spark.range(3).write.saveAsTable(f"{schema}.audit_grants")
    for run in ("r1", "r2", "r1"):
        feeds.audit_snapshot(Store(spark, schema), run)
    counts = spark.table(f"{schema}.audit_trail_snapshot").groupBy("run").count().collect()
    assert sorted(tuple(r) for r in counts) == [("r1", 3), ("r2", 3)]
