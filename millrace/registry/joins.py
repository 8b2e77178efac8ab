"""Joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import joins
from millrace.plans import accounts, billing, customers, orders, products
from millrace.registry.base import Inputs, query, typed
from millrace.sinks import scratch, tables


@query(
    "inventory_alerts",
    views=["order_lines", "product_feed"],
    oracle="""SELECT o.product_id, o.order_line_id, o.quantity, p.product_name, p.base_price
    FROM order_lines o JOIN product_feed p ON o.product_id = p.product_id
    WHERE lower(trim(p.is_active)) = 'true'""",
)
def _(v: Inputs) -> DataFrame:
    return products.inventory_alerts(v.order_lines, products.active_products(v.product_feed))


@query(
    "silver_pricing",
    views=["product_feed", "promotions"],
    oracle="""SELECT p.product_id, p.product_name, p.base_price, r.discount_pct,
      CAST(p.base_price - p.base_price * r.discount_pct AS DECIMAL(16,4)) AS discounted_price
    FROM product_feed p, promotions r
    WHERE p.product_id = r.product_id AND lower(trim(p.is_active)) = 'true'""",
)
def _(v: Inputs) -> DataFrame:
    pricing = products.silver_pricing(products.active_products(v.product_feed), v.promotions)
    return typed(pricing, discounted_price="decimal(16,4)")


@query(
    "enriched_orders",
    views=["plain_orders", "dim_customer"],
    oracle="""SELECT o.customer_id, o.order_id, o.order_total, d.customer_tier, d.signup_region
    FROM plain_orders o JOIN dim_customer d ON o.customer_id = d.customer_id
    WHERE d._ingest_seq = (SELECT max(m._ingest_seq) FROM dim_customer m
                           WHERE m.customer_id = d.customer_id)""",
)
def _(v: Inputs) -> DataFrame:
    return orders.enriched_orders(v.plain_orders, v.dim_customer)


@query(
    "global_reporting",
    views=["plain_orders", "customers_global"],
    oracle="""SELECT o.customer_id, o.order_id, o.order_total, c.customer_name, c.country
    FROM plain_orders o JOIN (SELECT DISTINCT customer_id, trim(customer_name) AS customer_name, country
      FROM customers_global) c ON o.customer_id = c.customer_id""",
)
def _(v: Inputs) -> DataFrame:
    return orders.global_reporting(v.plain_orders, orders.silver_customers(v.customers_global))


@query(
    "current_region_join",
    views=["balances", "region_history"],
    oracle="""SELECT b.customer_id, b.balance,
      (SELECT max(h.region) FROM region_history h
       WHERE h.customer_id = b.customer_id AND h.is_current) AS region FROM balances b""",
)
def _(v: Inputs) -> DataFrame:
    return customers.balances_with_region(v.balances, v.region_history)


_TIER_FIELDS = """CASE WHEN initcapped IN ('Gold', 'Silver', 'Bronze') THEN initcapped
        ELSE 'Unassigned' END AS tier,
      TRY_CAST(trim(tier_since) AS DATE) AS tier_since,
      TRY_CAST(trim(renewal_date) AS DATE) AS renewal_date,
      TRY_CAST(trim(health_score) AS DECIMAL(5,2)) AS health_score,
      CASE WHEN lower(trim(is_strategic)) IN ('true', 'yes', '1') THEN TRUE
           WHEN lower(trim(is_strategic)) IN ('false', 'no', '0') THEN FALSE END AS is_strategic,
      nullif(trim(region_owner_team), '') AS region_owner_team"""

TIERS_CTE = f"""clean_tiers AS (
    SELECT trim(account_id) AS account_id, {_TIER_FIELDS} FROM (
      SELECT *, upper(left(trim(tier), 1)) || lower(substr(trim(tier), 2)) AS initcapped,
        row_number() OVER (PARTITION BY trim(account_id) ORDER BY tier_since DESC NULLS LAST,
          tier ASC NULLS FIRST, renewal_date NULLS FIRST,
          health_score NULLS FIRST, is_strategic NULLS FIRST, region_owner_team NULLS FIRST) AS n
      FROM crm_tiers_raw) WHERE n = 1)"""

ACCOUNTS_CTE = """clean_accounts AS (
    SELECT trim(account_id) AS account_id, trim(account_name) AS account_name,
      upper(left(trim(industry), 1)) || lower(substr(trim(industry), 2)) AS industry,
      upper(trim(billing_country)) AS billing_country,
      CAST(annual_revenue AS DECIMAL(14,2)) AS annual_revenue,
      CAST(employee_count AS INTEGER) AS employee_count, CAST(created_date AS DATE) AS created_date,
      trim(owner_team) AS owner_team
    FROM (SELECT *, row_number() OVER (PARTITION BY trim(account_id)
            ORDER BY account_name NULLS FIRST, industry NULLS FIRST) AS n FROM crm_accounts_raw)
    WHERE n = 1)"""

SILVER_CTE = f"""{TIERS_CTE}, {ACCOUNTS_CTE}, accounts_silver AS (
    SELECT a.*, coalesce(t.tier, 'Unassigned') AS tier, t.tier_since, t.renewal_date, t.health_score,
      t.is_strategic, t.region_owner_team
    FROM clean_accounts a LEFT JOIN clean_tiers t ON a.account_id = t.account_id)"""


def accounts_silver(v: Inputs) -> DataFrame:
    return accounts.add_tiers(
        accounts.clean_crm_accounts(v.crm_accounts_raw), accounts.clean_tiers(v.crm_tiers_raw)
    )


@query(
    "add_tiers",
    views=["crm_accounts_raw", "crm_tiers_raw"],
    oracle=f", {SILVER_CTE} SELECT * FROM accounts_silver",
)
def _(v: Inputs) -> DataFrame:
    return accounts_silver(v)


@query(
    "catalog_enrich",
    oracle="""SELECT l_orderkey, l_linenumber, l_partkey AS product_id, p_name AS product_name, p_brand
    FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""",
)
def _(v: Inputs) -> DataFrame:
    lines = v.table("lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("product_id")
    )
    catalog = v.table("part").select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"), "p_brand"
    )
    return joins.enrich(lines, catalog, ["product_id"])


@query(
    "broadcast_dim_join",
    oracle="""SELECT c_nationkey AS nation_id, c_custkey AS customer_id, n_name AS nation
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
)
def _(v: Inputs) -> DataFrame:
    people = v.table("customer").select(
        F.col("c_nationkey").alias("nation_id"), F.col("c_custkey").alias("customer_id")
    )
    nations = v.table("nation").select(
        F.col("n_nationkey").alias("nation_id"), F.col("n_name").alias("nation")
    )
    return joins.enrich_small(people, nations, ["nation_id"])


_ORDER_ITEMS = """SELECT o_orderkey AS order_id, o_custkey AS customer_id, l_linenumber AS line_number,
      l_partkey AS product_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey"""


def _headers(v: Inputs) -> DataFrame:
    return v.table("orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"))


def _items(v: Inputs) -> DataFrame:
    return v.table("lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_number"),
        F.col("l_partkey").alias("product_id"),
    )


@query("order_items_join", oracle=_ORDER_ITEMS)
def _(v: Inputs) -> DataFrame:
    return joins.keyed_join(_headers(v), _items(v), ["order_id"])


@query("order_items_stored", oracle=_ORDER_ITEMS)
def _(v: Inputs) -> DataFrame:
    """The same join of tables that are stored by order: this and every later one reads them without a shuffle."""
    place = scratch.scratch_database(v.spark)
    buckets = int(v.spark.conf.get("spark.sql.shuffle.partitions"))
    tables.overwrite_bucketed(_headers(v), f"{place}.order_headers", ["order_id"], buckets)
    tables.overwrite_bucketed(_items(v), f"{place}.order_items", ["order_id"], buckets)
    return joins.keyed_join(v.spark.table(f"{place}.order_headers"), v.spark.table(f"{place}.order_items"), ["order_id"])


@query(
    "interaction_matrix",
    oracle="""SELECT customer_id, touchpoint_id,
      CAST('0x' || substr(md5(customer_id || ':' || touchpoint_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE
        AS score
    FROM (SELECT c_custkey AS customer_id, p_partkey AS touchpoint_id FROM customer, part) m
    WHERE (customer_id, touchpoint_id) IN (
      SELECT (o_custkey, l_partkey) FROM orders JOIN lineitem ON o_orderkey = l_orderkey)""",
)
def _(v: Inputs) -> DataFrame:
    ordered = v.table("orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("customer_id"))
    bought = v.table("lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("touchpoint_id")
    )
    return joins.interaction_scores(
        joins.keyed_join(ordered, bought, ["k"]),
        v.table("customer").select(F.col("c_custkey").alias("customer_id")),
        v.table("part").select(F.col("p_partkey").alias("touchpoint_id")),
        "customer_id",
        "touchpoint_id",
    )


@query(
    "orphans",
    oracle="""SELECT o_orderkey AS order_id, o_custkey AS customer_id FROM orders
    WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)""",
)
def _(v: Inputs) -> DataFrame:
    child = v.table("orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id")
    )
    parent = v.table("customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("customer_id"))
    return joins.orphans(child, parent, ["customer_id"])
