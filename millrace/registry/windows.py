"""One row per key, rolling metrics, ordered event lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import journeys, keyed, rolling
from millrace.plans import accounts, orders
from millrace.registry.base import Inputs, half_up, query, typed
from millrace.registry.joins import TIERS_CTE


@query(
    "first_per_key",
    oracle="""SELECT * EXCLUDE (n) FROM (SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey,
        l_extendedprice, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
          ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n
      FROM lineitem) WHERE n = 1""",
)
def _(v: Inputs) -> DataFrame:
    lines = v.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"
    )
    return keyed.first_per_key(lines, ["l_orderkey", "l_linenumber"], ["l_shipdate"])


@query(
    "latest_per_key",
    views=["dim_customer"],
    oracle="""SELECT customer_id, arg_max(customer_tier, _ingest_seq) AS customer_tier,
      arg_max(signup_region, _ingest_seq) AS signup_region, max(_ingest_seq) AS _ingest_seq
    FROM dim_customer GROUP BY customer_id""",
)
def _(v: Inputs) -> DataFrame:
    return keyed.latest_per_key(v.dim_customer, ["customer_id"], "_ingest_seq")


@query(
    "latest_nulls_last",
    views=["crm_tiers_raw"],
    oracle=f", {TIERS_CTE} SELECT account_id, tier, tier_since FROM clean_tiers",
)
def _(v: Inputs) -> DataFrame:
    return accounts.clean_tiers(v.crm_tiers_raw).select("account_id", "tier", "tier_since")


@query(
    "drop_duplicates",
    views=["customers_global"],
    oracle="SELECT DISTINCT customer_id, trim(customer_name) AS customer_name, country FROM customers_global",
)
def _(v: Inputs) -> DataFrame:
    return orders.silver_customers(v.customers_global)


@query(
    "rolling_rows",
    views=["store_sales"],
    oracle=f"""SELECT store_id, sale_date, transaction_id, product_id, revenue,
      CAST(sum(revenue) OVER w AS DECIMAL(22,2)) AS rolling_revenue,
      count(revenue) OVER w AS rolling_order_count,
      {half_up("sum(revenue) OVER w * 100", "count(revenue) OVER w * 100", 6)} AS rolling_avg_order_value
    FROM store_sales WINDOW w AS (PARTITION BY store_id
      ORDER BY sale_date, transaction_id, product_id, revenue ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
)
def _(v: Inputs) -> DataFrame:
    metrics = rolling.rolling_rows(
        v.store_sales, "store_id", "sale_date", "revenue", 7, ["transaction_id"]
    )
    return typed(metrics, rolling_revenue="decimal(22,2)", rolling_avg_order_value="decimal(18,6)")


@query(
    "rolling_days",
    views=["store_sales"],
    oracle=f"""SELECT DISTINCT store_id, sale_date,
      CAST(sum(revenue) OVER w AS DECIMAL(32,2)) AS rolling_revenue,
      CAST(count(revenue) OVER w AS BIGINT) AS rolling_order_count,
      {half_up("sum(revenue) OVER w * 100", "count(revenue) OVER w * 100", 6)} AS rolling_avg_order_value
    FROM store_sales WINDOW w AS (PARTITION BY store_id ORDER BY sale_date
      RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)""",
)
def _(v: Inputs) -> DataFrame:
    metrics = rolling.rolling_days(v.store_sales, "store_id", "sale_date", "revenue", 7)
    return typed(metrics, rolling_revenue="decimal(32,2)", rolling_avg_order_value="decimal(18,6)")


@query(
    "event_journeys",
    views=["journey_events"],
    oracle="""SELECT customer_id, part_no, count(*) AS event_count, min(event_seq) AS first_event_seq,
      max(event_seq) AS last_event_seq, string_agg(payload, '|' ORDER BY event_seq) AS events
    FROM (SELECT *, (row_number() OVER (PARTITION BY customer_id ORDER BY event_seq) - 1) // 1000
            AS part_no FROM journey_events) GROUP BY customer_id, part_no""",
)
def _(v: Inputs) -> DataFrame:
    """The list is joined to one text so that both engines return the same type."""
    parts = journeys.event_journeys(
        v.journey_events,
        "customer_id",
        "event_seq",
        "payload",
        max_events=1000,
    )
    return parts.withColumn("events", F.array_join("events", "|"))
