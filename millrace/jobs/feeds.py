"""Landings, reference tables, and enrichment of items, events and loyalty feeds."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame

from millrace.checks.gates import GateFailed, require_same_count
from millrace.jobs.base import Store, exact_columns, exact_rows, unique
from millrace.operators.joins import enrich, match
from millrace.operators.journeys import event_journeys
from millrace.plans.shipping import FEED_COLUMNS
from millrace.sinks import tables
from millrace.sources import readers

# The warehouses shipments start from.
WAREHOUSE_COLUMNS = (
    "warehouse_id string, warehouse_name string, region string, city string, capacity_pallets bigint, "
    "opened_on date, ops_team string, is_active boolean"
)
WAREHOUSES = [
    ("WH01", "Riverside Hub", "North", "Leeds", 4200, date(2019, 3, 4), "Inbound A", True),
    ("WH02", "Canal Street DC", "North", "Manchester", 3800, date(2020, 6, 15), "Inbound A", True),
    ("WH03", "Harbour Gate", "South", "Southampton", 5100, date(2018, 1, 22), "Port Ops", True),
    ("WH04", "Oakfield Depot", "South", "Reading", 2600, date(2021, 9, 1), "Inbound B", True),
    ("WH05", "Eastmoor Park", "East", "Norwich", 3100, date(2017, 11, 13), "Inbound B", True),
    ("WH06", "Fenland Store", "East", "Cambridge", 2200, date(2022, 2, 28), "Outbound C", True),
    ("WH07", "Westway Logistics", "West", "Bristol", 4700, date(2016, 5, 9), "Outbound C", True),
    ("WH08", "Severn Cross", "West", "Cardiff", 3300, date(2019, 8, 19), "Port Ops", True),
    ("WH09", "Midland Link", "Central", "Birmingham", 6000, date(2015, 4, 6), "Hub Ops", True),
    ("WH10", "Trent Valley", "Central", "Nottingham", 2900, date(2023, 1, 9), "Hub Ops", True),
    ("WH11", "Highland Point", "North", "Glasgow", 2400, date(2020, 10, 5), "Outbound D", True),
    ("WH12", "Old Mill Annex", "Central", "Leicester", 900, date(2014, 7, 21), "Hub Ops", False),
]


def carrier_feed(store: Store, feed: str) -> int:
    """The carriers' text export at `feed` -> sd_carrier_feed, every column as text."""
    delivered = readers.scan_text_feed(store.spark, feed, FEED_COLUMNS)
    store.publish("sd_carrier_feed", delivered, exact_columns(FEED_COLUMNS))
    return store.read("sd_carrier_feed").count()


def warehouses(store: Store) -> None:
    """The fixed warehouse list -> sd_warehouses."""
    columns = [c.split()[0] for c in WAREHOUSE_COLUMNS.split(", ")]
    houses = readers.typed_rows(store.spark, WAREHOUSES, WAREHOUSE_COLUMNS)
    store.publish("sd_warehouses", houses, exact_columns(columns), exact_rows(len(WAREHOUSES)))


def order_items(store: Store) -> None:
    """order_headers, order_line_items -> enriched_order_items, joined on the order, one row per item."""
    items = store.read("order_line_items")
    store.publish(
        "enriched_order_items", match(items, store.read("order_headers"), ["order_id"]), unique("line_item_id"),
        audit=lambda rows: require_same_count(rows, items),
    )


def catalog_enrichment(store: Store) -> None:
    """order_items, product_catalog -> catalog_order_items; the catalogue is not forced into a broadcast."""
    items = store.read("order_items")
    store.publish(
        "catalog_order_items", enrich(items, store.read("product_catalog"), ["product_id"]),
        audit=lambda rows: require_same_count(rows, items),
    )


def journeys(store: Store, max_events: int = 10_000) -> None:
    """order_events -> customer_journeys, each customer's events in parts of bounded length."""
    events = store.read("order_events")
    parts = event_journeys(events, "customer_id", "event_seq", "payload", max_events)

    def complete(rows: DataFrame) -> None:
        kept, given = rows.agg({"event_count": "sum"}).first()[0] or 0, events.count()
        if kept != given:
            raise GateFailed(f"{kept} events in journeys, {given} in order_events")

    store.publish("customer_journeys", parts, unique("customer_id", "part_no"), audit=complete)


def loyalty(store: Store, feed: str) -> None:
    """loyalty_customers and the vendor's parquet feed at `feed` -> loyalty_enriched, one row per customer."""
    people = store.read("loyalty_customers")
    extended = readers.scan_parquet(store.spark, feed)
    store.publish(
        "loyalty_enriched", enrich(people, extended, ["customer_id"]),
        audit=lambda rows: require_same_count(rows, people),
    )


def audit_snapshot(store: Store, run: str | None = None) -> None:
    """audit_grants appended to audit_trail_snapshot, a table of the store's own schema.

    With the name of a `run`, its snapshot is kept under it, and a rerun replaces that instead of adding another.
    """
    grants, table = store.read("audit_grants"), store.name("audit_trail_snapshot")
    if run is None:
        tables.append(grants, table)
    else:
        tables.replace_slice(grants, table, "run", run)
