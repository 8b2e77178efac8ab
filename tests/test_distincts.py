"""Distinct counts from bitmaps, against counting the rows anew."""

from __future__ import annotations

import random

import pytest

from millrace.operators import distincts

KEYS = ["country", "channel"]


def _orders(spark, seed, n=3000, ids=400):
    """A third of all rows are one customer's; some customers and countries are null."""
    pick = random.Random(seed)
    rows = []
    for _ in range(n):
        customer = "c0" if pick.random() < 1 / 3 else pick.choice([None, *[f"c{i}" for i in range(ids)]])
        rows.append((pick.choice(["A", "B", None]), pick.choice(["web", "shop"]), customer))
    return spark.createDataFrame(rows, "country string, channel string, customer string").repartition(5)


def _plain(rows):
    """Counts of distinct customers by level, from the rows themselves."""
    sets = {(0, None, None): set()}
    for country, channel, customer in rows:
        for group in ((2, country, channel), (1, country, None), (0, None, None)):
            if customer is not None:
                sets.setdefault(group, set()).add(customer)
    return sorted(((*group, len(s)) for group, s in sets.items()), key=repr)


def test_numbers_have_no_gaps_and_stay(spark, schema):
    table = f"{schema}.numbers"
    distincts.number_ids(spark, table, _orders(spark, 1), "customer")
    before = {r["customer"]: r["number"] for r in spark.table(table).collect()}
    assert sorted(before.values()) == list(range(1, len(before) + 1))
    for _ in range(2):
        distincts.number_ids(spark, table, _orders(spark, 2, ids=700), "customer")
    after = {r["customer"]: r["number"] for r in spark.table(table).collect()}
    assert sorted(after.values()) == list(range(1, len(after) + 1))
    assert before.items() <= after.items() and len(after) > len(before) and None not in after
    assert spark.table(table).count() == len(after)


def test_batches_roll_up_to_the_counts_of_all_rows(spark, schema, rows_of):
    states, numbers = f"{schema}.states", f"{schema}.numbers"
    batches = [_orders(spark, seed) for seed in (3, 4)]
    for batch in (*batches, batches[0]):  # the first is delivered twice
        distincts.add_distincts(spark, states, numbers, batch, KEYS, "customer")
    expected = _plain([tuple(r) for b in batches for r in b.collect()])
    found = lambda: rows_of(distincts.distinct_levels(spark.table(states), KEYS, "customers"))
    assert found() == expected
    sizes = spark.table(states).count()
    distincts.compact_distincts(spark, states, KEYS)
    assert spark.table(states).count() < sizes
    assert found() == expected


def test_numbers_beyond_one_bitmap(spark, schema, rows_of):
    """100,000 ids need four bitmaps of 32,768 bits."""
    rows = spark.range(100_000).selectExpr("CAST(id % 2 AS string) AS country", "'web' AS channel", "id AS customer")
    states, numbers = f"{schema}.states", f"{schema}.numbers"
    distincts.add_distincts(spark, states, numbers, rows, KEYS, "customer")
    assert spark.table(states).select("bucket").distinct().count() == 4
    assert rows_of(distincts.distinct_counts(spark.table(states), ["country"], "n")) == [("0", 50_000), ("1", 50_000)]
    assert rows_of(distincts.distinct_counts(spark.table(states), [], "n")) == [(100_000,)]


def test_an_empty_table_counts_nothing(spark, schema, rows_of):
    states, numbers = f"{schema}.states", f"{schema}.numbers"
    distincts.add_distincts(spark, states, numbers, _orders(spark, 5).limit(0), KEYS, "customer")
    assert rows_of(distincts.distinct_levels(spark.table(states), KEYS, "n")) == [(0, None, None, 0)]


def test_a_value_without_a_number_stops_the_count(spark, schema):
    numbers = f"{schema}.numbers"
    distincts.number_ids(spark, numbers, _orders(spark, 6, ids=5), "customer")
    states = distincts.distinct_states(_orders(spark, 6), spark.table(numbers), KEYS, "customer")
    with pytest.raises(Exception, match="no number for customer"):
        states.collect()


def test_roll_ups_read_bitmaps_only(spark, schema):
    states, numbers = f"{schema}.states", f"{schema}.numbers"
    distincts.add_distincts(spark, states, numbers, _orders(spark, 7), KEYS, "customer")
    plan = distincts.distinct_counts(spark.table(states), ["country"], "n")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "customer" not in plan
