"""Operators against plain Python on small random tables."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millrace.operators import joins, journeys, keyed, rolling, skew


def test_the_first_row_per_trimmed_key_is_repeatable(spark, rows_of):
    rows = [("a ", 2, "x"), (" a", 1, "z"), ("a", 1, "y"), ("b", 5, None), (None, 1, "n"), (None, 1, "m")]
    expected = [("a", 1, "y"), ("b", 5, None), (None, 1, "m")]
    for seed in range(5):
        shuffled = random.Random(seed).sample(rows, len(rows))
        df = spark.createDataFrame(shuffled, "k string, o int, v string").repartition(3)
        picked = keyed.first_per_trimmed_key(df, "k", ["o"])
        assert rows_of(picked) == sorted(expected, key=repr)


def test_first_per_key_ships_one_row_per_key_and_task(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    plan = keyed.first_per_key(df, ["k"], ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_the_latest_row_per_key(spark, rows_of):
    df = spark.createDataFrame([(1, "a", 0), (1, "b", 4), (2, "c", 1), (2, "d", None)], "k int, v string, s int")
    assert rows_of(keyed.latest_per_key(df, ["k"], "s")) == [(1, "b", 4), (2, "c", 1)]


def test_changes_are_netted(spark, rows_of):
    df = spark.createDataFrame([("a", 5.0), ("a", -2.0), ("b", 1.0)], "k string, amount double")
    assert rows_of(keyed.net_changes(df, ["k"], "amount")) == [("a", 3.0), ("b", 1.0)]
    assert rows_of(keyed.repeated_keys(df, ["k"])) == [("a", 2)]


def test_a_join_needs_keys_of_both_sides(spark):
    left, right = spark.range(3).toDF("a"), spark.range(3).toDF("b")
    with pytest.raises(ValueError, match="non-empty"):
        joins.keyed_join(left, right, [])
    with pytest.raises(ValueError, match="right side lacks"):
        joins.keyed_join(left, right, ["a"])
    with pytest.raises(ValueError, match="cross"):
        joins.keyed_join(left, left, ["a"], "cross")


def test_orphans_include_null_keys(spark, rows_of):
    child = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    parent = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    assert rows_of(joins.orphans(child, parent, ["k"])) == [(2,), (None,)]


def test_a_dimension_is_broadcast_only_within_its_measured_size(spark, rows_of):
    facts = spark.range(100).select((F.col("id") % 10).alias("k"), "id")
    dim = spark.range(10).select(F.col("id").alias("k"), F.lit("x" * 100).alias("text"))
    assert joins.fits_broadcast(dim, 10, 10_000)
    assert not joins.fits_broadcast(dim, 9, 10_000)
    assert not joins.fits_broadcast(dim, 10, 1_000)
    assert joins.fits_broadcast(dim.limit(0), 10, 1)
    small = joins.enrich_small(facts, dim, ["k"])
    large = joins.enrich_small(facts, dim, ["k"], max_bytes=1_000)

    def hinted(df):
        return "strategy=broadcast" in df._jdf.queryExecution().analyzed().toString()

    assert hinted(small) and not hinted(large)
    assert rows_of(small) == rows_of(large)


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("limit", [0, 30, 10_000])
def test_joining_a_busy_key_equals_a_plain_join(spark, rows_of, how, limit):
    rng = random.Random(limit)
    rows = [(rng.choice([1, 1, 1, 2, 3, 4, 5, None, None, 9]), i) for i in range(300)]
    facts = spark.createDataFrame(rows, "k int, id int").repartition(3)
    dim = spark.createDataFrame([(1, "a", None), (2, "b", 1.0), (3, None, None), (7, "g", 2.0)], "k int, v string, w double")
    joined = skew.enrich_hot(facts, dim, ["k"], how, max_rows=limit)
    plain = facts.join(dim, ["k"], how)
    assert joined.columns == plain.columns
    assert rows_of(joined) == rows_of(plain)


def test_a_busy_key_is_spread_in_the_shuffle_of_the_join(spark):
    facts = spark.range(100).select((F.col("id") % 2).alias("k"), "id")
    dim = keyed.first_per_key(spark.range(9).select(F.col("id").alias("k"), F.lit(1).alias("v")), ["k"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = skew.enrich_hot(facts, dim, ["k"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan
    assert any("hashpartitioning(k" in line and "__spread" in line for line in plan.splitlines())


def test_interactions_are_scored_without_a_product(spark, rows_of):
    seen = spark.createDataFrame([(1, 7), (1, 7), (2, 8), (3, 7), (1, 9)], "c int, t int")
    people = spark.createDataFrame([(1,), (2,)], "c int")
    points = spark.createDataFrame([(7,), (8,)], "t int")
    scored = joins.interaction_scores(seen, people, points, "c", "t")
    rows = rows_of(scored)
    assert [r[:2] for r in rows] == [(1, 7), (2, 8)]
    assert all(0 <= r[2] < 1 for r in rows)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def sales_rows(seed: int, count: int) -> list[tuple]:
    """Rows of which a third belong to one store, some without a store or a day."""
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        store = "HOT" if rng.random() < 0.4 else rng.choice(["A", "B", "C", None])
        day = None if rng.random() < 0.05 else date(2026, 8, 1) + timedelta(days=rng.randint(0, 20))
        amount = None if rng.random() < 0.05 else Decimal(rng.randint(1, 99999)) / 100
        rows.append((store, day, i, amount))
    return rows


SALES = "store_id string, day date, id int, revenue decimal(12,2)"


def brute_rolling_rows(rows, width):
    expected = {}
    by_store = defaultdict(list)
    for row in rows:
        by_store[row[0]].append(row)
    for group in by_store.values():
        group.sort(key=lambda r: (r[1] is not None, r[1] or date.min, r[2]))
        for i, row in enumerate(group):
            values = [r[3] for r in group[max(0, i - width + 1) : i + 1] if r[3] is not None]
            expected[row[2]] = (sum(values) if values else None, len(values))
    return expected


@pytest.mark.parametrize("partitions", [1, 3, 17])
@pytest.mark.parametrize("block", [7, 20, 1000])
def test_rolling_rows_do_not_depend_on_partitions_or_blocks(spark, partitions, block):
    rows = sales_rows(partitions, 400)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(rows, SALES).repartition(5)
        out = rolling.rolling_rows(df, "store_id", "day", "revenue", 7, ["id"], block)
        assert out.columns[:4] == df.columns
        found = out.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(found) == len(rows)
    got = {r["id"]: (r["rolling_revenue"], r["rolling_order_count"]) for r in found}
    assert got == brute_rolling_rows(rows, 7)


@pytest.mark.parametrize("days", [[f"2024-01-{d}" for d in range(1, 13)], [None], ["2024-01-1"]])
@pytest.mark.parametrize("partitions", [1, 8])
def test_rolling_rows_order_text_days_null_days_and_one_busy_day(spark, days, partitions):
    """Text days are ordered as text, whatever date they would be."""
    rng = random.Random(len(days))
    rows = [("S", rng.choice(days), i, i % 7) for i in range(200)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(rows, "store string, day string, id int, amount int").repartition(3)
        out = rolling.rolling_rows(df, "store", "day", "amount", 5, ["id"], 16).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    ordered = sorted(rows, key=lambda r: (r[1] or "", r[2]))
    expected = {r[2]: sum(x[3] for x in ordered[max(0, i - 4) : i + 1]) for i, r in enumerate(ordered)}
    assert {r["id"]: r["rolling_revenue"] for r in out} == expected


def test_ordering_scans_the_facts_twice_at_most(spark):
    df = spark.createDataFrame(sales_rows(2, 50), SALES)
    out = rolling.rolling_rows(df, "store_id", "day", "revenue", 7, ["id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") + plan.count("Scan ExistingRDD") <= 2


def test_rolling_rows_refuse_a_frame_longer_than_a_block(spark):
    df = spark.createDataFrame(sales_rows(1, 5), SALES)
    with pytest.raises(ValueError):
        rolling.rolling_rows(df, "store_id", "day", "revenue", 7, block_rows=6)


def test_rolling_days_cover_calendar_days(spark):
    rows = [r for r in sales_rows(3, 300) if r[1] is not None]
    out = rolling.rolling_days(spark.createDataFrame(rows, SALES), "store_id", "day", "revenue", 7)
    days = {(r[0], r[1]) for r in rows}
    got = {(r[0], r[1]): (r[2], r[3]) for r in out.collect()}
    assert set(got) == days
    for store, day in days:
        inside = [
            r[3]
            for r in rows
            if r[0] == store and day - timedelta(days=6) <= r[1] <= day and r[3] is not None
        ]
        assert got[store, day] == (sum(inside) if inside else None, len(inside))


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_journeys_keep_every_event_in_order(spark, partitions):
    rng = random.Random(partitions)
    rows = [
        ("UNKNOWN" if rng.random() < 0.6 else f"C{rng.randint(1, 9)}", rng.randint(0, 99), f"p{i:04d}")
        for i in range(500)
    ]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(rows, "c string, seq int, payload string").repartition(4)
        found = journeys.event_journeys(df, "c", "seq", "payload", 25).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    parts = sorted(found, key=lambda r: (r["c"], r["part_no"]))
    assert all(len(p["events"]) == p["event_count"] <= 25 for p in parts)
    full = defaultdict(list)
    for part in parts:
        assert part["part_no"] * 25 == len(full[part["c"]])
        full[part["c"]] += part["events"]
    expected = defaultdict(list)
    for c, _, payload in sorted(rows, key=lambda r: (r[1], r[2])):
        expected[c].append(payload)
    assert full == expected


@pytest.fixture
def many_partitions(spark):
    """Small tables stay dealt over eight partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    shuffled = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", shuffled)


def test_only_keys_of_several_partitions_are_placed(spark, many_partitions):
    rng = random.Random(5)
    rows = [(rng.choice(["HOT"] * 5 + ["A", "B", "C", "D", None]), rng.randint(0, 9), i) for i in range(400)]
    found = skew.order_rows(spark.createDataFrame(rows, "k string, o int, id int"), "k", ["o"]).collect()
    assert len(found) == 400
    blocks, places = defaultdict(set), defaultdict(list)
    for r in sorted(found, key=lambda r: r[skew.ORDER]):
        blocks[r["k"]].add(r[skew.ORDER] >> 33)
        places[r["k"]].append((r[skew.PLACE], r["o"], r["id"]))
    assert len(blocks["HOT"]) > 1 and any(len(b) == 1 for b in blocks.values())
    for k, listed in places.items():
        wanted = range(len(listed)) if len(blocks[k]) > 1 else [None] * len(listed)
        assert [p for p, _, _ in listed] == list(wanted)
        assert [r[1:] for r in listed] == sorted(r[1:] for r in listed)


@pytest.mark.parametrize("block", [7, 20, 1000])
def test_frames_and_journeys_of_keys_in_several_partitions(spark, many_partitions, block):
    rows = sales_rows(8, 400)
    sales = spark.createDataFrame(rows, SALES)
    framed = rolling.rolling_rows(sales, "store_id", "day", "revenue", 7, ["id"], block).collect()
    assert {r["id"]: (r["rolling_revenue"], r["rolling_order_count"]) for r in framed} == brute_rolling_rows(rows, 7)
    events = [(None if i % 3 else i % 11, i // 2, f"p{i:03}") for i in range(400)]
    parts = journeys.event_journeys(spark.createDataFrame(events, "c int, seq int, payload string"), "c", "seq", "payload", block).collect()
    whole = defaultdict(list)
    for r in sorted(parts, key=lambda r: r["part_no"]):
        assert r["event_count"] == len(r["events"]) <= block
        whole[r["c"]] += r["events"]
    expected = defaultdict(list)
    for c, _, payload in events:
        expected[c].append(payload)
    assert whole == expected
    for c, n in ((c, len(e)) for c, e in expected.items()):
        assert sorted(r["part_no"] for r in parts if r["c"] == c) == list(range(-(-n // block)))


def test_ordered_work_is_shuffled_once_after_it_is_ordered(spark):
    sales = spark.createDataFrame(sales_rows(8, 50), SALES)
    framed = rolling.rolling_rows(sales, "store_id", "day", "revenue", 7, ["id"])
    parts = journeys.event_journeys(sales, "store_id", "id", "day", 5)
    for df in (framed, parts):
        plan = df._jdf.queryExecution().executedPlan().toString()
        # The facts' only exchange; those over `__b` and `__k` hold a row per key and partition.
        assert sum("hashpartitioning(store_id" in line for line in plan.splitlines()) == 1, plan
        assert "SortMergeJoin" not in plan
