from __future__ import annotations

from datetime import date

from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.checks import gates, reports
from millrace.checks.contracts import CONTRACTS, contract
from millrace.checks.suite import (
    BadSpec,
    check_states,
    failed_required,
    load_spec,
    report_of_states,
    run_check_suite,
    validate_spec,
)


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, "Gold", 10, date(2026, 1, 1)), (2, "gold", 200, None), (2, None, None, None)]
    return spark.createDataFrame(rows, "id int, tier string, size int, since date")


def results(df, *checks, **options):
    spec = {"checks": list(checks), "required": [c["id"] for c in checks]}
    return {
        r["check_id"]: (r["violations"], r["passed"], r["rows_checked"])
        for r in run_check_suite(df, spec, **options).collect()
    }


def test_each_kind_counts_its_violations(people):
    found = results(
        people,
        {"id": "nulls", "type": "null_rate", "column": "tier", "max_pct": 0},
        {"id": "some nulls", "type": "null_rate", "column": "tier", "max_pct": 34},
        {"id": "values", "type": "accepted_values", "column": "tier", "values": ["Gold"]},
        {"id": "numbers", "type": "accepted_values", "column": "size", "values": ["10", "200"]},
        {"id": "range", "type": "range", "column": "size", "min": 11, "max": 199},
        {"id": "open range", "type": "range", "column": "size", "min": 10},
        {"id": "dates", "type": "range", "column": "since", "max": "2025-12-31"},
        {"id": "few", "type": "row_count", "min": 5},
        {"id": "many", "type": "row_count", "min": 1, "max": 2},
        {"id": "rule", "type": "row_rule", "rule": "size >= 10"},
        {"id": "pattern", "type": "pattern", "column": "tier", "pattern": "^[A-Z]"},
        {"id": "key", "type": "uniqueness", "columns": ["id"]},
        {"id": "full key", "type": "uniqueness", "columns": ["id", "tier"]},
        {"id": "order", "type": "columns", "columns": ["id", "size", "tier", "since"]},
        {"id": "schema", "type": "schema", "columns": [{"name": "id", "type": "bigint"}]},
        {
            "id": "strict",
            "type": "schema",
            "columns": [{"name": "id", "type": "int"}],
            "allow_extra_columns": False,
        },
    )
    assert {k: v[0] for k, v in found.items()} == {
        "nulls": 1, "some nulls": 0, "values": 1, "numbers": 0, "range": 2, "open range": 0, "dates": 1,
        "few": 2, "many": 1, "rule": 1, "pattern": 2, "key": 1, "full key": 0, "order": 2, "schema": 1,
        "strict": 3,
    }
    assert all(passed == (count == 0) and rows == 3 for count, passed, rows in found.values())


def test_an_empty_table_has_results_too(people):
    found = results(
        people.limit(0),
        {"id": "rows", "type": "row_count", "min": 1},
        {"id": "schema", "type": "schema", "columns": [{"name": "lost", "type": "int"}]},
        {"id": "key", "type": "uniqueness", "columns": ["id"]},
        {"id": "nulls", "type": "null_rate", "column": "id", "max_pct": 0},
    )
    assert found == {"rows": (1, False, 0), "schema": (1, False, 0), "key": (0, True, 0), "nulls": (0, True, 0)}


def test_a_phase_selects_its_checks(people):
    early = {"id": "a", "type": "row_count", "min": 1, "phases": ["branch"]}
    always = {"id": "b", "type": "row_count", "min": 9}
    assert set(results(people, early, always, phase="branch")) == {"a", "b"}
    assert set(results(people, early, always, phase="uat")) == {"b"}
    with pytest.raises(BadSpec):
        results(people, early, phase="uat")
    with pytest.raises(BadSpec):
        results(people, early, phase="later")


def test_only_required_checks_fail_a_table(people):
    spec = {
        "checks": [
            {"id": "a", "type": "row_count", "min": 9},
            {"id": "b", "type": "uniqueness", "columns": ["id"]},
        ],
        "required": ["b"],
    }
    assert failed_required(run_check_suite(people, spec)) == ["b"]


@pytest.mark.parametrize(
    "spec",
    [
        {"checks": [{"type": "row_count"}]},
        {"checks": [{"id": "a", "type": "row_count"}, {"id": "a", "type": "row_count"}]},
        {"checks": [{"id": "a", "type": "sorted"}]},
        {"checks": [{"id": "a", "type": "range"}]},
        {"checks": [{"id": "a", "type": "row_count", "phases": ["night"]}]},
        {"checks": [{"id": "a", "type": "row_count"}], "required": ["b"]},
    ],
)
def test_a_malformed_spec_is_refused(spec):
    with pytest.raises(BadSpec):
        validate_spec(spec)


def test_a_spec_file(people, tmp_path):
    path = tmp_path / "people.yaml"
    path.write_text(
        "table: a.b.people\nchecks:\n  - {id: key, type: uniqueness, columns: [id], phases: [uat]}\n"
        "required: [key]\n"
    )
    assert failed_required(run_check_suite(people, load_spec(path), "uat")) == ["key"]


def test_every_contract_is_well_formed():
    assert len(CONTRACTS) == 30
    for spec in CONTRACTS.values():
        validate_spec(spec)


def test_later_columns_are_not_checked_on_the_branch(people):
    spec = contract("t", {"id": "int"}, never_null=["health"], later={"health": "int"})
    report = run_check_suite(people, spec, "branch").collect()
    assert [r["check_id"] for r in report] == ["expected_schema"]


def test_gates_pass_on_sound_tables(spark, people):
    gates.require_rows(people)
    gates.require_no_nulls(people, ["id"])
    gates.require_rule(people, "id > 0")
    gates.require_unique(people, ["id", "tier"])
    gates.require_no_orphans(people, people, ["id"])
    gates.require_same_count(people, people)
    gates.require_exact_count(people, 3)
    gates.require_columns(people, ["id", "tier", "size", "since"])
    gates.require_equal_totals(people, F.sum("id"), people, F.sum("id"))
    gates.require_pattern(people.where("tier is not null"), "tier", "^[Gg]old$")
    gates.require_known(people, "id", F.col("id"))


@pytest.mark.parametrize(
    ("gate", "message"),
    [
        (lambda df: gates.require_rows(df.limit(0), "alerts"), "alerts is empty"),
        (lambda df: gates.require_no_nulls(df, ["id", "tier"]), "'tier': 1"),
        (lambda df: gates.require_rule(df, "size > 10"), "2 row"),
        (lambda df: gates.require_unique(df, ["id"]), "'id': 2"),
        (lambda df: gates.require_no_orphans(df, df.where("id = 1"), ["id"]), "2 row"),
        (lambda df: gates.require_same_count(df, df.limit(1)), "3 rows where 1"),
        (lambda df: gates.require_exact_count(df, 6), "3 rows where 6"),
        (lambda df: gates.require_columns(df, ["tier", "id"]), "columns"),
        (lambda df: gates.require_equal_totals(df, F.sum("id"), df, F.lit(4)), "total 5"),
        (lambda df: gates.require_pattern(df, "tier", "^G"), "do not match"),
        (lambda df: gates.require_known(df, "size", F.when(F.col("size") < 100, 1)), "unknown value"),
    ],
)
def test_gates_fail_with_an_example(people, gate, message):
    with pytest.raises(gates.GateFailed, match=message):
        gate(people)


def test_two_current_rows_are_refused(spark):
    history = spark.createDataFrame(
        [("a", True), ("a", False), ("b", True)], "k string, is_current boolean"
    )
    gates.require_single_current(history, "k", "is_current")
    with pytest.raises(gates.GateFailed, match="'a'"):
        gates.require_single_current(history.withColumn("is_current", F.lit(True)), "k", "is_current")


def test_reports(people, rows_of):
    assert rows_of(reports.count_report("c", people, people, F.count_distinct("id"))) == [
        ("c", 3, 2, 1, False)
    ]
    assert rows_of(reports.exact_count_report("c", people, 3)) == [("c", 3, 0, True)]
    assert rows_of(reports.orphan_report("o", people, people.where("id = 1"), ["id"])) == [("o", 2, False)]
    assert rows_of(reports.raw_vs_clean_counts(people, people.where("size is not null"))) == [(3, 2, 1)]
    totals = reports.totals_report(
        "t", people, people.limit(0), {"n": (F.sum("id"), F.sum("id")), "m": (F.lit(1), F.lit(1))}
    ).collect()
    assert {r["total"]: (r["violations"], r["source_total"]) for r in totals}["n"] == (1, None)
    assert rows_of(reports.unresolved_report(people, "tier", F.when(F.col("tier") == "Gold", 1))) == [
        ("gold", 1), (None, 1),
    ]


def test_any_number_of_checks_scans_the_table_once(spark, tmp_path):
    rows = spark.range(40).selectExpr("id % 7 AS a", "id % 5 AS b", "if(id % 4 = 0, null, id) AS c")
    rows.write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    keys = [["a"], ["b"], ["a", "b"], ["c"], ["a", "c"]]
    checks = [{"id": f"key {i}", "type": "uniqueness", "columns": k} for i, k in enumerate(keys)]
    checks += [{"id": f"rule {i}", "type": "row_rule", "rule": f"c > {i} OR c IS NULL"} for i in range(130)]
    checks += [{"id": "nulls", "type": "null_rate", "column": "c", "max_pct": 10}, {"id": "rows", "type": "row_count", "min": 41}]
    report = run_check_suite(table, {"checks": checks})
    assert report._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    got = {r["check_id"]: r["violations"] for r in report.collect()}
    for i, k in enumerate(keys):
        assert got[f"key {i}"] == table.groupBy(*k).count().where("count > 1").count()
    assert [got[f"rule {i}"] for i in (0, 1, 59, 60, 129)] == [table.where(f"c <= {i}").count() for i in (0, 1, 59, 60, 129)]
    assert (got["nulls"], got["rows"]) == (10, 1)
    assert all(r["rows_checked"] == 40 for r in report.collect())


def test_checks_of_an_empty_table(spark):
    spec = {"checks": [{"id": "key", "type": "uniqueness", "columns": ["id"]}, {"id": "rows", "type": "row_count", "min": 1}]}
    got = {r["check_id"]: (r["rows_checked"], r["violations"], r["passed"]) for r in run_check_suite(spark.range(0), spec).collect()}
    assert got == {"key": (0, 0, True), "rows": (0, 1, False)}


def test_states_of_parts_add_up_to_the_report_of_the_whole(spark):
    rows = spark.range(50).selectExpr("id", "id % 4 AS part", "if(id % 6 = 0, null, id) AS v")
    checks = [
        {"id": "nulls", "type": "null_rate", "column": "v", "max_pct": 5},
        {"id": "few nulls", "type": "null_rate", "column": "v", "max_pct": 50},
        {"id": "range", "type": "range", "column": "v", "min": 3, "max": 40},
        {"id": "rule", "type": "row_rule", "rule": "v < 49"},
        {"id": "rows", "type": "row_count", "min": 51},
        {"id": "columns", "type": "columns", "columns": ["id", "part"]},
    ]
    spec = {"checks": checks, "required": ["rule"]}
    states = [check_states(rows.where(f"part = {p}"), spec) for p in range(5)]  # the last part is empty
    every = reduce(DataFrame.unionByName, states)
    expected = sorted(tuple(r) for r in run_check_suite(rows, spec).collect())
    assert sorted(tuple(r) for r in report_of_states(every, rows, spec).collect()) == expected
    with pytest.raises(BadSpec, match="added up"):
        check_states(rows, {"checks": [{"id": "key", "type": "uniqueness", "columns": ["id"]}]})
