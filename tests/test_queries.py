"""Every named query against its SQL on the smallest tables."""

from __future__ import annotations

import inspect
from pathlib import Path

import pytest

import __spark_entry__ as entry_points
from millrace.registry.catalogue import ORACLES, QUERIES
from tools.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    assert compare(spark, duck, FOLDER, name) == []


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()
    assert QUERIES.keys() <= entry_points.queries().keys()
    assert ORACLES.keys() <= entry_points.oracle_sql().keys()


def test_the_entry_query_has_rows(spark):
    df = entry_points.entry(spark)
    assert df.count() > 0
    assert df.columns == [
        "store_id", "product_category", "sale_date", "total_revenue", "total_units", "avg_order_value",
        "transaction_count",
    ]


def test_the_library_runs_no_python_per_row():
    root = Path(inspect.getfile(entry_points)).parent / "millrace"
    for path in root.rglob("*.py"):
        if path.relative_to(root).parts[0] == "llm":
            continue  # operators of a kind of their own, which nothing else imports
        source = path.read_text(encoding="utf-8")
        for call in ("udf(", ".rdd", "toPandas", "crossJoin", "localCheckpoint", "applyInPandas"):
            assert call not in source, f"{path.name} uses {call}"
