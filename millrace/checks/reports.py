"""Checks across tables, as one result row per check (lazy; combine them with `unionByName`)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _row(check_id: str, frame: DataFrame, violations: Column, **values: Column) -> DataFrame:
    bad = F.coalesce(violations, F.lit(0)).cast("bigint")
    return frame.select(
        F.lit(check_id).alias("check_id"),
        *[v.alias(k) for k, v in values.items()],
        bad.alias("violations"),
        (bad == 0).alias("passed"),
    )


def _side_by_side(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two one-row frames as one row; `max` skips the nulls each lacks."""
    stacked = left.unionByName(right, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def orphan_report(check_id: str, child: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    lost = child.join(parent.select(*keys), list(keys), "left_anti")
    return _row(check_id, lost.agg(F.count(F.lit(1)).alias("n")), F.col("n"))


def totals_report(
    check_id: str,
    report: DataFrame,
    source: DataFrame,
    pairs: Mapping[str, tuple[Column, Column]],
) -> DataFrame:
    """One row per named total: the report's, the source's, and whether they agree.

    All totals of one side come from one aggregate over it.
    """
    left = report.agg(*[r.cast("decimal(38,2)").alias(f"r_{n}") for n, (r, _) in pairs.items()])
    right = source.agg(*[s.cast("decimal(38,2)").alias(f"s_{n}") for n, (_, s) in pairs.items()])
    both = _side_by_side(left, right)
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("total"),
                F.col(f"r_{n}").alias("report_total"),
                F.col(f"s_{n}").alias("source_total"),
            )
            for n in pairs
        ]
    )
    exploded = both.select(F.inline(rows))
    differs = ~F.col("report_total").eqNullSafe(F.col("source_total"))
    return _row(
        check_id,
        exploded,
        differs.cast("int"),
        total=F.col("total"),
        report_total=F.col("report_total"),
        source_total=F.col("source_total"),
    )


def count_report(
    check_id: str, actual: DataFrame, expected: DataFrame, expected_count: Column
) -> DataFrame:
    """Rows of `actual` against an aggregate of `expected` (its rows, or its distinct keys)."""
    left = actual.agg(F.count(F.lit(1)).alias("actual_rows"))
    right = expected.agg(expected_count.alias("expected_rows"))
    both = _side_by_side(left, right)
    gap = F.abs(F.col("actual_rows") - F.col("expected_rows"))
    return _row(
        check_id,
        both,
        gap,
        actual_rows=F.col("actual_rows"),
        expected_rows=F.col("expected_rows"),
    )


def exact_count_report(check_id: str, df: DataFrame, expected: int) -> DataFrame:
    one = df.agg(F.count(F.lit(1)).alias("actual_rows"))
    gap = F.abs(F.col("actual_rows") - F.lit(expected).cast("bigint"))
    return _row(check_id, one, gap, actual_rows=F.col("actual_rows"))


def unresolved_report(df: DataFrame, raw: str, resolved: Column) -> DataFrame:
    """Every value that has no entry in a lookup, with its row count; empty when all are covered."""
    return df.where(resolved.isNull()).groupBy(raw).agg(F.count(F.lit(1)).alias("rows"))


def raw_vs_clean_counts(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Rows before cleaning, after it, and dropped by it."""
    left = raw.agg(F.count(F.lit(1)).alias("raw_rows"))
    right = clean.agg(F.count(F.lit(1)).alias("clean_rows"))
    both = _side_by_side(left, right)
    return both.withColumn("dropped_rows", F.col("raw_rows") - F.col("clean_rows"))
