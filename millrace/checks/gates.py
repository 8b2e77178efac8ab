"""Gates: one aggregate each, raising with a count and a few examples instead of returning rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXAMPLES = 5


class GateFailed(AssertionError):
    """A table does not meet a condition its job relies on."""


def _fail_on_rows(bad: DataFrame, message: str) -> None:
    """Raise if `bad` has rows. The examples come first, so a sound table costs one short job."""
    sample = bad.limit(EXAMPLES).collect()
    if sample:
        shown = "; ".join(str(r.asDict()) for r in sample)
        raise GateFailed(f"{bad.count()} {message}, e.g. {shown}")


def require_rows(df: DataFrame, what: str = "result") -> None:
    if df.isEmpty():
        raise GateFailed(f"{what} is empty")


def require_no_nulls(df: DataFrame, required: Sequence[str]) -> None:
    nulls = [F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in required]
    counts = {c: n for c, n in df.agg(*nulls).first().asDict().items() if n}
    if counts:
        raise GateFailed(f"null values per required column: {counts}")


def require_rule(df: DataFrame, rule: str) -> None:
    """Every row meets the SQL `rule`; null counts as broken."""
    broken = ~F.coalesce(F.expr(rule), F.lit(False))
    _fail_on_rows(df.where(broken), f"row(s) break the rule {rule!r}")


def require_unique(df: DataFrame, keys: Sequence[str]) -> None:
    repeated = df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")
    _fail_on_rows(repeated, f"repeated key(s) {list(keys)}")


def require_single_current(history: DataFrame, key: str, flag: str) -> None:
    """No key has two current rows."""
    require_unique(history.where(F.col(flag)), [key])


def require_no_orphans(child: DataFrame, parent: DataFrame, keys: Sequence[str]) -> None:
    missing = child.join(parent.select(*keys), list(keys), "left_anti")
    _fail_on_rows(missing, f"row(s) without a parent on {list(keys)}")


def require_same_count(actual: DataFrame, expected: DataFrame) -> None:
    a, e = actual.count(), expected.count()
    if a != e:
        raise GateFailed(f"{a} rows where {e} were expected")


def require_exact_count(df: DataFrame, expected: int) -> None:
    actual = df.count()
    if actual != expected:
        raise GateFailed(f"{actual} rows where {expected} were expected")


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    if df.columns != list(columns):
        raise GateFailed(f"columns {df.columns} where {list(columns)} were expected")


def require_equal_totals(
    report: DataFrame, report_total: Column, source: DataFrame, source_total: Column
) -> None:
    a, e = report.agg(report_total).first()[0], source.agg(source_total).first()[0]
    if a != e:
        raise GateFailed(f"report total {a} where the source has {e}")


def require_totals(report: DataFrame, source: DataFrame, **pairs: tuple[Column, Column]) -> None:
    """Several totals at once: each table is read once, whatever their number."""
    left = report.agg(*[r.alias(name) for name, (r, _) in pairs.items()]).first()
    right = source.agg(*[s.alias(name) for name, (_, s) in pairs.items()]).first()
    wrong = [f"{n}: report total {left[n]} where the source has {right[n]}" for n in pairs if left[n] != right[n]]
    if wrong:
        raise GateFailed("; ".join(wrong))


def require_pattern(df: DataFrame, column: str, pattern: str) -> None:
    bad = df.where(~F.coalesce(F.col(column).rlike(pattern), F.lit(False)))
    _fail_on_rows(bad.groupBy(column).count(), f"value(s) of {column} do not match {pattern}")


def require_known(df: DataFrame, raw: str, resolved: Column) -> None:
    """Every `raw` value resolves; lists values that do not."""
    missing = df.where(resolved.isNull()).groupBy(raw).agg(F.count("*").alias("rows"))
    _fail_on_rows(missing, f"unknown value(s) of {raw}")
