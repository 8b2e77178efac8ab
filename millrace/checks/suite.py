"""Declarative table checks: a spec in, one result row per check out.

A spec is a mapping (or a YAML file) with `table`, `checks` and `required`; each check has an `id`,
a `type`, its parameters and the `phases` it runs in. All checks of a spec come from one scan: each row is counted
once under the set of row checks it breaks, and once under its key of every uniqueness check.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PHASES = ("branch", "uat", "postprod")
RESULT_COLUMNS = ["check_id", "check_type", "required", "rows_checked", "violations", "passed"]

Spec = Mapping[str, Any]


class BadSpec(ValueError):
    """A check spec that cannot be run."""


def load_spec(path: str | Path) -> dict[str, Any]:
    try:
        import yaml
    except ImportError as missing:
        raise BadSpec("reading a spec file needs PyYAML; pass the spec as a mapping") from missing
    return yaml.safe_load(Path(path).read_text(encoding="utf-8"))


# Whether a row breaks a check.


def _is_null(check: Spec) -> Column:
    return F.col(check["column"]).isNull()


def _accepted_values(check: Spec) -> Column:
    values = [str(v) for v in check["values"]]
    return ~F.col(check["column"]).cast("string").isin(values)


def _range(check: Spec) -> Column:
    value = F.col(check["column"])
    outside = F.lit(False)
    if check.get("min") is not None:
        outside = outside | (value < F.lit(check["min"]))
    if check.get("max") is not None:
        outside = outside | (value > F.lit(check["max"]))
    return outside


def _rule(check: Spec) -> Column:
    return ~F.coalesce(F.expr(check["rule"]), F.lit(False))


def _pattern(check: Spec) -> Column:
    return ~F.coalesce(F.col(check["column"]).rlike(check["pattern"]), F.lit(False))


_BROKEN: dict[str, Callable[[Spec], Column]] = {
    "null_rate": _is_null,
    "accepted_values": _accepted_values,
    "range": _range,
    "row_rule": _rule,
    "pattern": _pattern,
}


# Violations of a check, from the rows that break it and all rows.


def _null_rate(check: Spec, broken: Column, rows: Column) -> Column:
    allowed = rows * F.lit(float(check.get("max_pct", 0))) / 100
    return F.when(broken > allowed, broken).otherwise(0)


def _row_count(check: Spec, rows: Column) -> Column:
    short = F.greatest(F.lit(check.get("min", 0)).cast("bigint") - rows, F.lit(0))
    if check.get("max") is None:
        return short
    return short + F.greatest(rows - F.lit(check["max"]).cast("bigint"), F.lit(0))


_NEEDS = {
    "schema": ("columns",),
    "columns": ("columns",),
    "uniqueness": ("columns",),
    "null_rate": ("column",),
    "accepted_values": ("column", "values"),
    "range": ("column",),
    "row_count": (),
    "row_rule": ("rule",),
    "pattern": ("column", "pattern"),
}


def schema_differences(df: DataFrame, check: Spec) -> list[str]:
    """Declared columns that are missing or of another type, and undeclared ones if not allowed."""
    actual = dict(df.dtypes)
    declared = {c["name"]: c["type"] for c in check["columns"]}
    wrong = [
        f"{name}: {actual.get(name, 'missing')} instead of {kind}"
        for name, kind in declared.items()
        if actual.get(name) != kind
    ]
    if not check.get("allow_extra_columns", True):
        wrong += [f"{name}: not declared" for name in actual if name not in declared]
    return wrong


def column_differences(df: DataFrame, check: Spec) -> list[str]:
    """Positions at which the columns differ from the declared list."""
    declared, actual = list(check["columns"]), df.columns
    length = max(len(declared), len(actual))
    pairs = zip(declared + [None] * length, actual + [None] * length, range(length))
    return [f"{i}: {a} instead of {d}" for d, a, i in pairs if a != d]


_DECLARED = {"schema": schema_differences, "columns": column_differences}


def validate_spec(spec: Spec) -> None:
    checks = spec.get("checks", [])
    ids = [c.get("id") for c in checks]
    if None in ids or len(set(ids)) != len(ids):
        raise BadSpec("every check needs an id of its own")
    for check in checks:
        kind = check.get("type")
        if kind not in _NEEDS:
            raise BadSpec(f"{check['id']}: unknown check type {kind!r}")
        absent = [p for p in _NEEDS[kind] if p not in check]
        if absent:
            raise BadSpec(f"{check['id']}: missing {absent}")
        unknown = set(check.get("phases", PHASES)) - set(PHASES)
        if unknown:
            raise BadSpec(f"{check['id']}: unknown phase(s) {sorted(unknown)}")
    lost = set(spec.get("required", [])) - set(ids)
    if lost:
        raise BadSpec(f"required names checks that do not exist: {sorted(lost)}")


#: Row checks per number that tells the set a row breaks.
_BITS = 60


def _counted(df: DataFrame, row_checks: Sequence[Spec], keyed: Sequence[Spec]) -> DataFrame:
    """Rows (`__n`) per set of broken row checks (`__set` 0, bits in `__b...`) and per key of each uniqueness check (1 and on).

    Every row is expanded into these and counted before the shuffle, so the table is scanned once.
    """
    words = range(-(-len(row_checks) // _BITS))
    masks = []
    for w in words:
        bits = [
            F.when(_BROKEN[c["type"]](c), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint")
            for i, c in enumerate(row_checks[w * _BITS : (w + 1) * _BITS])
        ]
        masks.append(reduce(Column.bitwiseOR, bits).alias(f"__b{w}"))
    columns = list(dict.fromkeys(name for c in keyed for name in c["columns"]))
    keys = [F.col(name).alias(f"__k{i}") for i, name in enumerate(columns)]
    if not keyed:
        return df.select(F.lit(0).alias("__set"), *masks).groupBy("__set", *[f"__b{w}" for w in words]).agg(F.count(F.lit(1)).alias("__n"))
    flat = df.select(*masks, *keys)
    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in flat.schema.fields}
    copies = [F.struct(F.lit(0).alias("__set"), *[F.col(f"__b{w}") for w in words], *[none[f"__k{i}"] for i in range(len(columns))])]
    for number, check in enumerate(keyed, 1):
        own = [F.col(f"__k{i}") if name in check["columns"] else none[f"__k{i}"] for i, name in enumerate(columns)]
        copies.append(F.struct(F.lit(number).alias("__set"), *[none[f"__b{w}"] for w in words], *own))
    every = flat.select(F.inline(F.array(*copies)))
    return every.groupBy(*every.columns).agg(F.count(F.lit(1)).alias("__n"))


def _chosen(spec: Spec, phase: str | None) -> list[Spec]:
    """The checks of a valid spec that run in `phase`."""
    validate_spec(spec)
    if phase is not None and phase not in PHASES:
        raise BadSpec(f"unknown phase {phase!r}")
    chosen = [
        c for c in spec["checks"] if phase is None or phase in c.get("phases", PHASES)
    ]
    if not chosen:
        raise BadSpec(f"no check to run in phase {phase!r}")
    return chosen


def run_check_suite(df: DataFrame, spec: Spec, phase: str | None = None) -> DataFrame:
    """One row per check of `phase` (all checks without one): violations found and whether it passed."""
    chosen = _chosen(spec, phase)
    row_checks = [c for c in chosen if c["type"] in _BROKEN]
    keyed = [c for c in chosen if c["type"] == "uniqueness"]
    counted = _counted(df, row_checks, keyed)
    total = F.sum(F.when(F.col("__set") == 0, F.col("__n")))
    found = [F.coalesce(total, F.lit(0)).cast("bigint").alias("rows_checked")]
    for i in range(len(row_checks)):
        bit = F.col(f"__b{i // _BITS}").bitwiseAND(F.lit(1 << (i % _BITS))) != 0
        found.append(F.coalesce(F.sum(F.when(bit, F.col("__n"))), F.lit(0)).alias(f"__broken{i}"))
    for number in range(1, len(keyed) + 1):
        repeated = (F.col("__set") == number) & (F.col("__n") > 1)
        found.append(F.count(F.when(repeated, 1)).alias(f"__repeated{number}"))
    # A global aggregate has one row even for an empty table.
    one = counted.agg(*found)

    return _report(one, df, chosen, spec)


def _report(one: DataFrame, df: DataFrame, chosen: Sequence[Spec], spec: Spec) -> DataFrame:
    """The report from one row of counts; `df` only tells the columns."""
    required = set(spec.get("required", []))
    row_checks = [c for c in chosen if c["type"] in _BROKEN]
    keyed = [c for c in chosen if c["type"] == "uniqueness"]
    rows, places = F.col("rows_checked"), {c["id"]: i for i, c in enumerate(row_checks)}
    numbers = {c["id"]: i for i, c in enumerate(keyed, 1)}
    reported = []
    for check in chosen:
        kind = check["type"]
        if kind in _DECLARED:
            violations = F.lit(len(_DECLARED[kind](df, check)))
        elif kind == "uniqueness":
            violations = F.col(f"__repeated{numbers[check['id']]}")
        elif kind == "row_count":
            violations = _row_count(check, rows)
        else:
            violations = F.col(f"__broken{places[check['id']]}")
            if kind == "null_rate":
                violations = _null_rate(check, violations, rows)
        reported.append(
            F.struct(
                F.lit(check["id"]).alias("check_id"),
                F.lit(kind).alias("check_type"),
                F.lit(check["id"] in required).alias("required"),
                rows,
                violations.cast("bigint").alias("violations"),
            )
        )
    report = one.select(F.inline(F.array(*reported)))
    return report.withColumn("passed", F.col("violations") == 0).select(*RESULT_COLUMNS)


def check_states(df: DataFrame, spec: Spec, phase: str | None = None) -> DataFrame:
    """One row of counts that add up: all rows (`rows_checked`) and, per row check, those that break it.

    The states of parts of a table, say of its days, give the report of the whole (`report_of_states`). Uniqueness is not a
    sum over parts, so a spec with such a check is refused.
    """
    chosen = _chosen(spec, phase)
    if [c for c in chosen if c["type"] == "uniqueness"]:
        raise BadSpec("uniqueness can't be added up from parts of a table")
    broken = [F.count(F.when(_BROKEN[c["type"]](c), 1)).alias(f"__broken{i}") for i, c in enumerate(c for c in chosen if c["type"] in _BROKEN)]
    return df.agg(F.count(F.lit(1)).alias("rows_checked"), *broken)


def report_of_states(states: DataFrame, df: DataFrame, spec: Spec, phase: str | None = None) -> DataFrame:
    """The report of `run_check_suite` from the states of all parts of the table `df`, which is not read."""
    chosen = _chosen(spec, phase)
    names = [c for c in states.columns if c == "rows_checked" or c.startswith("__broken")]
    one = states.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in names])
    return _report(one, df, chosen, spec)


def failed_required(report: DataFrame) -> list[str]:
    """Ids of required checks that did not pass (an action; one row per check)."""
    rows = report.where(F.col("required") & ~F.col("passed")).select("check_id").collect()
    return sorted(r["check_id"] for r in rows)
