"""What every job shares: named tables of one schema, publishing, and gates on what was written."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from millrace.checks.contracts import CONTRACTS
from millrace.checks.gates import EXAMPLES, GateFailed
from millrace.checks.suite import failed_required, run_check_suite
from millrace.sinks import tables
from millrace.sinks.staged import Audit


@dataclass(frozen=True)
class Store:
    """The tables of one schema. With a `phase`, each published table must meet its contract of that phase."""

    spark: SparkSession
    schema: str
    phase: str | None = None

    def name(self, table: str) -> str:
        return f"{self.schema}.{table}"

    def read(self, table: str) -> DataFrame:
        return self.spark.table(self.name(table))

    def publish(self, table: str, df: DataFrame, *checks: dict[str, Any], audit: Audit | None = None) -> DataFrame:
        """Overwrite a table and return it as written.

        The rows are first complete beside the table. There `checks` run on them in one pass, then the table's contract of
        the phase and `audit`; a failure of any leaves the table as it was.
        """

        def passes(rows: DataFrame) -> None:
            if checks:
                self._run(table, rows, {"checks": checks, "required": [c["id"] for c in checks]}, None)
            if self.phase and table in CONTRACTS:
                self._run(table, rows, CONTRACTS[table], self.phase)
            if audit is not None:
                audit(rows)

        tables.overwrite(df, self.name(table), audit=passes)
        return self.read(table)

    def require(self, table: str, *checks: dict[str, Any]) -> None:
        if checks:
            self._run(table, self.read(table), {"checks": checks, "required": [c["id"] for c in checks]}, None)

    def check_contract(self, table: str, phase: str) -> None:
        """Run the table's contract; a failing required check raises."""
        self._run(table, self.read(table), CONTRACTS[table], phase)

    def _run(self, table: str, rows: DataFrame, spec: dict[str, Any], phase: str | None) -> None:
        failed = failed_required(run_check_suite(rows, spec, phase))
        if failed:
            shown = [
                str(row.asDict())
                for check in spec["checks"]
                if check["id"] in failed and check["type"] == "row_rule"
                for row in rows.where(f"NOT coalesce({check['rule']}, false)").take(EXAMPLES)
            ]
            told = f", e.g. {'; '.join(shown)}" if shown else ""
            raise GateFailed(f"{self.name(table)} fails {failed}{told}")


def unique(*columns: str) -> dict[str, Any]:
    return {"id": f"unique {', '.join(columns)}", "type": "uniqueness", "columns": list(columns)}


def never_null(column: str) -> dict[str, Any]:
    return {"id": f"{column} not null", "type": "null_rate", "column": column, "max_pct": 0}


def known(column: str, values: Sequence[str]) -> dict[str, Any]:
    return {"id": f"{column} known", "type": "accepted_values", "column": column, "values": list(values)}


def rule(text: str) -> dict[str, Any]:
    return {"id": text, "type": "row_rule", "rule": text}


def exact_columns(columns: Sequence[str]) -> dict[str, Any]:
    return {"id": "columns", "type": "columns", "columns": list(columns)}


def exact_rows(count: int) -> dict[str, Any]:
    return {"id": f"{count} rows", "type": "row_count", "min": count, "max": count}


NOT_EMPTY: dict[str, Any] = {"id": "has rows", "type": "row_count", "min": 1}


def pattern(column: str, expression: str) -> dict[str, Any]:
    return {"id": f"{column} pattern", "type": "pattern", "column": column, "pattern": expression}
